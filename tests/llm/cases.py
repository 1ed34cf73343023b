"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing names."""

LONG_WORD = "ab" * 30_000
LONG_TEXT = "many words in one long text " * 8_000
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `key` long, here string, gone string, id long, spans string, items string, score string"
TEXTS = [None, "", " \n\t", "one", "Ein Haus\nund noch ein Haus", LONG_WORD, LONG_TEXT, "é ß \U0001f44d﻿", "one"]


def rows() -> list[tuple]:
    extra = ("r", 1, "h", "g", 2, "s", "i", "c")
    found = [(i, t, "en" if i % 2 else None, f"s{i % 3}", None, *extra) for i, t in enumerate(TEXTS)]
    return [*found, found[3], (None, "one", None, None, None, *extra), (None, None, None, None, None, *extra)]


def documents(spark):
    return spark.createDataFrame(rows(), COLUMNS)


def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)


def sorted_rows(df, *columns) -> list[tuple]:
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)

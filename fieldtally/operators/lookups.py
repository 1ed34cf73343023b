"""Code lists and the joins that put labels to codes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.session import settle

PROVINCE_LIST, FISH_LIST, PROCESSED_LIST, AREA_LIST = "provinces", "type", "typepro", "area"

# Labels each list brings in, by code column.
LABELS = {
    PROVINCE_LIST: ("province", "province_kh", "province_en"),
    FISH_LIST: ("fish_code", "fish_name_kh", "fish_name_en"),
    PROCESSED_LIST: ("proc_code", "proc_name_kh", "proc_name_en"),
    AREA_LIST: ("area_code", "area_kh", "area_en"),
}

# Labels that fall back to the code where the list has none; the local area label does not.
FALLBACKS = {
    "province_kh": "province",
    "province_en": "province",
    "fish_name_kh": "fish_code",
    "fish_name_en": "fish_code",
    "proc_name_kh": "proc_code",
    "proc_name_en": "proc_code",
    "area_en": "area_code",
}


def code_list(choices: DataFrame, list_name: str) -> DataFrame:
    """``(code, label_kh, label_en)`` of one list, under the names that list's labels go by."""
    code, kh, en = LABELS[list_name]
    return choices.where(F.col("list_name") == list_name).select(
        F.col("name").alias(code), F.col("label_khmer").alias(kh), F.col("label_english").alias(en)
    )


def measure(choices: DataFrame) -> tuple[frozenset[str], dict[str, int]]:
    """The lists with repeated codes, and the bytes of each list: one row per list comes back."""
    columns = ("name", "label_khmer", "label_english")
    # text, and room for a row of it in a hash table
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 32 for c in columns), F.lit(0))
    codes = choices.where(F.col("list_name").isin(*LABELS)).groupBy("list_name", "name")
    by_code = codes.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes"))
    rows = by_code.groupBy("list_name").agg(F.max("n").alias("n"), F.sum("bytes").alias("bytes"))
    found = rows.collect()
    return frozenset(r.list_name for r in found if r.n > 1), {r.list_name: r.bytes for r in found}


def lookup_left_join(df: DataFrame, lookup: DataFrame, key: str, code: str) -> DataFrame:
    """Left join on one key, NULL matching NULL; a code listed twice doubles its rows.

    No hint: the planner broadcasts the list where its size is known to be under the threshold,
    and otherwise sort-merge joins with adaptive skew splitting.
    """
    side = lookup.withColumnRenamed(code, "__code")
    return df.join(side, df[key].eqNullSafe(side["__code"]), "left").drop("__code")


def label_fallback(df: DataFrame) -> DataFrame:
    """A label the list does not have is the code itself."""
    have = set(df.columns)
    filled = {
        label: F.coalesce(F.col(label), F.col(code))
        for label, code in FALLBACKS.items()
        if label in have and code in have
    }
    return df.withColumns(filled) if filled else df


class Codebook:
    """The choices table, by list.

    ``repeated`` names the lists in which some code occurs more than once.  Such a list has to be
    joined even where its labels are not shown, since it multiplies rows.  ``small`` names the
    lists known to be small enough to broadcast; the planner decides about the others.  What is
    not given is measured, once, by `measure`.
    """

    def __init__(
        self,
        choices: DataFrame,
        repeated: frozenset[str] | None = None,
        small: frozenset[str] = frozenset(),
    ):
        self.choices = choices
        self.small = small
        if repeated is not None:
            self.repeated = repeated

    @classmethod
    def measured(cls, choices: DataFrame, max_bytes: int = 64 << 20) -> "Codebook":
        """For choices from a database, of which the planner knows no size: lists that measure
        at most ``max_bytes`` are broadcast.  The choices are settled, so that the database is
        asked once."""
        choices = settle(choices)
        repeated, sizes = measure(choices)
        return cls(choices, repeated, frozenset(n for n, b in sizes.items() if b <= max_bytes))

    @cached_property
    def repeated(self) -> frozenset[str]:
        return measure(self.choices)[0]

    def list(self, list_name: str) -> DataFrame:
        rows = code_list(self.choices, list_name)
        return F.broadcast(rows) if list_name in self.small else rows

    def label(self, df: DataFrame, *lists: str) -> DataFrame:
        """Joins the lists in the order given, then fills labels that are missing."""
        for name in lists:
            code = LABELS[name][0]
            df = lookup_left_join(df, self.list(name), code, code)
        return label_fallback(df)

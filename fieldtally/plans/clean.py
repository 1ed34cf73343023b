"""One nested source to five tidy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally import domains as D
from fieldtally.functions import coercion
from fieldtally.operators import cleaning
from fieldtally.operators.repeats import explode_repeat
from fieldtally.sources.submissions import REPEAT_FIELDS, texts

KEYS = ("_id", "province", "date")


def clean_main(submissions: DataFrame) -> DataFrame:
    """One row per submission, without its repeat groups."""
    df = cleaning.flatten_struct(cleaning.drop_repeats(submissions))
    df = cleaning.normalize_names(df)
    df = cleaning.cast_integer(df, ["inspectorate", "province"])
    if "submission_time" in df.columns:
        df = df.withColumn("submission_time", coercion.to_moment_text(F.col("submission_time")))
    df = cleaning.drop_columns(df, D.DROP_SUBMISSION)
    return cleaning.fill_missing_text(df)


def _rows_of(submissions: DataFrame, repeat: str, dropped: tuple[str, ...]) -> DataFrame:
    rows = explode_repeat(submissions, repeat, KEYS, texts(*REPEAT_FIELDS[repeat]))
    rows = cleaning.normalize_names(cleaning.flatten_struct(rows))
    return cleaning.drop_columns(rows, dropped)


def clean_capture(submissions: DataFrame) -> DataFrame:
    rows = _rows_of(submissions, "nat_fishcatch", D.DROP_CAPTURE)
    return cleaning.blank_to_null_token(cleaning.fill_unspecified(cleaning.list_to_text(rows)))


def clean_aquaculture(submissions: DataFrame) -> DataFrame:
    rows = _rows_of(submissions, "aqu_fishcatch", D.DROP_AQUACULTURE)
    return cleaning.blank_to_null_token(cleaning.fill_unspecified(cleaning.list_to_text(rows)))


def clean_processing(submissions: DataFrame) -> DataFrame:
    rows = _rows_of(submissions, "processing", D.DROP_PROCESSING)
    return cleaning.fill_missing_text(cleaning.list_to_text(rows))


def clean_patrol(submissions: DataFrame) -> DataFrame:
    rows = _rows_of(submissions, "patrol", ())
    rows = cleaning.multiselect_to_text(rows, "patrol_enforcement")
    rows = cleaning.drop_columns(rows, D.DROP_PATROL)
    return cleaning.fill_missing_text(cleaning.list_to_text(rows))


@dataclass(frozen=True)
class CleanTables:
    main: DataFrame
    aqu: DataFrame
    nat: DataFrame
    processing: DataFrame
    patrol: DataFrame


def clean_all(submissions: DataFrame) -> CleanTables:
    """The five tables.  Give it staged submissions, so that each reads only its own columns."""
    return CleanTables(
        main=clean_main(submissions),
        aqu=clean_aquaculture(submissions),
        nat=clean_capture(submissions),
        processing=clean_processing(submissions),
        patrol=clean_patrol(submissions),
    )


"""Nested submissions: schema, reading, staging."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, GroupedData, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.operators.repeats import require_results
from fieldtally.session import listed, shared_folder
from fieldtally.sources.pages import page_elements

BAD = "__unread"


def texts(*names: str) -> T.StructType:
    """A row type of text fields."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _repeat(*names: str) -> T.ArrayType:
    return T.ArrayType(texts(*names))


# Fields of one element of each repeat group, as the form names them.
REPEAT_FIELDS = {
    "nat_fishcatch": (
        "nat_fishcatch/nat_catch",
        "nat_fishcatch/area_nat",
        "nat_fishcatch/type_fishing",
        "nat_fishcatch/nat_fishtype",
    ),
    "aqu_fishcatch": (
        "aqu_fishcatch/aqu_catch",
        "aqu_fishcatch/area_aqu",
        "aqu_fishcatch/aqu_type",
        "aqu_fishcatch/aqu_fishtype",
    ),
    "processing": (
        "processing/amountprocessing",
        "processing/typeprocessing",
        "processing/area_pro",
    ),
    "patrol": ("patrol/amount", "patrol/enforcement"),
}

# The answers the reports need.  A form with more questions extends this; every answer is text.
SUBMISSION = T.StructType(
    [T.StructField("_id", T.LongType())]
    + texts("date", "province", "inspectorate", "_submission_time", "_status").fields
    + [
        T.StructField("_validation_status", texts("uid", "label", "color")),
        T.StructField("_tags", T.ArrayType(T.StringType())),
    ]
    + [T.StructField(name, _repeat(*fields)) for name, fields in REPEAT_FIELDS.items()]
)


def payload_schema(submission: T.StructType = SUBMISSION) -> T.StructType:
    return T.StructType([T.StructField("results", T.ArrayType(submission))])


def results_of(payload: DataFrame) -> DataFrame:
    """One row per submission of payloads that hold them under ``results``.

    A payload without ``results``, such as a torn file, fails the job rather than losing rows.
    The outer explode keeps the planner from adding a filter on ``results`` below it, which
    would parse a payload text a second time.
    """
    missing = F.raise_error(F.lit("a payload has no results"))
    held = F.coalesce(F.col("results"), missing)
    rows = require_results(payload).select(F.explode_outer(held).alias("s"))
    return rows.where(F.col("s").isNotNull()).select("s.*")


def records(texts_read: DataFrame, schema: T.StructType, lines: bool = True) -> DataFrame:
    """``file, pos, text, s`` and ``fault`` of JSON texts in ``value``, each parsed once as ``schema``.

    ``lines`` are one submission each, without ``pos``.  Otherwise a text is a payload page: its
    ``results`` are taken apart as texts, dealt out evenly, and parsed each by itself; ``pos`` is
    the place on the page.  ``fault`` says what is wrong where ``text`` can't be read as ``schema``:
    torn, of another type in any field, or no object; without ``pos`` it is a whole page, torn or
    without ``results``.  Empty lines and missing elements are no records.
    """
    rows = texts_read.select(F.col("_metadata.file_path").alias("file"), "value")
    if lines:
        nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("pos", "int"), ("page", "string"))]
        rows = rows.where(F.trim("value") != "").select("file", *nothing, F.col("value").alias("text"))
    else:
        page = T.StructType([T.StructField("results", T.ArrayType(T.StringType())), T.StructField(BAD, T.StringType())])
        rows = rows.select("file", "value", _once(F.from_json("value", page, {"columnNameOfCorruptRecord": BAD}), "p"))
        torn = F.col("p").isNull() | F.col(f"p.{BAD}").isNotNull()
        fault = F.when(torn, "a page of submissions can't be read in ").when(F.col("p.results").isNull(), "a page has no results in ")
        rows = rows.select("file", "value", fault.alias("page"), F.col("p.results").alias("results"))
        # a page that can't be taken apart stays as one text; the others' texts end here
        parts = F.when(F.col("page").isNull(), F.col("results")).otherwise(F.array("value"))
        rows = rows.select("file", "page", F.posexplode_outer(parts).alias("pos", "text"))
        rows = rows.where(F.col("text").isNotNull()).hint("rebalance")
        rows = rows.select("file", F.when(F.col("page").isNull(), F.col("pos")).alias("pos"), "page", "text")
    return parsed_records(rows, schema)


def parsed_records(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``file, pos, text, s, fault`` of ``file, pos, page, text``; ``page`` is the fault of what isn't a submission's text."""
    parsed = F.from_json("text", T.StructType([*schema.fields, T.StructField(BAD, T.StringType())]), {"columnNameOfCorruptRecord": BAD})
    rows = rows.select("file", "pos", "page", "text", _once(parsed, "s"))
    unread = F.col("s").isNull() | F.col(f"s.{BAD}").isNotNull()
    fault = F.coalesce("page", F.when(unread, "a submission can't be read in "))
    return rows.select("file", "pos", "text", "s", fault.alias("fault"))


def _once(column: Column, name: str) -> Column:
    """A column that filters above it are not moved below, so that it is computed once.

    It comes from an explode of one element; an outer one, which adds no filter of its own.
    """
    return F.explode_outer(F.array(column)).alias(name)


def fields_of(schema: T.StructType) -> list[Column]:
    return [F.col(f"s.`{f.name}`") for f in schema.fields]


def readable(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The submissions of records; one that can't be read fails the job and names its file."""
    failed = F.raise_error(F.concat("fault", "file"))
    kept = rows.where(F.when(F.col("fault").isNotNull(), failed).otherwise(F.lit(True)))
    return kept.select(*fields_of(schema))


def _texts(reader, path: str, lines: bool) -> DataFrame:
    return reader.text(path, wholetext=not lines)


def parse_landed(
    spark: SparkSession, path: str, out: str, lines: bool = False, schema: T.StructType = SUBMISSION
) -> tuple[int, int]:
    """Parses landed files into a folder, submissions under ``bad=false``, other records under ``bad=true``.

    One pass gives both, and their numbers.
    """
    rows = records(listed(spark, lambda: _texts(spark.read, path, lines)), schema, lines)
    seen = Observation()
    bad = F.col("fault").isNotNull()
    split = rows.select("file", "pos", F.when(bad, F.col("text")).alias("text"), F.when(~bad, F.col("s")).alias("s"), bad.alias("bad"))
    split = split.observe(seen, F.count_if(~F.col("bad")).alias("good"), F.count_if(F.col("bad")).alias("bad"))
    split.write.mode("overwrite").option("compression", "zstd").partitionBy("bad").parquet(out)
    return seen.get["good"], seen.get["bad"]


def _parsed(spark: SparkSession, out: str, schema: T.StructType, bad: bool) -> DataFrame:
    """What `parse_landed` wrote, the one part or the other."""
    held = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    kind = T.StructType([
        T.StructField("file", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType()),
        T.StructField("s", held), T.StructField("bad", T.BooleanType()),
    ])
    rows = spark.read.schema(kind).parquet(out).where(F.col("bad") == bad)
    return rows.select("file", "pos", "text") if bad else rows.select(*fields_of(schema))


def read_pages(spark: SparkSession, path: str, schema: T.StructType = SUBMISSION) -> DataFrame:
    """Submissions from landed payload pages of any size, each taken apart by many tasks.

    Elsewhere as `read_submissions`, which is faster for pages that fit a task: what can't be read
    fails the job and names its file.
    """
    return readable(parsed_records(page_elements(spark, path), schema), schema)


def read_submissions(
    spark: SparkSession, path: str, lines: bool = False, schema: T.StructType = SUBMISSION, rejects: str | None = None
) -> DataFrame:
    """Submissions from landed JSON files.

    ``lines`` reads one submission per line, which Spark splits within a file; use it for large
    files.  Otherwise each file is one payload page, taken apart by one task; its submissions are
    dealt out evenly and parsed then.

    A submission that can't be read as ``schema``, or a page without ``results``, fails the job with
    the name of its file.  With ``rejects``, it is written to that folder as ``file, pos, text``
    (``pos`` is its place on a page, missing for a line and a whole page), and all others are
    returned, from a folder in ``spark.checkpoint.dir``: files are read and parsed once for both.
    """
    if rejects is not None:
        return _set_aside(spark, path, rejects, lines, schema)[0]
    return readable(records(listed(spark, lambda: _texts(spark.read, path, lines)), schema, lines), schema)


def set_aside(
    spark: SparkSession, path: str, rejects: str, lines: bool = False, schema: T.StructType = SUBMISSION
) -> int:
    """Writes the records that can't be read to a folder, as ``file, pos, text``, and gives their number."""
    return _set_aside(spark, path, rejects, lines, schema)[1]


def _set_aside(
    spark: SparkSession, path: str, rejects: str, lines: bool, schema: T.StructType
) -> tuple[DataFrame, int]:
    out = f"{shared_folder(spark)}/parsed-{uuid.uuid4().hex}"
    _, bad = parse_landed(spark, path, out, lines, schema)
    _parsed(spark, out, schema, True).write.mode("overwrite").option("compression", "zstd").parquet(rejects)
    return _parsed(spark, out, schema, False), bad


def latest_versions(submissions: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Each submission once, as it was last submitted, whatever was landed before or again.

    One aggregate by ``_id``: the row of the latest ``_submission_time`` (a missing or unreadable
    one is the earliest), of equal times the one of the greatest hash of all answers, so that the
    result doesn't depend on the order of files.  Rows without an id are told apart by their answers.
    With ``columns`` only these are carried through the shuffle; which row counts stays the same.
    """
    newest = newest_version(submissions.columns, columns).alias("s")
    return by_submission(submissions).agg(newest).select("s.*")


def _hash_of(names: Iterable[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in names])


def by_submission(submissions: DataFrame) -> GroupedData:
    unnamed = F.when(F.col("_id").isNull(), _hash_of(submissions.columns))
    return submissions.groupBy(F.col("_id").alias("__id"), unnamed.alias("__unnamed"))


def newest_version(names: Iterable[str], kept: Iterable[str] | None = None) -> Column:
    """Of the rows of a submission the latest one, as a struct of its columns, or of those ``kept``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in (names if kept is None else kept)])
    return F.max_by(whole, F.struct(F.try_to_timestamp(F.col("_submission_time")), _hash_of(names)))


def find_schema(spark: SparkSession, path: str, lines: bool = False) -> T.StructType:
    """The schema of landed files with every answer in them, text where the reports say nothing else.

    One pass over all files, none of them sampled.  The fields of ``SUBMISSION`` keep their types,
    so that a file that lacks or spoils one doesn't change the tables.
    """
    reader = spark.read.option("primitivesAsString", True).option("samplingRatio", 1.0)
    found = reader.json(path, multiLine=not lines).schema
    if not lines:
        found = found["results"].dataType.elementType if "results" in found.names else T.StructType([])
    known = set(SUBMISSION.names)
    more = [f for f in found.fields if f.name not in known and f.name != "_corrupt_record"]
    return T.StructType([*SUBMISSION.fields, *more])


def parse_submissions(text: Column, schema: T.StructType = SUBMISSION) -> Column:
    """A column of payload texts as nested payloads, for text that is already in a table."""
    return F.from_json(text, payload_schema(schema))


def stage_submissions(df: DataFrame, path: str) -> DataFrame:
    """Writes the parsed submissions as parquet and reads them back.

    The five tables then each read their own columns, and JSON is parsed once.
    """
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

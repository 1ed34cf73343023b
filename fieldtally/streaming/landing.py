"""Landed submission files to staged tables, new files only.

A first stream parses landed files into staged submissions; one stream per table reads its own
columns of those.  Cleaning and typing are those of the one-off load and work row by row, so no
stream keeps state.  The sinks record which files belong to a finished batch: a restart after a
lost driver or executor neither loses nor repeats a submission.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from fieldtally.functions import calendar, coercion
from fieldtally.operators.lookups import Codebook
from fieldtally.plans import clean, typed
from fieldtally.session import settle
from fieldtally.sources.staging import stage_facets
from fieldtally.sources.submissions import SUBMISSION, by_submission, newest_version, readable, records
from fieldtally.sources.warehouse import Warehouse

STEPS = {
    "capture": (clean.clean_capture, typed.typed_capture),
    "aquaculture": (clean.clean_aquaculture, typed.typed_aquaculture),
    "processing": (clean.clean_processing, typed.typed_processing),
    "patrol": (clean.clean_patrol, typed.typed_patrol),
}
#: Files of a batch, and parts a year's rows of a batch are written in.
MAX_FILES, FILES_PER_YEAR = 1000, 4


def _start(writer: DataStreamWriter, out: str, checkpoint: str) -> StreamingQuery:
    """Works off what is there, batch by batch, and stops."""
    writer = writer.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(out)


def land(
    spark: SparkSession,
    landed: str,
    staged: str,
    checkpoint: str,
    schema: T.StructType = SUBMISSION,
    skip_bad: bool = False,
    max_files: int = MAX_FILES,
) -> StreamingQuery:
    """Parses new JSON-lines files of a folder into staged submissions.

    A line that can't be read fails the batch with the name of its file, as in the one-off load.
    With ``skip_bad`` it is left out; run `land_rejects` to keep such lines.
    """
    rows = records(_lines(spark, landed, max_files), schema)
    if skip_bad:
        rows = rows.where(F.col("fault").isNull())
    return _start(readable(rows, schema).writeStream, staged, f"{checkpoint}/submissions")


def land_rejects(
    spark: SparkSession,
    landed: str,
    rejects: str,
    checkpoint: str,
    schema: T.StructType = SUBMISSION,
    max_files: int = MAX_FILES,
) -> StreamingQuery:
    """Keeps the lines of new files that can't be read, as ``file, pos, text``."""
    rows = records(_lines(spark, landed, max_files), schema)
    bad = rows.where(F.col("fault").isNotNull()).select("file", "pos", "text")
    return _start(bad.writeStream, rejects, f"{checkpoint}/rejects")


def _lines(spark: SparkSession, landed: str, max_files: int) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(landed)


def typed_stream(submissions: DataFrame, name: str) -> DataFrame:
    cleaned, typed_columns = STEPS[name]
    return typed_columns(cleaned(submissions))


def load(
    spark: SparkSession,
    name: str,
    staged: str,
    out: str,
    checkpoint: str,
    schema: T.StructType = SUBMISSION,
    max_files: int = MAX_FILES,
) -> StreamingQuery:
    """Appends a table's rows of newly staged submissions, by year, as `StagedTables` reads them.

    Rows are dealt by year and a salt, so that a batch leaves a few files a year however many
    tasks it has, and a year with most of the rows has several writers.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    rows = typed_stream(reader.parquet(staged), name)
    rows = rows.repartition("year", F.pmod(F.xxhash64("id", "pos"), F.lit(FILES_PER_YEAR)))
    return _start(rows.writeStream.partitionBy("year"), f"{out}/{name}", f"{checkpoint}/{name}")


def load_facets(
    spark: SparkSession,
    name: str,
    staged: str,
    out: str,
    checkpoint: str,
    schema: T.StructType = SUBMISSION,
    max_files: int = MAX_FILES,
) -> StreamingQuery:
    """Adds the filter values of newly staged submissions to those kept with the tables.

    Each batch has its own part, which a repeated batch replaces.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    rows = typed_stream(reader.parquet(staged), name)

    def add(batch: DataFrame, number: int) -> None:
        stage_facets([batch], out, f"{name}-{number}")

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{checkpoint}/facets-{name}")
    return writer.trigger(availableNow=True).start()


def merge(
    spark: SparkSession,
    staged: str,
    out: str,
    checkpoint: str,
    codes: Codebook,
    schema: T.StructType = SUBMISSION,
    max_files: int = MAX_FILES,
    keep: int = 2,
) -> StreamingQuery:
    """Keeps the tables of a `Warehouse` at the latest version of every submission.

    The stream's state holds, by submission, its latest version and the dates it ever had.  A batch
    replaces the changed submissions in the years of all of these dates, together with the partial
    sums and filter values of those years; other years are not touched.  All of it counts from one
    manifest on, which also notes the batch: a batch that is repeated after a failure is passed
    over if it is in.  Older versions are cleared but for ``keep``.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    versions = by_submission(reader.parquet(staged)).agg(
        newest_version(schema.names).alias("s"), F.collect_set("date").alias("dates")
    )

    def add(batch: DataFrame, number: int) -> None:
        tables = Warehouse(spark, out, codes)
        if tables.batches.get("merge", -1) >= number:
            return
        changed = settle(batch)
        dated = changed.select(F.explode_outer("dates").alias("date"))
        dates = dated.select(calendar.year_of(coercion.date_of(dated, "date")).alias("year"))
        years = [r["year"] for r in dates.distinct().collect()]  # as many as the form has years
        if not years:
            return
        newest = changed.select("s.*")
        ids = newest.select(F.col("_id").alias("id"))
        merged = {}
        for name in STEPS:
            rows = typed_stream(newest, name)
            if not tables.is_empty:
                rows = tables.read(name, years).join(ids, "id", "left_anti").unionByName(rows)
            merged[name] = rows
        tables.publish(merged, years, ("merge", number)).clear(keep)

    writer = versions.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{checkpoint}/merge")
    return writer.trigger(availableNow=True).start()

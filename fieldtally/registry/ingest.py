"""Reading, cleaning and writing."""

from __future__ import annotations

import datetime
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally import domains as D
from fieldtally.functions import coercion
from fieldtally.operators import cleaning
from fieldtally.operators.filters import Filters
from fieldtally.operators.lookups import Codebook
from fieldtally.operators.repeats import explode_repeat, require_results
from fieldtally.plans import clean
from fieldtally.plans.bundle import report_bundle
from fieldtally.plans.reports import t04_rice_field, t08_enforcement, t10_facilities
from fieldtally.plans.typed import SurveyTables
from fieldtally.registry import reporting
from fieldtally.registry.core import query, shown
from fieldtally.registry.sql import calendar as sql_calendar
from fieldtally.registry.sql import table_sql as TABLES
from fieldtally.registry.sql import with_tables
from fieldtally.session import shared_folder
from fieldtally.sources import sinks, star
from fieldtally.sources.choices import read_choices
from fieldtally.sources.staging import StagedTables, stage_tables
from fieldtally.sources.submissions import (
    find_schema,
    latest_versions,
    parse_submissions,
    read_pages,
    read_submissions,
    results_of,
    stage_submissions,
)

# --- sources ---------------------------------------------------------------------------------


def landing_folder(spark) -> str:
    """A folder of its own for what a query lands, among those the cluster shares."""
    return f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"


def land(texts: DataFrame, pages: bool = False) -> str:
    """Writes texts to a landing folder: lines to files small enough for many readers, pages to a file each.

    JSON repeats its names in every submission; compressed it takes a fifteenth of the disk.
    """
    folder = landing_folder(texts.sparkSession)
    writer = texts.write.option("compression", "gzip")
    (writer.partitionBy("page") if pages else writer.option("maxRecordsPerFile", 20_000)).text(folder)
    return folder


def landed_lines(spark, sf, *more) -> str:
    return land(star.line_texts(spark, sf, *more))


def landed_pages(spark, sf) -> str:
    """Pages as files of one payload each."""
    return land(star.page_lines(spark, sf), pages=True)


READ = with_tables(
    """SELECT id, date, province, submission_time,
    CASE WHEN line < 6 THEN 2 WHEN line = 6 THEN 0 ELSE -1 END AS captures,
    CASE WHEN line < 6 THEN caught ELSE 'NA' END AS first_catch FROM subs""",
    "subs",
)


@query("read_submissions", READ)
def _(spark, sf):
    """Lines of JSON in files, read by the reader."""
    return _read_columns(read_submissions(spark, landed_lines(spark, sf), lines=True))


@query("read_submissions__pages", READ)
def _(spark, sf):
    """Payload pages of many submissions in files, read by the reader."""
    return _read_columns(read_submissions(spark, landed_pages(spark, sf)))


@query("read_submissions__large_pages", READ)
def _(spark, sf):
    """Payload pages in files, each cut by byte ranges and put together by element."""
    return _read_columns(read_pages(spark, landed_pages(spark, sf)))


@query("read_submissions__parsed", READ)
def _(spark, sf):
    """Payload texts that are in a table already."""
    payload = star.payload_texts(spark, sf).select(parse_submissions(F.col("payload")).alias("p"))
    return _read_columns(results_of(payload.select("p.*")))


@query("read_submissions__rejects", """SELECT CAST(count(*) FILTER (WHERE l_linenumber NOT IN (2, 3, 5)) AS BIGINT) AS good,
    CAST(count(*) FILTER (WHERE l_linenumber IN (2, 3, 5)) AS BIGINT) AS bad FROM lineitem""")
def _(spark, sf):
    """Torn lines, groups of a wrong type and ids that are no number, set aside and counted."""
    line = F.get_json_object("value", "$.inspectorate")
    spoilt = (
        F.when(F.get_json_object("value", "$._id") % 8 == 2, F.expr("substr(value, 1, length(value) - 9)"))
        .when(line == "none", F.regexp_replace("value", r'"_id":(\d+)', '"_id":"no $1"'))
        .when(line == "5", F.regexp_replace("value", r'"nat_fishcatch":\[.*?\]', '"nat_fishcatch":"none"'))
        .otherwise(F.col("value"))
    )
    folder, rejects = land(star.line_texts(spark, sf).select(spoilt.alias("value"))), landing_folder(spark)
    good = read_submissions(spark, folder, lines=True, rejects=rejects)
    counts = good.select(F.lit(1).alias("good"), F.lit(0).alias("bad")).unionAll(
        spark.read.parquet(rejects).select(F.lit(0), F.lit(1))
    )
    return counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


@query("read_submissions__pages_rejects", """SELECT CAST(count(*) FILTER (WHERE l_linenumber NOT IN (3, 5)) AS BIGINT) AS good,
    CAST(count(*) FILTER (WHERE l_linenumber IN (3, 5)) AS BIGINT) AS bad,
    CAST(sum(l_orderkey * 8 + l_linenumber) FILTER (WHERE l_linenumber NOT IN (3, 5)) AS BIGINT) AS ids,
    CAST(count(DISTINCT (l_orderkey * 8 + l_linenumber) // 2000) AS BIGINT) AS pages FROM lineitem""")
def _(spark, sf):
    """Pages with groups of a wrong type and ids that are no number: all other submissions of a page stay."""
    value = F.col("value")
    no_id = F.regexp_replace(value, r'"_id":(\d+)(,[^{}]*"inspectorate":"none")', '"_id":"no $1"$2')
    value = F.when(value.contains('"inspectorate":"none"'), no_id).otherwise(value)
    no_status = F.regexp_replace(value, r'("inspectorate":"5",[^{}]*"_validation_status":)\{[^}]*\}', '$1"none"')
    value = F.when(value.contains('"inspectorate":"5",'), no_status).otherwise(value)
    folder, rejects = land(star.page_lines(spark, sf).withColumn("value", value), pages=True), landing_folder(spark)
    good = read_submissions(spark, folder, rejects=rejects)
    aside = spark.read.parquet(rejects)
    counts = good.select(F.lit(1).alias("good"), F.lit(0).alias("bad"), F.col("_id").alias("ids"), F.lit(None).alias("page")).unionAll(
        aside.select(F.lit(0), F.lit(1), F.lit(0).cast("long"), "file")
    )
    return counts.agg(*[F.sum(c).alias(c) for c in ("good", "bad", "ids")], F.count_distinct("page").alias("pages"))


LATER = """CASE WHEN line < 5 THEN DATE '2030-01-01' ELSE DATE '1985-01-01' END"""
SUBMITTED = """strftime({start} + CAST(CAST(date AS DATE) - DATE '1990-01-01' AS INTEGER), '%Y-%m-%d')
    || 'T00:00:' || lpad(CAST(CAST(province AS INTEGER) AS VARCHAR), 2, '0')"""


@query("read_submissions__latest", with_tables(
    f""", landed AS (
        SELECT id, date, province, CASE WHEN line <> 5 THEN {SUBMITTED.format(start="DATE '2000-01-01'")} END AS given FROM subs
        UNION ALL SELECT id, date, CASE WHEN line = 1 THEN '24' ELSE province END, {SUBMITTED.format(start=LATER)} FROM subs
    )
    SELECT id, max_by(date, given) AS date, max_by(province, given) AS province, left(max(given), 4) AS year_submitted
    FROM landed GROUP BY id""",
    "subs",
))
def _(spark, sf):
    """Submissions landed twice or more, some with an answer changed: the one last submitted counts, a time that can't be read is early."""
    line = F.col("s._id") % 8
    days = F.datediff(F.to_date("s.date"), F.lit("1990-01-01").cast("date"))

    def submitted(start: Column) -> Column:
        return F.concat(F.date_add(start, days).cast("string"), F.lit("T00:00:"), F.lpad(F.col("s.province").cast("int").cast("string"), 2, "0"))

    first = F.when(line == 5, "unknown").otherwise(submitted(F.lit("2000-01-01").cast("date")))
    second = submitted(F.when(line < 5, F.lit("2030-01-01").cast("date")).otherwise(F.lit("1985-01-01").cast("date")))
    province = F.when(line == 1, "24").otherwise(F.col("s.province"))
    given = star.submissions(spark, sf).select(F.struct("*").alias("s"))
    versions = [
        given.select(F.to_json(F.col("s").withField("_submission_time", first)).alias("value")),
        given.select(F.to_json(F.col("s").withField("_submission_time", second).withField("province", province)).alias("value")),
    ]
    folder = land(versions[0].unionAll(versions[1]))
    found = latest_versions(read_submissions(spark, folder, lines=True), ["_id", "date", "province", "_submission_time"])
    return found.select(F.col("_id").alias("id"), "date", "province", F.col("_submission_time").substr(1, 4).alias("year_submitted"))


def _read_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("_id").alias("id"),
        "date",
        "province",
        F.col("_submission_time").alias("submission_time"),
        F.coalesce(F.size("nat_fishcatch"), F.lit(-1)).alias("captures"),
        shown(F.get("nat_fishcatch", 0)["nat_fishcatch/nat_catch"]).alias("first_catch"),
    )


@query("read_choices", with_tables(
    """SELECT 'provinces' AS list_name, code AS name, province_kh AS label_khmer,
        province_en AS label_english FROM provinces
    UNION ALL SELECT 'type', code, fish_name_kh, fish_name_en FROM fish
    UNION ALL SELECT 'typepro', code, proc_name_kh, proc_name_en FROM kinds
    UNION ALL SELECT 'area', code, area_kh, area_en FROM areas""",
    "provinces", "fish", "kinds", "areas",
))
def _(spark, sf):
    """Choices landed as a table and read by the reader."""
    folder = landing_folder(spark)
    star.choices(spark, sf).write.parquet(folder)
    return read_choices(spark, folder)


CLEANED = with_tables(
    """SELECT 'main' AS table_name, count(*) AS n_rows,
        CAST(count(*) FILTER (WHERE line = 5) AS BIGINT) AS tokens FROM subs
    UNION ALL SELECT 'nat', 2 * count(*), 3 * count(*) FROM subs WHERE line < 6
    UNION ALL SELECT 'aqu', count(*), 0 FROM subs WHERE line < 6
    UNION ALL SELECT 'processing', 2 * count(*), 2 * count(*) FROM subs WHERE line < 6
    UNION ALL SELECT 'patrol', 3 * count(*), 4 * count(*) FROM subs WHERE line < 6""",
    "subs",
)


@query("clean_all", CLEANED)
def _(spark, sf):
    """Rows and missing-value tokens of each of the five tables."""

    def summary(name: str, df: DataFrame) -> DataFrame:
        kept = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        tokens = [F.when(F.col(c).isin(D.NULL_TOKEN, D.UNSPECIFIED), 1).otherwise(0) for c in kept]
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(sum(tokens, F.lit(0))).alias("tokens")
        ).select(F.lit(name).alias("table_name"), "n_rows", "tokens")

    tables = clean.clean_all(star.submissions(spark, sf))
    return reduce(DataFrame.unionAll, [summary(n, t) for n, t in vars(tables).items()])


@query("clean_main", with_tables(
    f"""SELECT id, date, CAST(CAST(province AS INTEGER) AS VARCHAR) AS province,
    CASE WHEN line = 3 THEN 'NA' ELSE inspectorate END AS inspectorate,
    CASE WHEN line = 5 THEN 'null' ELSE replace(submission_time, 'T', ' ') END AS submission_time
    FROM subs""",
    "subs",
))
def _(spark, sf):
    main = clean.clean_main(star.submissions(spark, sf))
    return main.withColumns({"province": shown("province"), "inspectorate": shown("inspectorate")})


@query("clean_main__all_answers", with_tables(
    """SELECT id, date, CAST(CAST(province AS INTEGER) AS VARCHAR) AS province,
    CASE WHEN line = 3 THEN 'NA' ELSE inspectorate END AS inspectorate,
    CASE WHEN line = 5 THEN 'null' ELSE replace(submission_time, 'T', ' ') END AS submission_time,
    CASE WHEN line < 4 THEN CAST(l_partkey AS VARCHAR) ELSE 'null' END AS boats_number,
    kind AS boats_owner_kind, CASE WHEN line = 1 THEN 'note ' || area ELSE 'null' END AS remark
    FROM subs""",
    "subs",
))
def _(spark, sf):
    """Answers the reports don't know stay; the unwanted ones go."""
    line = F.col("_id") % 8
    part, flag = F.get("nat_fishcatch", 0)["nat_fishcatch/nat_fishtype"], F.element_at("_tags", 1)
    items = F.get("aqu_fishcatch", 0)["aqu_fishcatch/area_aqu"]
    more = [
        F.when(line < 4, part.cast("long")).alias("boats/number"),
        F.struct(F.translate(flag, "RAN", "123").alias("Kind")).alias("boats/owner"),
        F.when(line == 1, F.concat(F.lit("note "), items)).alias("remark"),
        F.lit("u-1").alias("formhub/uuid"),
        F.lit("n").alias("__version__"),
    ]
    folder = landed_lines(spark, sf, *more)
    schema = find_schema(spark, folder, lines=True)
    main = clean.clean_main(read_submissions(spark, folder, lines=True, schema=schema))
    kept = ["id", "date", "province", "inspectorate", "submission_time", "boats_number", "boats_owner_kind", "remark"]
    unwanted = {"formhub_uuid", "version"} & set(main.columns)
    if unwanted:
        raise ValueError(f"not dropped: {unwanted}")
    return main.select(*kept).withColumns({"province": shown("province"), "inspectorate": shown("inspectorate")})


@query("clean_capture", with_tables(
    """SELECT id, province, date, CAST(e AS INTEGER) AS pos,
        CASE e WHEN 0 THEN caught ELSE 'unspecified' END AS nat_fishcatch_nat_catch,
        CASE e WHEN 0 THEN area ELSE 'null' END AS nat_fishcatch_area_nat,
        kind AS nat_fishcatch_type_fishing,
        CASE e WHEN 0 THEN part ELSE 'unspecified' END AS nat_fishcatch_nat_fishtype
    FROM subs, (SELECT unnest([0, 1]) AS e) WHERE line < 6""",
    "subs",
))
def _(spark, sf):
    return clean.clean_capture(star.submissions(spark, sf))


@query("clean_aquaculture", with_tables(
    """SELECT id, province, date, 0 AS pos, caught AS aqu_fishcatch_aqu_catch,
        area AS aqu_fishcatch_area_aqu, aqu_type AS aqu_fishcatch_aqu_type,
        part AS aqu_fishcatch_aqu_fishtype FROM subs WHERE line < 6""",
    "subs",
))
def _(spark, sf):
    return clean.clean_aquaculture(star.submissions(spark, sf))


@query("clean_processing", with_tables(
    """SELECT id, province, date, CAST(e AS INTEGER) AS pos,
        CASE e WHEN 0 THEN caught ELSE 'null' END AS processing_amountprocessing,
        kind AS processing_typeprocessing,
        CASE e WHEN 0 THEN area ELSE 'null' END AS processing_area_pro
    FROM subs, (SELECT unnest([0, 1]) AS e) WHERE line < 6""",
    "subs",
))
def _(spark, sf):
    return clean.clean_processing(star.submissions(spark, sf))


@query("clean_patrol", with_tables(
    """SELECT id, province, date, CAST(e AS INTEGER) AS pos,
        CASE e WHEN 0 THEN CAST(line AS VARCHAR) ELSE 'null' END AS patrol_amount,
        CASE e WHEN 0 THEN codes ELSE 'null' END AS patrol_enforcement
    FROM subs, (SELECT unnest([0, 1, 2]) AS e) WHERE line < 6""",
    "subs",
))
def _(spark, sf):
    return clean.clean_patrol(star.submissions(spark, sf))


# --- single cleaning steps -------------------------------------------------------------------


def _messy(spark, sf) -> DataFrame:
    """Answers as people type them: a number text, a time text and a code text per line item."""
    line, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("string")
    day = F.col("l_shipdate").cast("date").cast("string")
    none = F.lit(None).cast("string")
    number = (
        F.when(line == 1, quantity)
        .when(line == 2, F.concat(F.lit(" "), quantity, F.lit(" ")))
        .when(line == 3, F.concat(quantity, F.lit("d")))
        .when(line == 4, "")
        .when(line == 5, none)
        .when(line == 6, "1e3")
        .otherwise("3e9")
    )
    when = (
        F.when(line == 1, day)
        .when(line == 2, F.concat(day, F.lit("T08:30:05")))
        .when(line == 3, F.concat(day, F.lit(" 23:59:59")))
        .when(line == 4, F.translate(day, "-", "/"))
        .when(line == 5, "unspecified")
        .when(line == 6, F.substring(day, 1, 4))
    )
    return star.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), line.alias("pos"), number.alias("answer"),
        when.alias("moment"), F.col("l_partkey").alias("part"), "l_returnflag", "l_linestatus",
    )


MESSY = """SELECT l_orderkey AS id, l_linenumber AS pos, l_partkey AS part, l_returnflag, l_linestatus,
    l_quantity, CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS VARCHAR)
        WHEN 2 THEN ' ' || CAST(l_quantity AS VARCHAR) || ' '
        WHEN 3 THEN CAST(l_quantity AS VARCHAR) || 'd' WHEN 4 THEN '' WHEN 5 THEN NULL
        WHEN 6 THEN '1e3' ELSE '3e9' END AS answer, strftime(l_shipdate, '%Y-%m-%d') AS day
    FROM lineitem"""


def _messy_sql(columns: str) -> str:
    return f"SELECT id, pos, {columns} FROM ({MESSY})"


def _blank_items(spark, sf) -> DataFrame:
    return _messy(spark, sf).select("id", "pos", "answer")


@query("fill_missing_text", _messy_sql("coalesce(nullif(answer, ''), 'null') AS answer"))
def _(spark, sf):
    return cleaning.fill_missing_text(_blank_items(spark, sf))


@query("fill_unspecified", _messy_sql("coalesce(answer, 'unspecified') AS answer"))
def _(spark, sf):
    return cleaning.fill_unspecified(_blank_items(spark, sf))


@query("blank_to_null_token", _messy_sql(
    "coalesce(CASE WHEN answer = '' THEN 'null' ELSE answer END, 'NA') AS answer"
))
def _(spark, sf):
    blank = cleaning.blank_to_null_token(_blank_items(spark, sf))
    return blank.withColumn("answer", shown("answer"))


@query("fill_zero", _messy_sql("coalesce(TRY_CAST(answer AS DOUBLE), 0) AS answer"))
def _(spark, sf):
    numbers = cleaning.cast_double(_blank_items(spark, sf), ["answer"])
    return cleaning.fill_zero(numbers, ["answer"])


@query("cast_double", _messy_sql("coalesce(TRY_CAST(answer AS DOUBLE), -1) AS answer"))
def _(spark, sf):
    numbers = cleaning.cast_double(_blank_items(spark, sf), ["answer", "absent"])
    return numbers.fillna(-1, subset=["answer"])


@query("cast_integer", _messy_sql(
    "coalesce(TRY_CAST(trunc(TRY_CAST(answer AS DOUBLE)) AS INTEGER), -1) AS answer"
))
def _(spark, sf):
    numbers = cleaning.cast_integer(_blank_items(spark, sf), ["answer", "absent"])
    return numbers.fillna(-1, subset=["answer"])


@query("parse_date_safe", _messy_sql(
    """CASE pos WHEN 1 THEN day WHEN 2 THEN day || ' 08:30:05' WHEN 3 THEN day || ' 23:59:59'
    WHEN 4 THEN day ELSE 'NA' END AS moment"""
))
def _(spark, sf):
    return _messy(spark, sf).select(
        "id", "pos", shown(coercion.to_moment_text(F.col("moment"))).alias("moment")
    )


@query("parse_date", _messy_sql("CASE WHEN pos <= 4 THEN day ELSE 'NA' END AS date"))
def _(spark, sf):
    return _messy(spark, sf).select(
        "id", "pos", shown(coercion.to_date(F.col("moment"))).alias("date")
    )


@query("list_to_text", _messy_sql(
    "concat_ws(',', l_returnflag, CASE WHEN pos = 5 THEN 'NA' ELSE answer END, l_linestatus) AS items"
))
def _(spark, sf):
    listed = _messy(spark, sf).select(
        "id", "pos", F.array("l_returnflag", "answer", "l_linestatus").alias("items")
    )
    return cleaning.list_to_text(listed)


@query("multiselect_to_text", _messy_sql(
    """CASE WHEN pos = 7 OR pos % 3 = 0 THEN 'null'
    WHEN pos % 3 = 1 THEN CAST(part % 10 AS VARCHAR) || ',' || CAST(pos AS VARCHAR)
    ELSE CAST(part % 10 AS VARCHAR) END AS chosen"""
))
def _(spark, sf):
    first, second = (F.col("part") % 10).cast("string"), F.col("pos").cast("string")
    codes = F.slice(F.array(first, second), 1, F.when(F.col("pos") % 3 == 0, 0)
                    .when(F.col("pos") % 3 == 1, 2).otherwise(1))
    chosen = F.when(F.col("pos") != 7, codes)
    return cleaning.multiselect_to_text(
        _messy(spark, sf).select("id", "pos", chosen.alias("chosen")), "chosen"
    )


# --- structure -------------------------------------------------------------------------------


@query("flatten_struct", with_tables(
    """SELECT id AS _id, upper(validation_label) AS _validation_status_uid,
    validation_label AS _validation_status_label, '#fff' AS _validation_status_color FROM subs""",
    "subs",
))
def _(spark, sf):
    nested = star.submissions(spark, sf).select("_id", "_validation_status")
    return cleaning.flatten_struct(nested)


SUBMISSION_COLUMNS = "date, province, inspectorate, submission_time AS _submission_time"


@query("drop_repeats", with_tables(
    f"SELECT id AS _id, {SUBMISSION_COLUMNS}, 'submitted_via_web' AS _status, tags AS _tags FROM subs",
    "subs",
))
def _(spark, sf):
    flat = cleaning.drop_repeats(star.submissions(spark, sf)).drop("_validation_status")
    return cleaning.list_to_text(flat)


@query("normalize_names", with_tables(
    """SELECT caught AS nat_fishcatch_nat_catch, area AS nat_fishcatch_area_nat,
    kind AS nat_fishcatch_type_fishing, part AS nat_fishcatch_nat_fishtype FROM subs WHERE line < 6""",
    "subs",
))
def _(spark, sf):
    first = star.submissions(spark, sf).select(F.get("nat_fishcatch", 0).alias("e")).dropna()
    return cleaning.normalize_names(first.select("e.*"))


@query("select_present", with_tables("SELECT id AS _id, province, date FROM subs", "subs"))
def _(spark, sf):
    return cleaning.select_present(star.submissions(spark, sf), [*clean.KEYS, "no_such_column"])


@query("drop_columns", with_tables(
    "SELECT id, date, province, inspectorate, submission_time FROM subs", "subs"
))
def _(spark, sf):
    flat = cleaning.flatten_struct(cleaning.drop_repeats(star.submissions(spark, sf)))
    return cleaning.drop_columns(cleaning.normalize_names(flat), D.DROP_SUBMISSION)


@query("explode_repeat", with_tables(
    """SELECT id AS _id, CAST(e AS INTEGER) AS pos,
    CASE e WHEN 0 THEN CAST(line AS VARCHAR) ELSE 'NA' END AS amount,
    CASE e WHEN 0 THEN codes WHEN 1 THEN '' ELSE 'NA' END AS enforcement
    FROM subs, (SELECT unnest([0, 1, 2]) AS e) WHERE line < 6""",
    "subs",
))
def _(spark, sf):
    rows = explode_repeat(star.submissions(spark, sf), "patrol", ["_id"])
    return rows.select(
        "_id", "pos", shown("`patrol/amount`").alias("amount"),
        shown("`patrol/enforcement`").alias("enforcement"),
    )


@query("require_results", with_tables("SELECT id FROM subs", "subs"))
def _(spark, sf):
    payload = star.payload_texts(spark, sf).select(parse_submissions(F.col("payload")).alias("p"))
    return results_of(require_results(payload.select("p.*"))).select(F.col("_id").alias("id"))


@query("empty_if_absent", with_tables(
    "SELECT count(*) AS submissions, CAST(0 AS BIGINT) AS captures FROM subs", "subs"
))
def _(spark, sf):
    without = star.submissions(spark, sf).drop("nat_fishcatch")
    rows = clean.clean_capture(without)
    counts = without.select(F.lit(1).alias("s"), F.lit(0).alias("c")).unionAll(
        rows.select(F.lit(0), F.lit(1))
    )
    return counts.agg(F.sum("s").alias("submissions"), F.sum("c").alias("captures"))


# --- sinks -----------------------------------------------------------------------------------


@query("stringify_all", """SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(l_linenumber AS VARCHAR) AS pos,
    strftime(l_shipdate, '%Y-%m-%d') AS day, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS moment,
    CAST(l_quantity AS VARCHAR) AS quantity, l_returnflag AS flag FROM lineitem""")
def _(spark, sf):
    return cleaning.stringify_all(star.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"),
        F.col("l_shipdate").cast("date").alias("day"), F.col("l_shipdate").alias("moment"),
        F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"),
    ))


@query("ensure_columns", """SELECT n_name AS province_kh, n_nationkey AS ponds, 0 AS batches,
    0 AS "plastic soung" FROM nation""")
def _(spark, sf):
    counted = star.table(spark, sf, "nation").select(
        F.col("n_name").alias("province_kh"), F.col("n_nationkey").alias("ponds")
    )
    return cleaning.ensure_columns(counted, ["province_kh", *D.FACILITIES])


@query("report_layout", reporting.facilities_sql("TRUE", True))
def _(spark, sf):
    table = t10_facilities(star.tables(spark, sf))
    return sinks.report_layout(table, sinks.LAYOUT["t10_facilities"])


def _cells_sql(report: str, sql: str, columns: list[str]) -> str:
    cells = ", ".join(f'CAST("{c}" AS VARCHAR)' for c in columns)
    return f"SELECT '{report}' AS report, concat_ws('|', {cells}) AS cells FROM ({sql})"


YEARS = ["province_kh", "1997", "1998"]
BUNDLE = {
    "t02_dai": (reporting.province_years_sql(reporting.T02_ROWS, reporting.PAIR, D.DAI_PROVINCES), YEARS),
    "t03_fishery_domain": (
        reporting.province_years_sql(reporting.T03_ROWS, reporting.PAIR, D.PROVINCES), YEARS),
    "t04_rice_field": (
        reporting.province_years_sql(reporting.T04_ROWS, reporting.PAIR, D.PROVINCES), YEARS),
    "t05_marine_province": (reporting.province_years_sql(reporting.T05_ROWS, reporting.PAIR, None), YEARS),
    "t07_aquaculture": (
        reporting.aquaculture_sql("year IN (1997, 1998)", False),
        [D.PROVINCE_HEADING, *D.SPECIES.values(), D.TOTAL]),
    "t08_enforcement": (
        reporting.enforcement_sql("year IN (1997, 1998)"), ["province_kh", *D.OUTCOMES.values()]),
    "t10_facilities": (
        reporting.facilities_sql("year IN (1997, 1998)", True), ["province_kh", *D.FACILITIES]),
}
SPECIES = {
    "t06_marine_species": reporting.species_sql(f"{reporting.T05_ROWS} AND year = 1998", D.TOP_SPECIES),
    "t06_species_detail": reporting.species_sql("year = 1998", None),
}
BUNDLE_SQL = "\nUNION ALL ".join(
    [_cells_sql(name, *made) for name, made in BUNDLE.items()]
    + [
        f"""SELECT '{name}', fish_name_kh || '|' || province_kh || '|' || CAST(catch AS VARCHAR)
            || '|' || CAST(total AS VARCHAR) FROM ({sql})"""
        for name, sql in SPECIES.items()
    ]
    + [
        f"""SELECT '{name} rows', CAST({sinks.LAYOUT[name][0].start_row} - 1
            + row_number() OVER (ORDER BY total DESC, fish_name_kh) AS VARCHAR) || '|' || fish_name_kh
        FROM (SELECT DISTINCT fish_name_kh, total FROM ({sql}))"""
        for name, sql in SPECIES.items()
    ]
)


@query("write_report_bundle", BUNDLE_SQL)
def _(spark, sf):
    """Writes the nine sheets to the shared folder and reads them back."""
    reports = report_bundle(star.tables(spark, sf), Filters(year=1998))
    out = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    written = sinks.write_report_bundle(reports, out, datetime.date(1998, 12, 31), "parquet")
    lines = []
    for name, folder in written.items():
        sheet = spark.read.parquet(folder)
        columns = [c for c in sheet.columns if c != "sheet_row"]
        if name not in BUNDLE:  # every cell of the sheet that isn't 0, and the row each species is in
            rows = sheet.select(F.concat_ws("|", "sheet_row", "fish_name_kh").alias("cells"))
            lines.append(rows.select(F.lit(f"{name} rows").alias("report"), "cells"))
            provinces = [c for c in columns if c not in ("fish_name_kh", D.TOTAL)]
            sheet = sheet.unpivot(["fish_name_kh", D.TOTAL], [f"`{c}`" for c in provinces], "province_kh", "catch")
            sheet, columns = sheet.where("catch <> '0'"), ["fish_name_kh", "province_kh", "catch", D.TOTAL]
        cells = F.concat_ws("|", *[F.col(f"`{c}`") for c in columns])
        lines.append(sheet.select(F.lit(name).alias("report"), cells.alias("cells")))
    return reduce(DataFrame.unionAll, lines)


# --- the whole path --------------------------------------------------------------------------

# The survey tables as they come out of submissions: the first element of each group, and none
# where the form has no such group.
_OF_SUBMISSIONS = {
    "capture0": """SELECT id, 0 AS pos, {calendar}, province, CAST(caught AS DOUBLE) AS catch, area AS area_code,
        kind AS fishing_type, part AS fish_code FROM ({subs}) WHERE line < 6""",
    "aqu0": """SELECT id, 0 AS pos, {calendar}, province, CAST(caught AS DOUBLE) AS catch, area AS area_code,
        aqu_type, part AS fish_code FROM ({subs}) WHERE line < 6""",
    "processing0": """SELECT id, 0 AS pos, {calendar}, province, 0.0 AS processing_amount, kind AS proc_code,
        area AS area_code FROM ({subs}) WHERE line < 6""",
    "patrol0": """SELECT id, 0 AS pos, {calendar}, province, 0.0 AS patrol_amountcrime,
        codes AS patrol_enforcement FROM ({subs}) WHERE line < 6""",
}


def of_submissions(sql: str) -> str:
    """A report's SQL over the submissions instead of the typed tables."""
    for name, body in _OF_SUBMISSIONS.items():
        own = body.format(calendar=sql_calendar("CAST(date AS DATE)"), subs=TABLES["subs"])
        sql = sql.replace(TABLES[name], own.replace("AS date,", "AS day,", 1))
    return sql


def _whole_path(spark, sf) -> StagedTables:
    """JSON files to staged tables."""
    raw = stage_submissions(read_submissions(spark, landed_lines(spark, sf), lines=True), landing_folder(spark))
    cleaned = clean.clean_all(raw)
    codes = Codebook.measured(star.choices(spark, sf))
    tables = SurveyTables.of_cleaned(
        codes, capture=cleaned.nat, aquaculture=cleaned.aqu, processing=cleaned.processing, patrol=cleaned.patrol
    )
    folder = landing_folder(spark)
    stage_tables(tables, folder)
    return StagedTables(spark, folder, codes)


@query("whole_path__t04", of_submissions(reporting.province_years_sql(
    reporting.T04_ROWS, reporting.PAIR, D.PROVINCES, "quarter = 'Q1'")))
def _(spark, sf):
    return t04_rice_field(_whole_path(spark, sf), Filters(year=1998, quarter="Q1"))


@query("whole_path__t08", of_submissions(reporting.enforcement_sql("year IN (1997, 1998)")))
def _(spark, sf):
    return t08_enforcement(_whole_path(spark, sf), Filters(year=1998))


@query("whole_path__t10", of_submissions(reporting.facilities_sql("year IN (1997, 1998)", True)))
def _(spark, sf):
    return t10_facilities(_whole_path(spark, sf), Filters(year=1998))



"""The star-schema test tables in the shape of cleaned survey tables.

A line item is a catch of its order, an order a processing answer, an event a patrol.  Each
survey table comes from one fact table without a join; the code lists come from the dimensions.
Province code 0 and some parts have no label, so that labels fall back to codes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtally import domains as D
from fieldtally.functions.answers import text_list
from fieldtally.operators.lookups import (
    AREA_LIST,
    FISH_LIST,
    PROCESSED_LIST,
    PROVINCE_LIST,
    Codebook,
    code_list,
)
from fieldtally.plans.typed import SurveyTables
from fieldtally.sources.submissions import REPEAT_FIELDS, SUBMISSION

# Answers to the aquaculture type question, by line number.
TYPE_ANSWERS = {
    1: "pond",
    2: "Ponds_batch",
    3: "plastic-soung",
    4: " batches  Pond ",
    5: "other",
    6: "",
}


# Columns of the given tables that are read here.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; with its schema stated, no file is opened to plan a query."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _province(key: str) -> Column:
    return (F.col(key) % 26).cast("string")


def _area(flag: str, fresh: str) -> Column:
    return F.when(F.col(flag) == fresh, D.AREA_FRESH).otherwise(D.AREA_MARINE)


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    kind = F.when(flag == "R", D.TYPE_DAI).when(flag == "A", D.TYPE_DOMAIN)
    return items.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_shipdate").alias("date"),
        _province("l_suppkey").alias("province"),
        ((F.col("l_quantity") - 3) / 2).alias("nat_fishcatch_nat_catch"),
        _area("l_linestatus", "O").alias("nat_fishcatch_area_nat"),
        kind.otherwise(D.TYPE_RICE_FIELD).alias("nat_fishcatch_type_fishing"),
        F.col("l_partkey").cast("string").alias("nat_fishcatch_nat_fishtype"),
    )


def species_code(key: str, flag: str) -> Column:
    """Two-digit codes, for some rows with the letters of the second numbering."""
    number = (F.col(key) % 100).cast("string")
    lettered = F.concat(F.lit("FM"), F.lpad(number, 3, "0"))
    return F.when(F.col(flag) == "R", lettered).otherwise(number)


def type_answer(line: str) -> Column:
    answer = F.lit(None).cast("string")
    for number, text in TYPE_ANSWERS.items():
        answer = F.when(F.col(line) == number, F.lit(text)).otherwise(answer)
    return answer


def aquaculture(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_shipdate").alias("date"),
        _province("l_suppkey").alias("province"),
        (F.col("l_quantity") / 2 - 1).alias("aqu_fishcatch_aqu_catch"),
        _area("l_linestatus", "O").alias("aqu_fishcatch_area_aqu"),
        type_answer("l_linenumber").alias("aqu_fishcatch_aqu_type"),
        species_code("l_partkey", "l_returnflag").alias("aqu_fishcatch_aqu_fishtype"),
    )


def processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.lit(0).alias("pos"),
        F.col("o_orderdate").alias("date"),
        _province("o_custkey").alias("province"),
        F.col("o_totalprice").alias("processing_amountprocessing"),
        F.substring("o_orderpriority", 1, 1).alias("processing_typeprocessing"),
        _area("o_orderstatus", "F").alias("processing_area_pro"),
    )


def patrol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in an event's properties gives two outcome codes."""
    number = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    codes = F.concat_ws(" ", F.floor(number / 10).cast("string"), (number % 10).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.lit(0).alias("pos"),
        F.col("ts").alias("date"),
        _province("user_id").alias("province"),
        F.col("value").alias("patrol_amount"),
        codes.alias("patrol_enforcement"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested submissions in the form's own schema: one per line item, answers as text.

    Line 6 has empty repeat groups and line 7 none at all; line 2 pads its province code.
    """
    return _nested(table(spark, sf_dir, "lineitem"))


def _nested(items: DataFrame, *kept: str) -> DataFrame:
    line = F.col("l_linenumber")
    day = F.col("l_shipdate").cast("date").cast("string")
    none = F.lit(None).cast("string")
    province = _province("l_suppkey")

    def group(name: str, *elements: tuple[Column, ...]) -> Column:
        fields = REPEAT_FIELDS[name]
        rows = [F.struct(*[v.alias(f) for f, v in zip(fields, e)]) for e in elements]
        return F.when(line < 6, F.array(*rows)).when(line == 6, F.slice(F.array(*rows), 1, 0))

    caught = ((F.col("l_quantity") - 3) / 2).cast("string")
    area = _area("l_linestatus", "O")
    part = F.col("l_partkey").cast("string")
    kind = F.translate("l_returnflag", "RAN", "123")
    codes = F.concat_ws(" ", (F.col("l_partkey") % 10).cast("string"), line.cast("string"))
    return items.select(
        *kept,
        (F.col("l_orderkey") * 8 + line).alias("_id"),
        day.alias("date"),
        F.when(line == 2, F.lpad(province, 2, "0")).otherwise(province).alias("province"),
        F.when(line == 3, "none").otherwise(line.cast("string")).alias("inspectorate"),
        F.when(line == 4, day)
        .when(line == 5, F.lit("unknown"))
        .otherwise(F.concat(day, F.lit("T08:30:05")))
        .alias("_submission_time"),
        F.lit("submitted_via_web").alias("_status"),
        F.struct(
            F.col("l_linestatus").alias("uid"),
            F.lower("l_linestatus").alias("label"),
            F.lit("#fff").alias("color"),
        ).alias("_validation_status"),
        F.array("l_returnflag", "l_linestatus").alias("_tags"),
        group("nat_fishcatch", (caught, area, kind, part), (none, F.lit(""), kind, none))
        .alias("nat_fishcatch"),
        group("aqu_fishcatch", (caught, area, type_answer("l_linenumber"), part))
        .alias("aqu_fishcatch"),
        group("processing", (caught, kind, area), (F.lit(""), kind, none)).alias("processing"),
        group("patrol", (line.cast("string"), codes), (none, F.lit("")), (none, none))
        .alias("patrol"),
    )


def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submissions as JSON payloads of one submission each."""
    one = F.to_json(F.struct(F.array(F.struct("*")).alias("results")))
    return submissions(spark, sf_dir).select(one.alias("payload"))


def line_texts(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """The submissions as JSON, one in a row, with more answers than the reports need."""
    return submissions(spark, sf_dir).select(F.to_json(F.struct("*", *more)).alias("value"))


def page_lines(spark: SparkSession, sf_dir: str, size: int = 2000) -> DataFrame:
    """The submissions as JSON payloads of up to ``size``: the lines of each page in their order, with its number.

    Written by ``page`` they are a file for each page.  The items are dealt by page before they
    become JSON, and no page is held as one text.
    """
    page = F.floor((F.col("l_orderkey") * 8 + F.col("l_linenumber")) / size)
    items = table(spark, sf_dir, "lineitem").withColumn("page", page).repartition("page")
    own = Window.partitionBy("page").orderBy("l_orderkey", "l_linenumber")
    items = items.withColumns({"first": F.row_number().over(own) == 1, "last": F.lead(F.lit(False), 1, True).over(own)})
    one = F.to_json(F.struct(*[F.col(c) for c in SUBMISSION.names]))
    value = F.concat(
        F.when(F.col("first"), '{"results":[').otherwise(","), one, F.when(F.col("last"), "]}").otherwise("")
    )
    return _nested(items, "page", "first", "last").select("page", value.alias("value"))


def _choice_rows(df: DataFrame, name: str, code: Column, kh: Column, en: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("list_name"),
        code.cast("string").alias("name"),
        kh.alias("label_khmer"),
        en.alias("label_english"),
    )


def province_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("n_nationkey") + 1
    official = F.element_at(text_list(D.PROVINCES), place)
    nation = table(spark, sf_dir, "nation")
    return _choice_rows(nation, PROVINCE_LIST, place, official, F.col("n_name"))


def fish_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where(F.col("p_size") != 50)
    return _choice_rows(part, FISH_LIST, F.col("p_partkey"), F.col("p_name"), F.upper("p_name"))


def processed_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    name = F.col("r_name")
    return _choice_rows(region, PROCESSED_LIST, F.col("r_regionkey"), F.lower(name), name)


def area_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = spark.sql(
        "SELECT * FROM VALUES ('1', 'ទឹកសាប', 'Inland Fresh'), ('2', 'សមុទ្រ', 'Marine')"
        " AS t(code, kh, en)"
    )
    return _choice_rows(areas, AREA_LIST, F.col("code"), F.col("kh"), F.col("en"))


LISTS = {
    PROVINCE_LIST: province_choices,
    FISH_LIST: fish_choices,
    PROCESSED_LIST: processed_choices,
    AREA_LIST: area_choices,
}


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provinces from nations, species from parts, kinds of processing from regions, two areas."""
    return reduce(DataFrame.unionAll, [build(spark, sf_dir) for build in LISTS.values()])


class StarCodebook(Codebook):
    """The lists above, built when asked for.  Each comes from a key: no code occurs twice."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf_dir = spark, sf_dir
        self.repeated = frozenset()

    def list(self, list_name: str) -> DataFrame:
        return code_list(LISTS[list_name](self._spark, self._sf_dir), list_name)


FACTS = {
    "capture": capture,
    "aquaculture": aquaculture,
    "processing": processing,
    "patrol": patrol,
}


def codebook(spark: SparkSession, sf_dir: str) -> Codebook:
    return StarCodebook(spark, sf_dir)


def tables(spark: SparkSession, sf_dir: str) -> SurveyTables:
    return SurveyTables(lambda name: FACTS[name](spark, sf_dir), codebook(spark, sf_dir))

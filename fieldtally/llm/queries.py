"""The operators as queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import language, line_dedup, quality, urls
from fieldtally.llm.alignment import align_documents
from fieldtally.llm.bpe import encode_documents
from fieldtally.llm.common import held_out, table
from fieldtally.llm.decontaminate import find_contamination
from fieldtally.llm.jaccard import components
from fieldtally.llm.licenses import scan_licenses
from fieldtally.llm.minhash import near_duplicates
from fieldtally.llm.token_count import count_tokens
from fieldtally.llm.top_k import top_k
from fieldtally.llm.whitening import whiten

QUERIES = {}
SQL: dict[str, str] = {}


def register(function, sql: str | None = None):
    QUERIES[function.__name__] = function
    if sql is not None:
        SQL[function.__name__] = sql
    return function


@register
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text; the ids are decoded by the same vocabulary."""
    encoded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@register
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they are more than a context of 4096."""
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@register
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages learned from two thirds of the documents, predicted for all."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


@register
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality learned from the labels of two thirds of the documents, scored for all."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = ~F.coalesce(held_out(), F.lit(False))
    model = quality.fit(labels.where(learned).select("doc_id", "quality").join(docs.where(learned).select("doc_id", "text"), "doc_id"))
    found = quality.score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


RULE_SQL = """CASE
    WHEN suffix('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN suffix('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN suffix('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN suffix('.' || host, '.net') AND starts_with(path, '/') THEN 'net/'
END"""


def terms_sql(terms: tuple[str, ...]) -> str:
    """How many of the terms stand alone in a URL."""
    one = "CAST(regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9]){}([^a-z0-9]|$)') AS INT)"
    return " + ".join(one.format(term) for term in terms)


@partial(
    register,
    sql=rf"""
    WITH parts AS (
        SELECT *,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
        FROM pages
    ), ruled AS (
        SELECT *, {RULE_SQL} AS rule, {terms_sql(urls.STRICT)} AS n_strict, {terms_sql(urls.SOFT)} AS n_soft FROM parts
    )
    SELECT page_id, host, path, rule, n_strict, n_soft,
        CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN n_strict >= 1 OR n_soft >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled""",
)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by its URL."""
    judged = urls.filter_urls(table(spark, sf_dir, "pages"))
    counts = [F.size(c).alias(n) for c, n in (("strict_terms", "n_strict"), ("soft_terms", "n_soft"))]
    return judged.select("page_id", "host", "path", "rule", "verdict", *counts)


@partial(
    register,
    sql=rf"""
    WITH each AS (
        SELECT doc_id, source, md5(text) AS text_key,
            unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
        FROM documents
    ), keyed AS (
        SELECT *, regexp_replace(line, '^[ \t\r\f\x0b]+|[ \t\r\f\x0b]+\z', '', 'g') AS stripped,
            regexp_matches(line, '^[ \t\r\f\x0b]*([^ \t\r\f\x0b]+[ \t\r\f\x0b]+){{{line_dedup.MIN_WORDS - 1}}}[^ \t\r\f\x0b]') AS counts
        FROM each
    ), spread AS (
        SELECT stripped FROM keyed WHERE counts
        GROUP BY stripped HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}
    ), judged AS (
        SELECT k.*, s.stripped IS NOT NULL AND row_number() OVER (
            PARTITION BY k.stripped ORDER BY doc_id NULLS FIRST, text_key, pos) > 1 AS gone
        FROM keyed k LEFT JOIN spread s ON k.counts AND k.stripped = s.stripped
    )
    SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
    FROM judged GROUP BY doc_id""",
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


@register
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten successive words of a benchmark item."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.array_size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@register
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every row for the rows whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@register
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of three-word shingles are at least 90 % alike."""
    return components(table(spark, sf_dir, "documents"), n=3, percent=90)


@register
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every document: a row for each place, and one with nulls for a document without any."""
    found = scan_licenses(table(spark, sf_dir, "documents"), every=True)
    return found.select("doc_id", F.explode_outer("licenses").alias("found")).select(
        "doc_id",
        F.col("found.name").alias("license"),
        F.round("found.coverage", 6).alias("coverage"),
        F.col("found.first").alias("first_word"),
        F.col("found.last").alias("last_word"),
    )


@register
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 principal components of every vector, in units of their standard deviation."""
    return whiten(table(spark, sf_dir, "embeddings"), most=32)


@register
def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of two-word shingles are at least 80 % alike, and which of each stays."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


@register
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two vocabularies over every document."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_documents(table(spark, sf_dir, "documents"), *paths, digest=True).withColumnRenamed("groups", "groups_sha256")

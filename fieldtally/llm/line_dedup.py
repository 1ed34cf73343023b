"""Line dedup by distinct-site spread, DataFrame functions only.

Boilerplate is a line that stands on many sites. Each line's hash gets a HyperLogLog sketch of the
sites it is on; sketches merge in partial and final aggregation, so a line in a third of all
documents is one small sketch per task before the shuffle. Where the estimate is near the
threshold, the sites are counted exactly. Each boilerplate line is kept once, where it comes
first, and taken out everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import packed, written

#: Sites a line is on, at least, and words it has, at least, to be boilerplate: all but blank lines are judged.
MIN_SITES, MIN_WORDS = 6, 1
#: Sketches have 2^LG_K registers. An estimate is off by 1.04 / sqrt(2^LG_K) in the usual case, 3 %
#: here; between the threshold less and plus NEAR of it, five times that and more, sites are counted.
LG_K, NEAR = 10, 0.2
SPACE = r"[ \t\r\f\x0b]"


def lines(text: Column) -> Column:
    """The lines of a text, as they are; none for null."""
    return F.split(text, "\n")


def key(line: Column) -> Column:
    """128 bits of a line without the white space around it."""
    return F.unhex(F.md5(stripped(line)))


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{SPACE}+|{SPACE}+\z", "")


def counts(line: Column, min_words: int) -> Column:
    """Whether a line is long enough to be boilerplate."""
    word = SPACE.replace("[", "[^")
    return line.rlike(rf"^{SPACE}*({word}+{SPACE}+){{{max(0, min_words - 1)}}}{word}")


def exploded(docs: DataFrame, min_words: int) -> DataFrame:
    """``text_key, doc_id, site, pos, line_key`` of each line that is long enough."""
    each = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("site"),
        F.unhex(F.md5("text")).alias("text_key"),
        F.posexplode(lines(F.col("text"))).alias("pos", "line"),
    )
    return each.where(counts(F.col("line"), min_words)).select("doc_id", "site", "text_key", "pos", key(F.col("line")).alias("line_key"))


def boilerplate(each: DataFrame, min_sites: int) -> DataFrame:
    """``line_key, first`` of the lines on ``min_sites`` sites or more; ``first`` is where the line is kept."""
    spread = each.groupBy("line_key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"),
        F.min(F.struct("doc_id", "text_key", "pos")).alias("first"),
    )
    spread = written(spread.where(F.col("sites") >= min_sites * (1 - NEAR)))
    sure = F.col("sites") > min_sites * (1 + NEAR)
    near = spread.where(~sure)
    pairs = each.where(F.col("site").isNotNull()).select("line_key", "site")
    exact = pairs.join(near.select("line_key"), "line_key", "left_semi").groupBy("line_key", "site").agg(F.lit(1).alias("one"))
    enough = exact.groupBy("line_key").agg(F.sum("one").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where(sure).select("line_key", "first").unionByName(
        near.join(enough.select("line_key"), "line_key").select("line_key", "first")
    )


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines``, ``n_removed`` as columns added.

    ``docs`` has ``doc_id, text, source``. A line is compared without the white space around it;
    one of fewer than ``min_words`` words, by default a blank one, is never boilerplate. A line on ``min_sites`` different
    sources or more stays at its first place, by smallest ``doc_id`` (missing ids before all),
    then text, then position, and goes elsewhere. Rows repeated whole have the same first place,
    and keep it alike. A null source is no site. A null or empty text stays as it is, with 0 lines for
    null; a text all of whose lines go becomes empty. Very long texts are judged whole, line by line; an empty table
    gives an empty one. Columns of the input keep their names and
    values, also those called as ours inside; ``n_lines`` and ``n_removed`` of the input are
    replaced.
    """
    each = exploded(docs, min_words)
    found = each.join(boilerplate(each, min_sites), "line_key")
    found = found.where(~F.struct("doc_id", "text_key", "pos").eqNullSafe(F.col("first")))
    gone = found.groupBy(place(F.col("doc_id"), F.col("text_key")).alias("at")).agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(packed(docs)).withColumn("here", place(F.col("row.doc_id").cast("long"), F.unhex(F.md5("row.text"))))
    joined = rows.join(gone, F.col("here") == F.col("at"), "left")
    split = lines(F.col("row.text"))
    kept = F.filter(split, lambda line, i: ~F.array_contains(F.col("gone"), i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    added = ("n_lines", "n_removed")
    columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in added]
    return joined.select(
        *columns,
        F.coalesce(F.array_size(split), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def place(doc_id: Column, text_key: Column) -> Column:
    """Rows with the same id and text lose the same lines, so this stands for them; null without a text."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"), F.lit(":").cast("binary"), text_key)

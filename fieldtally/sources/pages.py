"""Payload pages of any size, taken apart by many tasks.

A page is cut at each closing brace, by byte ranges of its file, and pieces that follow each other
are held together in blocks.  Where a block stands follows from the blocks before it: whether it
begins inside a string, from the quotes, and how deep it is nested, from braces and brackets outside
strings.  Both are running sums over blocks, of what is left of their texts without strings.  The
pieces between two ends of elements of ``results`` are an element; only those that cross the end of
a block are put together again by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtally.session import listed

#: Bits of a piece's number within its block: blocks are of up to 4096 pieces.
BLOCK_BITS = 12


def page_elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, page, text``: the elements of ``results`` of each page, as texts, in their places.

    ``page`` says what is wrong with what is no element: the rest of a torn page, or a page without
    ``results``, its beginning as ``text``.  Elements that are no objects come without place, with
    what stands between them, as they can't be submissions.  Of the page's other answers none may
    be an array of objects.  Files may be compressed; one whose codec can't be split is one range.
    """
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "start"))]
    pieces = listed(spark, lambda: spark.read.text(path, lineSep="}")).select(*meta, F.monotonically_increasing_id().alias("i"), F.col("value").alias("text"))
    part = F.struct("i", "text")
    blocks = pieces.groupBy("file", "start", F.shiftright("i", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    blocks = blocks.select("file", "start", "block", F.col("parts.text").alias("texts"))
    joined = blocks.join(_placed(blocks, _braces(spark, path)), ["file", "start", "block"])

    last = F.size("ends")

    def stretch(j: Column) -> Column:
        """The pieces from one end to the next, before the first one and behind the last one too."""
        start, stop = F.when(j == 0, 0).otherwise(F.get("ends", j - 1) + 1), F.when(j < last, F.get("ends", j)).otherwise(F.size("texts") - 1)
        closed = (stop < F.size("texts") - 1) | F.col("closed")
        text = F.concat(F.array_join(F.slice("texts", start + 1, stop - start + 1), "}"), F.when(closed, "}").otherwise(""))
        # behind an end there may be nothing more in the block
        return F.when(stop >= start, F.struct((F.col("pos") + j).alias("pos"), (j < last).cast("int").alias("whole"), text.alias("text")))

    # both of the same columns, so that what they come from is made once
    inner = F.transform(F.when(last > 1, F.sequence(F.lit(1), last - 1)), stretch)
    inner = joined.select("file", "open", F.explode(inner).alias("f")).select("file", "f.pos", "f.whole", "open", "f.text")
    outer = F.array_compact(F.transform(F.when(last > 0, F.array(F.lit(0), last)).otherwise(F.array(F.lit(0))), stretch))
    outer = joined.select("file", "start", "block", "open", F.explode(outer).alias("f"))
    part = F.struct("start", "block", "f.text")
    elements = outer.groupBy("file", F.col("f.pos").alias("pos")).agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.max("f.whole").alias("whole"), F.max_by("open", F.struct("start", "block")).alias("open")
    )
    elements = elements.select("file", "pos", "whole", "open", F.array_join("parts.text", "").alias("text")).unionByName(inner)
    elements = elements.withColumns({"pos": F.col("pos").cast("int"), "first": F.col("pos") == 0})
    head = r'(?s)^.*?"results"\s*:\s*\['
    named = ~F.col("first") | F.col("text").rlike(head)
    text = F.when(F.col("first"), F.regexp_replace("text", head, "")).otherwise(F.col("text"))
    elements = elements.select("file", "pos", "whole", "open", named.alias("named"), F.regexp_replace(text, r"(?s)^\s*,\s*|^\s+", "").alias("text"))
    return _records(elements)


def _braces(spark: SparkSession, path: str) -> DataFrame:
    """How many braces close in each file, counted between other separators, as the sizes of compressed files don't tell."""
    between = listed(spark, lambda: spark.read.text(path, lineSep="{")).select(F.col("_metadata.file_path").alias("file"), _count("value", "}").alias("braces"))
    return between.groupBy("file").agg(F.sum("braces").alias("braces"))


def _placed(blocks: DataFrame, braces: DataFrame) -> DataFrame:
    """``file, start, block, pos, ends, open, closed``: where elements end in each block, and the place of the first to end there.

    ``open`` is how deep the page is nested behind the block, ``closed`` whether a brace stands behind its last piece.
    Only what is left of a text without its strings, a fiftieth or so, is carried by the windows.
    """
    plain = '[^"{}\\[\\]\\\\]'
    # strings without braces and brackets change nothing, whether what is taken for one stands inside or between
    pair = f'{plain}*+"{plain}*+"'
    bare = F.regexp_replace(F.array_join("texts", "}"), f'{pair}{pair}|{pair}|{plain}++|\\\\[^}}]|\\\\', "")
    own = Window.partitionBy("file").orderBy("start", "block")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.select("file", "start", "block", F.size("texts").alias("pieces"), bare.alias("bare"))
    # few bytes, and much to do for each
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file").join(braces, "file")
    # a piece without a brace behind it ends the file, which then has a brace less than pieces
    pieces = F.sum("pieces").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("closed", F.lead("block").over(own).isNotNull() | (pieces <= F.col("braces")))
    rows = rows.withColumn("bare", F.concat("bare", F.when(F.col("closed"), "}").otherwise("")))
    quotes = F.coalesce(F.sum(_count("bare", '"')).over(earlier), F.lit(0))
    rows = rows.withColumn("bare", F.when(quotes % 2 == 1, F.concat(F.lit('"'), "bare")).otherwise(F.col("bare")))
    short = F.replace(F.col("bare"), F.lit('""'), F.lit(""))
    strings = F.transform(F.split("bare", '"'), lambda x, j: F.when(j % 2 == 1, F.translate(x, "}{[]", "x")).otherwise(x))
    # a brace in a string ends a piece, but nothing else
    rows = rows.withColumn("bare", F.when(short.contains('"'), F.array_join(strings, "")).otherwise(short))
    deep = {"braces": _count("bare", "{") - _count("bare", "}"), "brackets": _count("bare", "[") - _count("bare", "]")}
    before = {f"{c}_before": F.coalesce(F.sum(x).over(earlier), F.lit(0)).cast("int") for c, x in deep.items()}
    rows = rows.withColumns(before)
    rows = rows.withColumn("open", sum((F.col(f"{c}_before") + x for c, x in deep.items()), F.lit(0)))
    start = F.struct(F.lit(0).alias("j"), F.col("braces_before").alias("b"), F.col("brackets_before").alias("k"), F.array().cast("array<int>").alias("ends"))

    def step(state: Column, piece: Column) -> Column:
        closes = F.when(piece.endswith("}"), 1).otherwise(0)
        b = state["b"] + _count(piece, "{") - closes
        k = state["k"] + _count(piece, "[") - _count(piece, "]")
        # the end of an element: its brace leaves the page's object and one array open
        end = (closes == 1) & (b == 1) & (k == 1)
        ends = F.when(end, F.concat(state["ends"], F.array(state["j"]))).otherwise(state["ends"])
        return F.struct((state["j"] + 1).alias("j"), b.alias("b"), k.alias("k"), ends.alias("ends"))

    ends = F.aggregate(F.split("bare", "(?<=[}x])"), start, step)["ends"]
    rows = rows.withColumn("ends", ends)
    place = F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0))
    return rows.withColumn("pos", place.cast("int")).select("file", "start", "block", "pos", "ends", "open", "closed")


def _records(elements: DataFrame) -> DataFrame:
    """An element for each whole one, what stands before it if that is no object, and what is wrong."""
    # up to the element, or behind the last one to the end of the array
    before = F.when(F.col("whole") == 1, F.regexp_extract("text", r"(?s)^[^{]*", 0)).when(F.col("open") == 0, F.regexp_extract("text", r"(?s)^[^\]]*", 0))
    before = F.coalesce(before, F.lit(""))
    others = F.regexp_replace(F.regexp_replace(before, r"\bnull\b", ""), r"[\s,\]]", "")
    shown = lambda pos, page, text: F.struct(pos.alias("pos"), page.alias("page"), text.alias("text"))
    none, no_place = F.lit(None).cast("string"), F.lit(None).cast("int")
    whole = F.col("named") & (F.col("whole") == 1)
    found = F.array(
        F.when(whole, shown(F.col("pos"), none, F.expr("substring(text, length(regexp_extract(text, '(?s)^[^{]*', 0)) + 1)"))),
        F.when(F.col("named") & (others != ""), shown(no_place, F.lit("elements are no submissions in "), F.trim(before))),
        F.when(~F.col("named"), shown(no_place, F.lit("a page has no results in "), F.substring("text", 1, 1000))),
        F.when(
            F.col("named") & (F.col("whole") == 0) & (F.col("open") != 0),
            shown(no_place, F.lit("a page of submissions can't be read in "), F.col("text")),
        ),
    )
    found = elements.select("file", F.explode(F.array_compact(found)).alias("r"))
    return found.select("file", "r.pos", "r.page", "r.text")


def _count(column: Column | str, character: str) -> Column:
    text = F.col(column) if isinstance(column, str) else column
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))

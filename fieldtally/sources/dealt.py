"""Tables kept dealt by a code, for code lists too large to broadcast.

Rows and list are written once, in the same buckets of the code and a salt; a join of the two then
reads bucket by bucket, and no row of either side is shuffled, however often labels are asked for.
The salt spreads a code that many rows have over several buckets; the list, which has few rows of
a code, stands in each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.lookups import label_fallback

BUCKETS, SALTS = 64, 8
#: Columns that only dealt tables have: the code, also where it is missing, and the salt.
KEY, SALT = "__key", "__salt"


def _key(code: str):
    """A missing code is a value of its own, since it matches a missing one of the list."""
    return F.coalesce(F.concat(F.lit("="), F.col(code).cast("string")), F.lit(""))


def _write(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    # dealt as the buckets are, so that each is one file
    dealt = df.repartition(buckets, KEY, SALT).sortWithinPartitions(KEY, SALT)
    writer = dealt.write.mode("overwrite").bucketBy(buckets, KEY, SALT).sortBy(KEY, SALT)
    writer.option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def deal_rows(df: DataFrame, code: str, table: str, path: str, buckets: int = BUCKETS, salts: int = SALTS) -> DataFrame:
    """Writes a typed table, with ``id`` and ``pos``, dealt by one of its codes, as a table of the catalog."""
    salt = F.pmod(F.xxhash64("id", "pos"), F.lit(salts)).cast("int")
    return _write(df.withColumns({KEY: _key(code), SALT: salt}), table, path, buckets)


def deal_list(lookup: DataFrame, code: str, table: str, path: str, buckets: int = BUCKETS, salts: int = SALTS) -> DataFrame:
    """Writes a code list in the buckets of rows dealt by the same code, once for each salt."""
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return _write(lookup.withColumns({KEY: _key(code), SALT: every}).drop(code), table, path, buckets)


def label_dealt(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows with the list's labels, as `lookup_left_join` and `label_fallback` give them, without a shuffle."""
    joined = rows.join(listed.hint("merge"), [KEY, SALT], "left").drop(KEY, SALT)
    return label_fallback(joined)

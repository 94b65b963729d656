"""Bloom filters as tables, for anti-joins against a set of ids that keeps growing.

Spark plans no runtime filter for an anti-join: every row is shuffled to meet the ids, though few are
among them.  Here a filter of a fixed number of bits is kept as a table of bitmaps (one row a
bucket of 32,768 bits, the block that both bits of an id lie in).  Rows whose bits are not set
cannot be among the ids and pass at once; only the others meet them in the exact anti-join, so
false positives cost a shuffle and change nothing.

Filters of different runs over the same number of buckets merge by OR, so a ledger run stores its own
once and no id is read again to extend the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32_768  # bits of one bitmap of the ``bitmap_*`` functions
BUCKETS = 2048  # 8 MB of bitmaps, 67 million bits: a bound of what is broadcast


def _place(key: str, buckets: int) -> tuple[Column, list[Column]]:
    """(bucket, two bit positions in it) of an id."""
    h = F.xxhash64(F.col(key))
    bucket = F.pmod(h, F.lit(buckets)).cast("int")
    bits = [F.pmod(F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(i)), 8), F.lit(BITS)).cast("int") for i in (1, 2)]
    return bucket, bits


def bloom_table(ids: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, bitmap): the filter of the non-null ``key`` values; at most ``buckets`` rows of 4 KB."""
    bucket, bits = _place(key, buckets)
    rows = ids.where(F.col(key).isNotNull()).select(bucket.alias("bucket"), F.explode(F.array(*bits)).alias("bit"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def merge_blooms(tables: DataFrame) -> DataFrame:
    """The filter of several runs, from the union of their tables."""
    return tables.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _is_set(bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, bit.bitwiseAND(7)).bitwiseAND(1) == 1


def maybe_in(df: DataFrame, bloom: DataFrame, key: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with the flag ``out``: false only for rows whose ``key`` is certainly not in the filter."""
    bucket, bits = _place(key, buckets)
    hit = F.coalesce(_is_set(bits[0]) & _is_set(bits[1]), F.lit(False))
    side = F.broadcast(bloom.select(F.col("bucket").alias("_bucket"), "bitmap"))
    return df.withColumn("_bucket", bucket).join(side, "_bucket", "left").withColumn(out, hit).select(*[F.col(c) for c in df.columns], out)


def exclude_filtered(df: DataFrame, ids: DataFrame, key: str, bloom: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids``: the exact anti-join, of only the rows that the
    filter of ``ids`` lets through.  Rows without a key are kept, as by ``exclude``."""
    told = maybe_in(df, bloom, key, "_maybe", buckets)
    away = told.where(~F.col("_maybe")).drop("_maybe")
    near = told.where("_maybe").drop("_maybe").join(ids.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return away.unionByName(near.select(*df.columns))

"""Window-style operators: newest-first numbering, duplicate numbering, oversized groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import number_within


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def rank_latest(df: DataFrame, key: str, order: list, out: str = "rn_desc") -> DataFrame:
    """Number every row inside its ``key`` group in ``order`` (newest first), keeping all rows.

    A group may be arbitrarily large, so the numbering is spread over tasks
    (``number_within``) instead of a one-task-per-group window.
    """
    return number_within(df, [key], order, rn=out, size=None)


def number_duplicates(df: DataFrame, key: str, order: list, limit: int, out: str = "rn") -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY key ...)`` then ``ORDER BY key, rn LIMIT limit``.

    The answer is the first ``limit`` rows in (key, order), which a per-partition top-n finds;
    they hold a whole beginning of every key in them, so numbering just these rows gives the
    same numbers.
    """
    first = df.orderBy(F.col(key).asc_nulls_first(), *_cols(order)).limit(limit)
    w = Window.partitionBy(key).orderBy(*_cols(order))
    numbered = first.withColumn(out, F.row_number().over(w).cast("bigint"))
    return numbered.orderBy(F.col(key).asc_nulls_first(), F.col(out))


def groups_larger_than(df: DataFrame, key: str, n: int, order: list, limit: int, out: str = "group_size") -> DataFrame:
    """Rows of groups with more than ``n`` rows, ``ORDER BY order LIMIT limit``, with the group size.

    Group sizes come from a map-side-combined count; rows without a key are a group like any
    other, as in ``COUNT(*) OVER (PARTITION BY key)``.  With ``order`` starting at ``key``,
    only the first ``limit`` qualifying keys can contribute (each at least one row).
    """
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).cast("bigint").alias(out)).where(F.col(out) > F.lit(n))
    first_keys = sizes.orderBy(F.col("_key").asc_nulls_first()).limit(limit)
    rows = df.join(first_keys, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return rows.orderBy(*_cols(order)).limit(limit)

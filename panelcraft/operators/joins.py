"""Join shapes of the workflow, written the way Spark plans them best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import freeze


def flag_in(df: DataFrame, ids: DataFrame, key: str, out: str) -> DataFrame:
    """``CASE WHEN r.key IS NOT NULL THEN 1 ELSE 0 END`` from a left join to distinct ids.

    Written as a left join to the *distinct* keys with a marker column, so duplicates in
    ``ids`` can never multiply rows of ``df``.
    """
    marks = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_hit", F.lit(1))
    return df.join(marks, key, "left").withColumn(out, F.coalesce(F.col("_hit"), F.lit(0)).cast("bigint")).drop("_hit")


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids`` (LEFT JOIN ... IS NULL as an anti-join)."""
    return df.join(ids.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def keep_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (``IN (SELECT DISTINCT ...)`` as a semi-join)."""
    return df.join(ids.select(key), key, "left_semi")


def replicate(df: DataFrame, times: str) -> DataFrame:
    """Repeat each row ``times`` times (reproduces a join fan-out after joining deduplicated keys)."""
    return df.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop("_rep", times)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df`` (a few narrow columns), stored and counted, with a broadcast hint if its rows allow
    it; otherwise for a shuffled join.

    The planner cannot see that rows drawn from a large table are few: without this it may
    scan the fact once more for a runtime filter on them.
    """
    stored = freeze(df)
    return F.broadcast(stored) if stored.count() <= max_rows else stored

"""Aggregates: conditional counts/minimums, distributions, exact percentiles, shares.

All of them are partial-then-final aggregations in Spark (a hot key is combined map-side
before the shuffle).  The exact percentiles do not use ``percentile``/``median``, whose
buffer holds every distinct value of the group in one task; they cumulate value counts over
range partitions and read off the ranks needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import in_partitions
from .sketches import LG, K


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def count_where(pred: Column) -> Column:
    """``SUM(CASE WHEN pred THEN 1 ELSE 0 END)`` as BIGINT (NULL over no rows, as in SQL)."""
    return F.sum(F.when(pred, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def min_where(pred: Column, col) -> Column:
    """``MIN(CASE WHEN pred THEN col END)``."""
    return F.min(F.when(pred, _c(col)))


def row_count(df: DataFrame, out: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias(out))


def count_distinct(df: DataFrame, col: str, by: list | None = None, out: str = "n_distinct", exact: bool = True) -> DataFrame:
    """Distinct values; ``exact=False`` estimates them by one HyperLogLog sketch a group (see
    ``sketches`` for its error, and for sketches kept per day)."""
    g = df.groupBy(*by) if by else df
    if not exact:
        return g.agg(F.hll_sketch_estimate(F.hll_sketch_agg(col, F.lit(LG))).cast("bigint").alias(out))
    return g.agg(F.countDistinct(col).cast("bigint").alias(out))


def sum_or_zero(col) -> Column:
    """``SUM(COALESCE(col, 0))`` as BIGINT."""
    return F.sum(F.coalesce(_c(col), F.lit(0))).cast("bigint")


def avg_bigint(col) -> Column:
    """``CAST(AVG(col) AS BIGINT)``: truncation toward zero."""
    return F.avg(_c(col)).cast("bigint")


def value_range(df: DataFrame, col: str, lo: str = "min_value", hi: str = "max_value") -> DataFrame:
    return df.agg(F.min(col).alias(lo), F.max(col).alias(hi))


def _cumulated_values(df: DataFrame, col: str) -> DataFrame:
    """One row per distinct value: ``v``, its rows ``c``, the rows of smaller values ``before``
    and all rows ``n``.

    Rows are first counted per value (map-side), so a value that most rows share is one row;
    the distinct values are range-partitioned and cumulated over partitions.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    tagged = in_partitions(counts, [F.col("v").asc()])
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("_pid").agg(F.sum("c").alias("_sum")).select(  # one row per partition
        "_pid", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off"), F.sum("_sum").over(Window.partitionBy()).alias("n")
    )
    inside = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    run = tagged.withColumn("_run", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    return run.join(offsets, "_pid").select("v", "c", (F.col("_off") + F.col("_run")).alias("before"), "n")


def _percentile_aggs(ps: dict[str, float], scale: int) -> tuple[Column, list[Column]]:
    """(filter of the values at the needed ranks, one aggregate per percentile)."""
    n, v = F.col("n"), F.col("v").cast("double")
    wanted, out = None, []
    for name, p in ps.items():
        h = F.lit(float(p)) * (n - 1).cast("double")
        at = [(F.col("before") <= r) & (r < F.col("before") + F.col("c")) for r in (F.floor(h), F.ceil(h))]
        cond = at[0] | at[1]
        wanted = cond if wanted is None else wanted | cond
        v_lo, v_hi = (F.max(F.when(x, v)) for x in at)
        frac = F.max(F.when(cond, h - F.floor(h)))
        out.append(F.round(v_lo + frac * (v_hi - v_lo), scale).alias(name))
    return wanted, out


def exact_percentiles(df: DataFrame, col: str, ps: dict[str, float], scale: int = 6, exact: bool = True) -> DataFrame:
    """One row with the exact (interpolated) percentile of ``col`` for each ``name: p``; with
    ``exact=False`` those of one KLL sketch of the integer column (see ``sketches``).

    Same definition as SQL ``PERCENTILE``/``quantile_cont``: position ``h = p * (n - 1)``,
    interpolate between the values at ranks ``floor(h)`` and ``ceil(h)``, read off the
    cumulated value counts; only the values at the needed ranks reach the final one-row
    aggregation.  Results are rounded to ``scale`` decimals.
    """
    if not exact:
        sketch = df.agg(F.kll_sketch_agg_bigint(F.col(col).cast("bigint"), F.lit(K)).alias("kll"))
        some = F.kll_sketch_get_n_bigint("kll") > 0
        return sketch.select(*[F.when(some, F.kll_sketch_get_quantile_bigint("kll", F.lit(float(p)))).cast("double").alias(n) for n, p in ps.items()])
    wanted, aggs = _percentile_aggs(ps, scale)
    return _cumulated_values(df, col).where(wanted).agg(*aggs)


def distribution(df: DataFrame, col: str, scale: int = 6) -> DataFrame:
    """count, sum, avg, exact median, max, min, population stddev of an integer ``col`` (one row).

    All from the cumulated value counts; the variance is summed in exact decimals.
    """
    v, c = F.col("v"), F.col("c")
    _, med = _percentile_aggs({"median_fans": 0.5}, scale)
    n, s = F.sum(c), F.sum(v * c)
    exact = v.cast("decimal(19,0)")
    square = F.sum((exact * exact).cast("decimal(38,0)") * c.cast("decimal(19,0)"))
    variance = (square.cast("decimal(38,0)") - (s.cast("decimal(38,6)") * s / n).cast("decimal(38,6)")).cast("double") / n
    return _cumulated_values(df, col).agg(
        F.coalesce(n, F.lit(0)).cast("bigint").alias("total_shops"),
        s.cast("bigint").alias("total_fans"),
        F.round(s / n, scale).alias("avg_fans"),
        *med,
        F.max(v).alias("max_fans"),
        F.min(v).alias("min_fans"),
        F.round(F.sqrt(F.greatest(variance, F.lit(0.0))), scale).alias("std_fans"),
    )


def share_of_total(df: DataFrame, by: str, col: str, total: str, grand: str, pct: str, scale: int = 4) -> DataFrame:
    """Per group ``SUM(col)``, the grand total ``SUM(SUM(col)) OVER ()`` and the percentage.

    The window runs over the aggregated rows (one per group), never over the input rows.
    """
    agg = df.groupBy(by).agg(F.sum(col).cast("bigint").alias(total))
    return agg.withColumn(grand, F.sum(total).over(Window.partitionBy()).cast("bigint")).withColumn(
        pct, F.round(F.col(total) * F.lit(100.0) / F.col(grand), scale)
    )

"""Reproducible sampling: per-group top-k by hash key, quotas, weighted draws, two-stage and pin-then-fill.

Every draw orders rows by ``draw_key(seed, stage, group keys, row keys)`` and then by the row
keys, and keeps ``row_number() <= k``.  Spark plans that filter as a partial top-k *before*
the shuffle (``WindowGroupLimit``), so a group of any size sends at most k rows per input
partition across the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw_key, exp_key
from ..params import ZERO_SALES_KEY
from .joins import exclude


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def ranked(df: DataFrame, keys: list[str], order: list[Column], rn: str = "rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn(rn, F.row_number().over(w).cast("bigint"))


KEY_BITS, HISTOGRAM_BITS = 52, 12


def sample_topk(df: DataFrame, keys: list[str], k: int, seed: int, stage: str, ids: list[str], rn: str = "rn") -> DataFrame:
    """Up to ``k`` rows per group drawn uniformly without replacement (``ORDER BY RAND()`` top-k)."""
    order = [draw_key(seed, stage, *keys, *ids), *_cols(ids)]
    return ranked(df, keys, order, rn).where(F.col(rn) <= F.lit(k))


def sample_quota(df: DataFrame, stratum: str, quotas: dict, seed: int, stage: str, ids: list[str], rn: str = "rn") -> DataFrame:
    """Per-stratum quota draw: keep ``rn <= quotas[stratum]``; strata without a quota keep nothing.

    The partial top-k before the shuffle would keep up to a whole quota per stratum *and input
    partition*.  So the draw keys are first counted in 4096 ranges per stratum (one
    aggregation; strata x 4096 counts at most): the range in which a stratum's count reaches
    its quota bounds the keys that can be drawn, exactly.  Rows above that bound are dropped
    before the shuffle, and the rest, about one quota per stratum, is numbered.
    """
    key = draw_key(seed, stage, stratum, *ids)
    df = df.where(F.col(stratum).isin(list(quotas)))
    ranges = F.shiftright(key, KEY_BITS - HISTOGRAM_BITS)
    counts = df.groupBy(F.col(stratum).alias("s"), ranges.alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()
    limit = None
    for s, q in quotas.items():
        total, top = 0, 0
        for r, n in sorted((x["r"], x["n"]) for x in counts if x["s"] == s):
            total, top = total + n, r
            if total >= q:
                break
        below = F.lit((top + 1) << (KEY_BITS - HISTOGRAM_BITS))
        limit = F.when(F.col(stratum) == F.lit(s), below) if limit is None else limit.when(F.col(stratum) == F.lit(s), below)
    qmap = F.create_map(*[x for s, q in quotas.items() for x in (F.lit(s), F.lit(q))])
    out = ranked(df.where(key < limit), [stratum], [key, *_cols(ids)], rn)
    return out.where(F.col(rn) <= F.lit(max(quotas.values()))).where(F.col(rn) <= F.element_at(qmap, F.col(stratum)))


def weighted_key(weight: Column, seed: int, stage: str, keys: list, zero: str = "last") -> Column:
    """Efraimidis-Spirakis key; ``zero='last'`` puts non-positive weights last, ``'unit'`` treats them as 1."""
    if zero == "last":
        return F.when(weight > 0, exp_key(weight.cast("double"), seed, stage, *keys)).otherwise(F.lit(float(ZERO_SALES_KEY)))
    if zero == "unit":
        w = F.when(weight > 0, weight).otherwise(F.lit(1)).cast("double")
        return exp_key(w, seed, stage, *keys)
    raise ValueError("zero must be 'last' or 'unit'")


def sample_weighted_topk(
    df: DataFrame, keys: list[str], weight: str, k: int, seed: int, stage: str, ids: list[str], zero: str = "last", rn: str = "rn"
) -> DataFrame:
    """Up to ``k`` rows per group, drawn with probability proportional to ``weight`` without replacement."""
    order = [weighted_key(F.col(weight), seed, stage, [*keys, *ids], zero), *_cols(ids)]
    return ranked(df, keys, order, rn).where(F.col(rn) <= F.lit(k))


def two_stage_sample(
    df: DataFrame, level: str, cluster: str, k1: int, k2: int, seed: int, ids: list[str], rn_item: str = "rn_item"
) -> DataFrame:
    """Per level draw ``k1`` clusters, then ``k2`` rows inside each drawn cluster.

    Stage 1 runs on the distinct (level, cluster) pairs (aggregated map-side), so its input
    is one row per cluster, not per item.
    """
    clusters = df.select(level, cluster).distinct()
    picked = sample_topk(clusters, [level], k1, seed, "clusters", [cluster]).select(level, cluster)
    inside = df.join(picked, [level, cluster], "left_semi")
    return sample_topk(inside, [level, cluster], k2, seed, "members", ids, rn=rn_item)


def pin_then_fill(
    df: DataFrame, cell: list[str], flag: str, pin: int, fill: int, seed: int, ids: list[str], key: str = "item_id"
) -> DataFrame:
    """Per cell draw ``pin`` rows with ``flag = 1``, then ``fill`` rows from the rest of the cell.

    "The rest" excludes every row whose ``key`` was pinned (an anti-join on the key, as in
    the original), so other copies of a pinned item are excluded too.  The two draws use
    different stages, so they are independent.
    """
    pinned = sample_topk(df.where(F.col(flag) == 1), cell, pin, seed, "pin", ids).drop("rn")
    rest = exclude(df, pinned.select(key), key)
    filled = sample_topk(rest, cell, fill, seed, "fill", ids).drop("rn")
    return pinned.unionByName(filled)

"""A quota sample that is kept up to date while rows are appended.

A quota draw keeps the rows of smallest (draw key, ids) of every stratum.  So the last kept row of
a full stratum is a threshold: an appended row beyond it can never enter, whatever else comes, and
is rejected by its own key alone.  The few admitted rows are ranked together with the kept ones.
The sample is always the one that a fresh draw over all rows so far would give; earlier rows are not
read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw_key
from .ordering import SortKey, literal, precedes
from .sampling import ranked, sample_quota

KEY = "_draw_key"


def _thresholds(sample: DataFrame, stratum: str, quotas: dict, ids: list[str]) -> dict:
    """Stratum -> (key, ids) of the last kept row, for strata that are full (at most one a quota)."""
    last = F.max_by(F.struct(KEY, *ids), "rn")
    found = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), last.alias("last")).collect()
    return {r[stratum]: tuple(r["last"]) for r in found if r["n"] >= quotas[r[stratum]]}


def extend_sample(sample: DataFrame | None, rows: DataFrame, stratum: str, quotas: dict, seed: int, stage: str, ids: list[str]) -> DataFrame:
    """The sample over its own rows and the appended ``rows``: their columns, the draw key and ``rn``.

    ``sample`` is an earlier result of this function, stored by the caller (None for the first
    rows).  A row that is appended twice counts twice, as in a draw over both.
    """
    key = draw_key(seed, stage, stratum, *ids)
    if sample is None:
        return sample_quota(rows, stratum, quotas, seed, stage, ids).withColumn(KEY, key)
    told = rows.where(F.col(stratum).isin(list(quotas))).withColumn(KEY, key)
    keys = [SortKey(KEY), *(SortKey(i) for i in ids)]
    beyond = F.lit(False)
    for s, last in _thresholds(sample, stratum, quotas, ids).items():
        kinds = [told.schema[k.name].dataType for k in keys]
        inside = precedes(keys, [literal(v, t) for v, t in zip(last, kinds, strict=True)])
        beyond = F.when(F.col(stratum) == F.lit(s), ~inside).otherwise(beyond)
    both = sample.drop("rn").unionByName(told.where(~beyond))
    out = ranked(both, [stratum], [F.col(KEY), *[F.col(i) for i in ids]], "rn")
    quota = F.create_map(*[x for s, q in quotas.items() for x in (F.lit(s), F.lit(q))])
    return out.where(F.col("rn") <= F.element_at(quota, F.col(stratum)))

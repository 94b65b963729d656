"""Banding: equal-frequency (NTILE) inside groups or over all rows, and equal-width levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import ntile_of, number_within
from .ordering import SortKey, literal, precedes, sort_keys, sorted_rows

MAX_GROUPS = 20_000  # groups whose cut rows are broadcast
FINISH, SHARE = 100_000, 1024  # rows of a group (or a bracket in it) that one task may sort, or that share of all
BRACKETS = 512  # sampled tuples of a large group and round


def equal_freq_band(df: DataFrame, by: list[str], order, n: int, out: str = "band", distributed: bool = True) -> DataFrame:
    """``NTILE(n) OVER (PARTITION BY by ORDER BY order)`` as BIGINT, by exact selection.

    Only the rows that begin bands 2 to n matter.  Groups are counted, which gives the ranks of
    those rows.  In a large group they are bracketed between two rows of a sample, the rows
    before either are counted, and the bracket is narrowed until few rows are left; the order
    keys of what is left, and of small groups, are numbered and the rows at the ranks read off.
    The bands then follow by comparing each row with its group's cut rows, a broadcast of at
    most ``MAX_GROUPS`` rows: the banded rows themselves are neither sorted, shuffled nor stored.
    With more groups than that, and where a band begins among rows of equal order keys (copies of a
    row), the rows are numbered by ``number_within``.

    ``df`` is read several times, so store it
    first if it is costly.  ``distributed=False`` is the plain window, kept as the test double.
    """
    keys = sort_keys(order)
    if not distributed:
        w = Window.partitionBy(*by).orderBy(*[k.column for k in keys])
        return df.withColumn(out, F.ntile(n).over(w).cast("bigint"))
    cuts = _cut_rows(df, list(by), keys, n)
    if cuts is None:
        numbered = number_within(df, by, order, rn="_rn", size="_n")
        return numbered.withColumn(out, ntile_of(F.col("_rn"), F.col("_n"), n)).drop("_rn", "_n")
    kinds = [df.schema[k.name].dataType for k in keys]
    at_or_after = lambda values: (~precedes(keys, values)).cast("bigint")
    if not by:
        found = cuts.get((), {})
        steps = [at_or_after([literal(v, t) for v, t in zip(found[i], kinds, strict=True)]) for i in sorted(found)]
        return df.withColumn(out, reduce(lambda a, b: a + b, steps, F.lit(1).cast("bigint")))
    row = T.StructType([T.StructField(f"k{i}", t) for i, t in enumerate(kinds)])
    fields = [T.StructField(f"_g{i}", df.schema[b].dataType) for i, b in enumerate(by)]
    fields += [T.StructField(f"_c{i}", row) for i in range(2, n + 1)]
    table = [(*g, *(found.get(i) for i in range(2, n + 1))) for g, found in cuts.items()]
    side = F.broadcast(df.sparkSession.createDataFrame(table, T.StructType(fields)).coalesce(1))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)])
    joined = df.join(side, same, "left")
    steps = [
        F.when(F.col(f"_c{i}").isNotNull(), at_or_after([F.col(f"_c{i}.k{j}") for j in range(len(keys))])).otherwise(F.lit(0)).cast("bigint")
        for i in range(2, n + 1)
    ]
    return joined.select(*[F.col(c) for c in df.columns if c != out], reduce(lambda a, b: a + b, steps, F.lit(1).cast("bigint")).alias(out))


def global_ntile(df: DataFrame, order, n: int, out: str = "bucket", distributed: bool = True) -> DataFrame:
    """``NTILE(n) OVER (ORDER BY order)`` over all rows without a single-partition exchange."""
    return equal_freq_band(df, [], order, n, out=out, distributed=distributed)


def _first_ranks(size: int, n: int) -> dict[int, int]:
    """Band -> rank (from 0) of its first row, for the bands 2..n that a group of ``size`` rows has."""
    q, r = divmod(size, n)
    starts = {b: (b - 1) * q + min(b - 1, r) for b in range(2, n + 1)}
    return {b: s for b, s in starts.items() if s < size}


def _cut_rows(df: DataFrame, by: list[str], keys: list[SortKey], n: int) -> dict[tuple, dict[int, tuple]] | None:
    """Per group, band -> order keys of the band's first row; None if the groups are too many, or if
    a band begins among rows of equal keys, which keys cannot tell apart."""
    names = [k.name for k in keys]
    rows = df.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], *[F.col(c) for c in dict.fromkeys(names)])
    group = [f"_g{i}" for i in range(len(by))]
    counted = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).limit(MAX_GROUPS + 1).collect()
    if len(counted) > MAX_GROUPS:
        return None
    sizes = {tuple(r[g] for g in group): r["_n"] for r in counted}
    few = max(FINISH, sum(sizes.values()) // SHARE)
    large = {g: size for g, size in sizes.items() if size > few}
    out: dict[tuple, dict[int, tuple]] = {g: {} for g in sizes}
    if len(large) < len(sizes):  # whole groups are small: number their keys
        small = rows if not large else _with_groups(rows, group, [g for g in sizes if g not in large])
        w = Window.partitionBy(*group)
        order = w.orderBy(*[k.column for k in keys])
        numbered = small.withColumns({"_at": F.row_number().over(order), "_n": F.count(F.lit(1)).over(w)})
        band = ntile_of(F.col("_at"), F.col("_n"), n)
        same = reduce(lambda a, b: a & b, [F.lag(c).over(order).eqNullSafe(F.col(c)) for c in names])
        begins = numbered.withColumns({"_band": band, "_before": ntile_of(F.col("_at") - 1, F.col("_n"), n), "_tied": same})
        for r in begins.where("_at > 1 AND _band <> _before").select(*group, *names, "_band", "_tied").collect():
            if r["_tied"]:
                return None
            out[tuple(r[g] for g in group)][r["_band"]] = tuple(r[c] for c in names)
    for g, band, row, tied in _select(rows, group, keys, {g: _first_ranks(size, n) for g, size in large.items()}, large, few):
        if tied:
            return None
        out[g][band] = row
    return out


def _with_groups(rows: DataFrame, group: list[str], wanted: list[tuple]) -> DataFrame:
    """The rows of the groups ``wanted`` (a broadcast of at most ``MAX_GROUPS`` of them)."""
    fields = [T.StructField(f"_w{i}", rows.schema[g].dataType) for i, g in enumerate(group)]
    side = F.broadcast(rows.sparkSession.createDataFrame(wanted, T.StructType(fields)).coalesce(1))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_w{i}")) for i, g in enumerate(group)])
    return rows.join(side, same, "left_semi")


def _select(rows: DataFrame, group: list[str], keys: list[SortKey], ranks: dict, sizes: dict, few: int):
    """(group, band, order keys, whether the row before has the same) of the rows at the ``ranks``
    of large groups.

    A cut's state is a bracket: rows at or after ``lo`` and before ``hi`` (None: open), the rank
    of the row sought among them, and their number.  At most ``SHARE`` groups are large, so the
    states and the samples (``BRACKETS`` tuples a cut and round) are few.
    """
    names = [k.name for k in keys]
    state = {(g, b): (None, None, r, sizes[g]) for g, found in ranks.items() for b, r in found.items()}
    while todo := {c: s for c, s in state.items() if s[3] > few}:
        inside = _bracketed(rows, group, keys, todo)
        drawn = inside.where(F.pmod(F.xxhash64(*names), F.lit(1 << 30)) < (F.lit(float(BRACKETS << 30)) / F.col("_rows")))
        sample: dict[tuple, list[tuple]] = {}
        for r in drawn.select("_cut", *names).collect():
            sample.setdefault(r["_cut"], []).append(tuple(r[c] for c in names))
        cuts = list(todo)
        probes = {}
        for i, c in enumerate(cuts):
            lo, hi, rank, size = todo[c]
            got = list(dict.fromkeys(sorted_rows(sample.get(i, []), keys)))
            at, slack = int(len(got) * rank / size), int(3 * len(got) ** 0.5) + 1
            ends = [got[j] if 0 <= j < len(got) else None for j in (at - slack, at + slack)]
            probes[c] = (*(e if e not in (lo, hi) else None for e in ends), rank, size)
        counts = _count_before(inside, group, keys, cuts, probes)
        narrowed = False
        for i, c in enumerate(cuts):
            lo, hi, rank, size = todo[c]
            low, high, _, _ = probes[c]
            below, upto = counts.get(i, (0, size))
            below, upto = below if low is not None else 0, upto if high is not None else size
            if rank < below:
                new = (lo, low, rank, below)
            elif rank >= upto:
                new = (high, hi, rank - upto, size - upto)
            else:
                new = (low if low is not None else lo, high if high is not None else hi, rank - below, upto - below)
            narrowed |= new[3] < size
            state[c] = new
        if not narrowed:  # equal keys only: any of them is the row sought
            break
    cuts = list(state)
    if not cuts:
        return
    inside = _bracketed(rows, group, keys, state)
    numbered = number_within(inside.select("_cut", "_rank", *names), ["_cut"], [k.column for k in keys], rn="_at", size=None)
    near = numbered.where((F.col("_at") - 1 == F.col("_rank")) | (F.col("_at") == F.col("_rank"))).collect()
    before = {r["_cut"]: tuple(r[c] for c in names) for r in near if r["_at"] == r["_rank"]}
    for r in near:
        if r["_at"] - 1 == r["_rank"]:
            row = tuple(r[c] for c in names)
            yield *cuts[r["_cut"]], row, before.get(r["_cut"]) == row


def _state_table(rows: DataFrame, group: list[str], keys: list[SortKey], state: dict) -> DataFrame:
    kinds = T.StructType([T.StructField(f"k{i}", rows.schema[k.name].dataType) for i, k in enumerate(keys)])
    fields = [T.StructField(f"_w{i}", rows.schema[g].dataType) for i, g in enumerate(group)]
    fields += [T.StructField("_cut", T.IntegerType()), T.StructField("_lo", kinds), T.StructField("_hi", kinds)]
    fields += [T.StructField("_rank", T.LongType()), T.StructField("_rows", T.LongType())]
    table = [(*g, i, lo, hi, rank, size) for i, ((g, _), (lo, hi, rank, size)) in enumerate(state.items())]
    return F.broadcast(rows.sparkSession.createDataFrame(table, T.StructType(fields)).coalesce(1))


def _bracketed(rows: DataFrame, group: list[str], keys: list[SortKey], state: dict) -> DataFrame:
    """The rows inside each cut's bracket, once a cut, with ``_cut``, ``_rank`` and ``_rows``."""
    side = _state_table(rows, group, keys, state)
    if group:
        joined = rows.join(side, reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_w{i}")) for i, g in enumerate(group)]))
    else:  # one group: meet all cuts by a constant key
        joined = rows.withColumn("_one", F.lit(1)).join(side.withColumn("_one", F.lit(1)), "_one")
    part = lambda c: [F.col(f"{c}.k{i}") for i in range(len(keys))]
    after = F.col("_lo").isNull() | ~precedes(keys, part("_lo"))
    before = F.col("_hi").isNull() | precedes(keys, part("_hi"))
    return joined.where(after & before)


def _count_before(inside: DataFrame, group: list[str], keys: list[SortKey], cuts: list, probes: dict) -> dict[int, tuple[int, int]]:
    """Per cut, the bracketed rows before its two probes."""
    names = [k.name for k in keys]
    kinds = T.StructType([T.StructField(f"k{i}", inside.schema[c].dataType) for i, c in enumerate(names)])
    fields = [T.StructField("_cut", T.IntegerType()), T.StructField("_p", kinds), T.StructField("_q", kinds)]
    side = inside.sparkSession.createDataFrame([(i, probes[c][0], probes[c][1]) for i, c in enumerate(cuts)], T.StructType(fields))
    joined = inside.join(F.broadcast(side.coalesce(1)), "_cut")
    n = lambda c: F.count(F.when(F.col(c).isNotNull() & precedes(keys, [F.col(f"{c}.k{i}") for i in range(len(keys))]), 1))
    return {r["_cut"]: (r["p"], r["q"]) for r in joined.groupBy("_cut").agg(n("_p").alias("p"), n("_q").alias("q")).collect()}


def equal_width_level(value: Column, lo, hi, n: int = 4, zero_to_one: bool = False) -> Column:
    """``CASE WHEN hi = lo THEN 1 ELSE CEIL((value - lo) * n / (hi - lo + 1)) END`` as BIGINT.

    ``lo``/``hi`` are literals (the one-row bounds) so no join is planned.  The minimum value
    gets level 0 (quirk Q4: levels run 0..n), as in the original, or level 1 with
    ``zero_to_one``.
    """
    if hi == lo:
        return F.lit(1).cast("bigint")
    level = F.ceil((value - F.lit(lo)).cast("double") * F.lit(float(n)) / F.lit(float(hi - lo + 1))).cast("bigint")
    return F.greatest(level, F.lit(1).cast("bigint")) if zero_to_one else level

"""Row numbering inside groups without sending a large group to one task.

``Window.partitionBy(g).orderBy(o)`` moves every row of a group to one task; a group holding a
third of the data then sorts a third of the data alone, and a window without ``partitionBy``
moves *all* rows to one task.  ``number_within`` cuts such groups into pieces by fixed bounds:

1. a sample of the order keys (the tuples of smallest hash, a fixed number) shows the groups that
   hold a noticeable share of the rows, and where their order can be cut into even pieces;
2. the bounds are literals, so a row's piece is a pure function of the row: nothing has to be
   stored to keep it, and a recomputed task finds the same pieces;
3. the rows of the cut groups are counted per piece (one partial aggregation, at most ``PIECES``
   counts and a few), which gives the rows before every piece;
4. the window runs per (group, piece), and the rows before the piece are added.

Groups are cut by their share of the rows, never by the table's size.  Without such a group the
plan is the plain window, with no join, store or second shuffle in any case.  Bounds are made of the
first ``CUT_BY`` order columns; time stamps with a zone, binary and nested columns are left out of
them (as literals they would depend on the session), so rows that differ in these alone stay together.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import freeze
from .ordering import SortKey, literal, precedes, sort_keys, sorted_rows

_POS_BITS = 33  # monotonically_increasing_id = partition index << 33 | position in partition
_POS_MASK = (1 << _POS_BITS) - 1
PIECES, SAMPLE = 64, 4096
CUT_BY = 3  # leading order columns that the bounds are made of


def in_partitions(df: DataFrame, sort_cols: list[Column]) -> DataFrame:
    """Rows range-partitioned and sorted by ``sort_cols``, frozen, with ``_pid`` (partition) and
    ``_pos`` (position in it)."""
    frozen = freeze(df.repartitionByRange(*sort_cols).sortWithinPartitions(*sort_cols))
    return frozen.withColumn("_mid", F.monotonically_increasing_id()).select(
        *df.columns,
        F.shiftright(F.col("_mid"), _POS_BITS).alias("_pid"),
        F.col("_mid").bitwiseAND(F.lit(_POS_MASK)).alias("_pos"),
    )


def _comparable(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType, T.TimestampType, T.BinaryType))


def _cuts(df: DataFrame, by: list[str], keys: list[SortKey]) -> list[tuple[tuple, list[tuple]]]:
    """(group, bounds in order) of the groups that hold two ``PIECES``-ths of the rows or more."""
    names = list(dict.fromkeys([*by, *(k.name for k in keys)]))
    every = df.select(*names)
    sample = every.orderBy(F.xxhash64(*names), *names).limit(SAMPLE).collect()
    found = defaultdict(list)
    for r in sample:
        found[tuple(r[b] for b in by)].append(tuple(r[k.name] for k in keys))
    out = []
    for group, rows in found.items():
        pieces = round(PIECES * len(rows) / len(sample))
        if pieces < 2:
            continue
        rows = sorted_rows(rows, keys)
        bounds = list(dict.fromkeys(rows[len(rows) * i // pieces] for i in range(1, pieces)))
        bounds = [b for b in bounds if b != rows[0]]
        if bounds:
            out.append((group, bounds))
    return out


def _tree(keys: list[SortKey], kinds: list[T.DataType], bounds: list[tuple], first: int) -> Column:
    """Number of the piece, from ``first`` on, by halving the bounds."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    before = precedes(keys, [literal(v, t) for v, t in zip(bounds[mid], kinds, strict=True)])
    return F.when(before, _tree(keys, kinds, bounds[:mid], first)).otherwise(_tree(keys, kinds, bounds[mid + 1 :], first + mid + 1))


def pieces(df: DataFrame, by: list[str], order) -> tuple[Column, list[list[int]]]:
    """(piece of a row, piece numbers of every cut group in order); 0 for rows of other groups."""
    keys = [k for k in sort_keys(order)[:CUT_BY] if _comparable(df, k.name)]
    if not keys or not all(_comparable(df, b) for b in by):
        return F.lit(0), []
    kinds = [df.schema[k.name].dataType for k in keys]
    piece, numbers, first = F.lit(0), [], 1
    for group, bounds in _cuts(df, by, keys):
        mine = F.lit(True)
        for b, v in zip(by, group, strict=True):
            mine = mine & F.col(b).eqNullSafe(literal(v, df.schema[b].dataType))
        piece = F.when(mine, _tree(keys, kinds, bounds, first)).otherwise(piece)
        numbers.append(list(range(first, first + len(bounds) + 1)))
        first += len(bounds) + 1
    return piece, numbers


def number_within(df: DataFrame, by: list[str], order, rn: str = "_rn", size: str | None = "_n") -> DataFrame:
    """Add ``rn`` (1-based position inside the group in ``order``) and, unless None, ``size`` (group rows).

    ``order`` should be a total order (append id columns) for a reproducible result; ties
    get distinct numbers in an arbitrary way, as with ``row_number``.  ``df`` is read up to three
    times (sample, counts, rows).
    """
    by = list(by)
    keys = sort_keys(order)
    piece, cut = pieces(df, by, order)
    if not cut:
        plain = Window.partitionBy(*by)
        out = df.withColumn(rn, F.row_number().over(plain.orderBy(*[k.column for k in keys])).cast("bigint"))
        return out if size is None else out.withColumn(size, F.count(F.lit(1)).over(plain).cast("bigint"))
    counted = df.select(piece.alias("_piece")).where("_piece > 0").groupBy("_piece").count().collect()
    rows = {r["_piece"]: r["count"] for r in counted}
    before, total = [], []
    for numbers in cut:
        held = [rows.get(i, 0) for i in numbers]
        for j, i in enumerate(numbers):
            before += [F.lit(i), F.lit(sum(held[:j])).cast("bigint")]
            total += [F.lit(i), F.lit(sum(held)).cast("bigint")]
    zero = F.lit(0).cast("bigint")
    w = Window.partitionBy(*by, "_piece")
    out = df.withColumn("_piece", piece)
    out = out.withColumn(rn, F.row_number().over(w.orderBy(*[k.column for k in keys])) + F.coalesce(F.try_element_at(F.create_map(*before), "_piece"), zero))
    if size is not None:
        out = out.withColumn(size, F.coalesce(F.try_element_at(F.create_map(*total), "_piece"), F.count(F.lit(1)).over(w).cast("bigint")))
    return out.drop("_piece")


def ntile_of(rn: Column, size: Column, n: int) -> Column:
    """Bucket 1..n of the ``rn``-th of ``size`` rows, exactly as SQL ``NTILE(n)`` assigns it:
    the first ``size % n`` buckets hold one row more."""
    i = rn - 1
    q = F.floor(size / F.lit(n)).cast("bigint")
    r = size - q * F.lit(n)
    big = r * (q + 1)
    return (
        F.when(i < big, F.floor(i / (q + 1)) + 1)
        .otherwise(r + F.floor((i - big) / F.greatest(q, F.lit(1))) + 1)
        .cast("bigint")
    )

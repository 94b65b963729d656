"""Sort keys whose direction is known, so that rows can be compared with known rows.

An order is a list of column names (``"-name"``: descending) or of plain sort columns such as
``F.col("x").desc()``.  Nulls come first in ascending and last in descending order unless the sort
column says otherwise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cmp_to_key

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SORT = re.compile(r"^Column<'`?(.+?)`?( (ASC|DESC) NULLS (FIRST|LAST))?'>$")


@dataclass(frozen=True)
class SortKey:
    name: str
    descending: bool = False
    nulls_first: bool = True

    @property
    def column(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def precedes(self, value: Column) -> Column:
        """Whether the row's value comes strictly before ``value``."""
        mine = F.col(self.name)
        smaller = mine > value if self.descending else mine < value
        if self.nulls_first:
            return value.isNotNull() & (mine.isNull() | F.coalesce(smaller, F.lit(False)))
        return mine.isNotNull() & (value.isNull() | F.coalesce(smaller, F.lit(False)))


def sort_keys(order) -> list[SortKey]:
    """The keys of an order (see the module's docstring)."""
    out = []
    for o in [order] if isinstance(order, (str, Column)) else order:
        if isinstance(o, str):
            desc = o.startswith("-")
            out.append(SortKey(o[desc:], desc, not desc))
            continue
        m = _SORT.match(str(o))
        if not m or not re.fullmatch(r"[\w.]+", m[1]):
            raise ValueError(f"not a plain column with a direction: {o}")
        out.append(SortKey(m[1], m[3] == "DESC", (m[4] or "FIRST") == "FIRST"))
    return out


def precedes(keys: list[SortKey], values: list[Column]) -> Column:
    """Whether a row comes strictly before the row with these ``values`` of the keys."""
    out = None
    for k, v in reversed(list(zip(keys, values, strict=True))):
        out = k.precedes(v) if out is None else k.precedes(v) | (F.col(k.name).eqNullSafe(v) & out)
    return F.lit(False) if out is None else out


def literal(value, kind: T.DataType) -> Column:
    """A literal of a collected value; time stamps without a zone stay without one."""
    if isinstance(kind, T.TimestampNTZType) and value is not None:
        return F.lit(value.isoformat(sep=" ")).cast(kind)
    return F.lit(value).cast(kind)


def sorted_rows(rows: list[tuple], keys: list[SortKey]) -> list[tuple]:
    """Collected key tuples in the keys' order."""

    def compare(a: tuple, b: tuple) -> int:
        for x, y, k in zip(a, b, keys, strict=True):
            if x == y:
                continue
            if x is None or y is None:
                return -1 if (x is None) == k.nulls_first else 1
            return -1 if (x > y) == k.descending else 1
        return 0

    return sorted(rows, key=cmp_to_key(compare))

"""Range and rank labels, and label-ordered sorting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def range_labels(edges) -> list[str]:
    """Text labels of right-closed ranges; the first range is closed at both ends."""
    labels = []
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        labels.append(f"[{lo},{hi}]" if i == 0 else f"({lo},{hi}]")
    return labels


def _range_case(col, edges, values) -> Column:
    c = _c(col)
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = ((c >= lo) if i == 0 else (c > lo)) & (c <= hi)
        expr = F.when(cond, values[i]) if expr is None else expr.when(cond, values[i])
    return expr


def range_label(col, edges) -> Column:
    """Label of the range ``col`` falls in; NULL outside all ranges."""
    return _range_case(col, edges, [F.lit(s) for s in range_labels(edges)])


def size_label(col, labels=("big", "mid", "small")) -> Column:
    """``CASE col WHEN 1 THEN labels[0] WHEN 2 THEN labels[1] ELSE labels[2]``."""
    c = _c(col)
    return F.when(c == 1, F.lit(labels[0])).when(c == 2, F.lit(labels[1])).otherwise(F.lit(labels[2]))


def label_order(col, labels) -> Column:
    """Sort key placing ``labels`` in the given order (unknown labels last)."""
    c = _c(col)
    expr = None
    for i, lab in enumerate(labels):
        expr = F.when(c == lab, F.lit(i + 1)) if expr is None else expr.when(c == lab, F.lit(i + 1))
    return expr.otherwise(F.lit(len(labels) + 1))


def marker_last_order(col, marker: str, last: int = 999) -> Column:
    """``CASE WHEN col = marker THEN last ELSE CAST(col AS BIGINT) END`` (ANSI-safe ``try_cast``)."""
    c = _c(col)
    return F.when(c == F.lit(marker), F.lit(last)).otherwise(c.try_cast("bigint"))

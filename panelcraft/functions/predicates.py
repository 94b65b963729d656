"""Cleansing predicates for the warehouse's several encodings of "missing".

Text columns carry SQL NULL, blank strings, the empty-list text ``[]`` and the export
marker ``\\N``.  The original scripts test for pictures in five slightly different ways,
which are *not* equivalent (``' [] '`` and ``\\N`` split them); each is a ``variant``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import EMPTY_LIST_TEXT, MISSING_MARKER

HAS_IMAGE_VARIANTS = ("trimmed", "trimmed_n", "raw_n", "raw", "nonempty")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def has_image(col, variant: str = "trimmed_n") -> Column:
    """True when the text column lists at least one picture.

    * ``trimmed``   - not null, trimmed text not in ('', '[]')
    * ``trimmed_n`` - as ``trimmed`` and trimmed text != '\\N' (default)
    * ``raw_n``     - raw text not in ('', '\\N', '[]') and non-blank; ``' [] '`` passes
    * ``raw``       - raw text not in ('', '[]')
    * ``nonempty``  - not null and != ''
    """
    c = _c(col)
    t = F.trim(c)
    if variant == "trimmed":
        return c.isNotNull() & (t != F.lit("")) & (t != F.lit(EMPTY_LIST_TEXT))
    if variant == "trimmed_n":
        return c.isNotNull() & (t != F.lit("")) & (t != F.lit(EMPTY_LIST_TEXT)) & (t != F.lit(MISSING_MARKER))
    if variant == "raw_n":
        return (
            c.isNotNull()
            & (c != F.lit(""))
            & (c != F.lit(MISSING_MARKER))
            & (c != F.lit(EMPTY_LIST_TEXT))
            & (F.length(t) > 0)
        )
    if variant == "raw":
        return (c != F.lit("")) & (c != F.lit(EMPTY_LIST_TEXT))
    if variant == "nonempty":
        return c.isNotNull() & (c != F.lit(""))
    raise ValueError(f"unknown has_image variant {variant!r}; choose one of {HAS_IMAGE_VARIANTS}")


def no_image(col) -> Column:
    """NULL-safe complement of ``has_image(col, 'trimmed_n')``: never NULL itself."""
    c = _c(col)
    t = F.trim(c)
    return c.isNull() | (t == F.lit("")) | (t == F.lit(EMPTY_LIST_TEXT)) | (t == F.lit(MISSING_MARKER))


def valid_sale_start(volume="start_sell_volume", date="start_sell_date", reject_empty_list: bool = False) -> Column:
    """Usable sale start: volume non-null and > 0, date non-null and non-blank (optionally not '[]')."""
    v, d = _c(volume), _c(date)
    p = v.isNotNull() & (v > 0) & d.isNotNull() & (F.trim(d) != F.lit(""))
    if reject_empty_list:
        p = p & (F.trim(d) != F.lit(EMPTY_LIST_TEXT))
    return p


def date_between(col, lo: dt.date, hi: dt.date) -> Column:
    """Calendar range, both ends included, on a DATE column."""
    return _c(col).between(F.lit(lo), F.lit(hi))


def day_range(ts_col, lo: dt.date, hi: dt.date) -> Column:
    """``to_date(ts) BETWEEN lo AND hi`` written as a half-open timestamp range.

    Same rows, but the comparison is on the raw column against literals that Spark casts to
    the column's own timestamp type, so it reaches the file scan as a pushed filter (a
    function of the column would not).
    """
    c = _c(ts_col)
    upper = hi + dt.timedelta(days=1)
    return (c >= F.lit(f"{lo.isoformat()} 00:00:00")) & (c < F.lit(f"{upper.isoformat()} 00:00:00"))


def gap_at_least(late, early, n: int) -> Column:
    """At least ``n`` calendar-day boundaries from ``early`` to ``late``."""
    return F.datediff(_c(late), _c(early)) >= F.lit(n)


def never_or_after(col, cutoff: dt.date) -> Column:
    """Event never happened, or happened after the cutoff (a timestamp vs the cutoff's midnight)."""
    c = _c(col)
    return c.isNull() | (c > F.lit(cutoff))


def str_date_le(col, bound: str) -> Column:
    """Lexicographic upper bound on a date kept as text (the original compares text, quirk Q6)."""
    return _c(col) <= F.lit(bound)

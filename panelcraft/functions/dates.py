"""Date helpers with the warehouse's semantics.

The original scripts write formats as ``yyyy-mm-dd``; in Spark ``mm`` means *minutes*, so
every format here is the Spark pattern ``yyyy-MM-dd`` / ``yyyyMMdd``.  Parsing uses
``try_to_date`` so a blank or malformed text yields NULL instead of failing under ANSI.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def day_string(ts) -> Column:
    """``TO_CHAR(ts, 'yyyy-mm-dd')``."""
    return F.date_format(_c(ts), "yyyy-MM-dd")


def parse_day(text, fmt: str = "yyyy-MM-dd") -> Column:
    """``TO_DATE(text, fmt)``; NULL for text that does not parse."""
    return F.try_to_date(_c(text), fmt)


def add_days(date, n) -> Column:
    """``DATEADD(date, n, 'dd')``."""
    return F.date_add(_c(date), n if isinstance(n, Column) else F.lit(n))


def days_between(late, early) -> Column:
    """``DATEDIFF(late, early, 'dd')``: calendar-day boundaries, as BIGINT."""
    return F.datediff(_c(late), _c(early)).cast("bigint")

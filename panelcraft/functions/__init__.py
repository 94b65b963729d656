"""Column-level functions: predicates, dates, labels, hash draws."""

from .dates import add_days, day_string, days_between, parse_day
from .hashing import draw_key, exp_key, uniform
from .labels import label_order, marker_last_order, range_label, range_labels, size_label
from .predicates import (
    HAS_IMAGE_VARIANTS,
    date_between,
    day_range,
    gap_at_least,
    has_image,
    never_or_after,
    no_image,
    str_date_le,
    valid_sale_start,
)

__all__ = [
    "HAS_IMAGE_VARIANTS",
    "add_days",
    "date_between",
    "day_range",
    "day_string",
    "days_between",
    "draw_key",
    "exp_key",
    "gap_at_least",
    "has_image",
    "label_order",
    "marker_last_order",
    "never_or_after",
    "no_image",
    "parse_day",
    "range_label",
    "range_labels",
    "size_label",
    "str_date_le",
    "uniform",
    "valid_sale_start",
]

"""DataFrame operators."""

from .aggregates import (
    avg_bigint,
    count_distinct,
    count_where,
    distribution,
    exact_percentiles,
    min_where,
    row_count,
    share_of_total,
    sum_or_zero,
    value_range,
)
from .bands import equal_freq_band, equal_width_level, global_ntile
from .joins import broadcast_if_small, exclude, flag_in, keep_in, replicate
from .numbering import ntile_of, number_within
from .sampling import pin_then_fill, sample_quota, sample_topk, sample_weighted_topk, two_stage_sample, weighted_key
from .windows import groups_larger_than, number_duplicates, rank_latest

__all__ = [
    "avg_bigint",
    "broadcast_if_small",
    "count_distinct",
    "count_where",
    "distribution",
    "equal_freq_band",
    "equal_width_level",
    "exact_percentiles",
    "exclude",
    "flag_in",
    "global_ntile",
    "groups_larger_than",
    "keep_in",
    "min_where",
    "ntile_of",
    "number_duplicates",
    "number_within",
    "pin_then_fill",
    "rank_latest",
    "replicate",
    "row_count",
    "sample_quota",
    "sample_topk",
    "sample_weighted_topk",
    "share_of_total",
    "sum_or_zero",
    "two_stage_sample",
    "value_range",
    "weighted_key",
]

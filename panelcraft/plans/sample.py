"""Single-stage stratified sample, its history and comments, the id ledger, and the two-stage sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import range_label, range_labels
from ..operators import equal_width_level, exclude, keep_in, rank_latest, sample_quota, two_stage_sample, value_range
from ..operators.bloom import exclude_filtered
from ..params import WideParams
from ..sources import partition_range


def stratified_quota_sample(wide: DataFrame, wp: WideParams) -> DataFrame:
    """Fan-count strata (right-closed ranges) with a fixed quota each, drawn reproducibly."""
    hi = wp.fan_edges[-1]
    base = wide.where(
        F.col("item_id").isNotNull()
        & F.col("fans_num_no_unit").isNotNull()
        & (F.col("fans_num_no_unit") >= 0)
        & (F.col("fans_num_no_unit") <= hi)
    ).withColumn("fan_range", range_label("fans_num_no_unit", wp.fan_edges))
    quotas = dict(zip(range_labels(wp.fan_edges), wp.fan_quotas))
    return sample_quota(base, "fan_range", quotas, wp.seed, "fan_strata", ["item_id"])


def sampled_ids(sample: DataFrame) -> DataFrame:
    return sample.where(F.col("item_id").isNotNull()).select("item_id").distinct()


DAILY_HISTORY_COLUMNS = [
    "item_id",
    "shop_id",
    "sale_time",
    "insert_time",
    "root_category_id",
    "category_id",
    "cprice",
    "day_30_sales_volume",
    "day_sales_volume",
    "add_volume",
    "add_amount",
    "pt",
]


def daily_history(daily: DataFrame, ids: DataFrame, pt: tuple[str, str] | None = None) -> DataFrame:
    """All daily rows of the sampled items (in the partition range, if one is given), numbered
    newest first.

    Ties on (insert_time, pt) are broken by the remaining columns so the numbering is
    reproducible.
    """
    rows = partition_range(daily, *pt) if pt else daily
    d = keep_in(rows.select(*DAILY_HISTORY_COLUMNS), ids, "item_id")
    order = [
        F.col("insert_time").desc(),
        F.col("pt").desc(),
        *[F.col(c).asc() for c in ("cprice", "day_sales_volume", "day_30_sales_volume", "add_volume", "add_amount", "shop_id")],
    ]
    return rank_latest(d, "item_id", order, out="rn_desc")


def comments_of(comments: DataFrame, ids: DataFrame) -> DataFrame:
    """All comments of the sampled items."""
    return keep_in(comments.where(F.col("item_id").isNotNull()), ids, "item_id")


def ledger_rows(sample: DataFrame) -> DataFrame:
    """Distinct non-null ids of a finished sample, as appended to the exclusion ledger."""
    return sampled_ids(sample)


def _eligible_for_levels(wide: DataFrame, ledger: DataFrame, bloom: DataFrame | None = None) -> DataFrame:
    left = exclude(wide, ledger, "item_id") if bloom is None else exclude_filtered(wide, ledger, "item_id", bloom)
    return left.where(
        F.col("fans_num_no_unit").isNotNull()
        & (F.col("fans_num_no_unit") >= 0)
        & F.col("item_id").isNotNull()
        & F.col("item_shop_id").isNotNull()
    )


def fan_bounds(wide: DataFrame, ledger: DataFrame) -> DataFrame:
    """min / max fan count over rows not yet in the ledger."""
    return value_range(_eligible_for_levels(wide, ledger), "fans_num_no_unit", "min_fan", "max_fan")


def items_with_level(wide: DataFrame, ledger: DataFrame, levels: int, zero_to_one: bool = False, bloom: DataFrame | None = None) -> DataFrame:
    """Equal-width fan level of every row not yet sampled; the one-row bounds become literals.
    ``bloom``: a filter of the ledger's ids (``operators.bloom``), so that few rows meet a long ledger."""
    eligible = _eligible_for_levels(wide, ledger, bloom)
    b = value_range(eligible, "fans_num_no_unit", "lo", "hi").first()
    if b is None or b["lo"] is None:
        return eligible.withColumn("fan_level", F.lit(None).cast("bigint"))
    return eligible.withColumn("fan_level", equal_width_level(F.col("fans_num_no_unit"), b["lo"], b["hi"], levels, zero_to_one))


def two_stage(wide: DataFrame, ledger: DataFrame, wp: WideParams, bloom: DataFrame | None = None) -> DataFrame:
    """Per fan level ``shops_per_level`` random shops, then ``items_per_shop`` random items per shop."""
    lv = items_with_level(wide, ledger, wp.levels, wp.zero_to_one, bloom)
    return two_stage_sample(lv, "fan_level", "item_shop_id", wp.shops_per_level, wp.items_per_shop, wp.seed, ["item_id"])


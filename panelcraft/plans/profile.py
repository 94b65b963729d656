"""Profiling of the wide tables and the comment log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import has_image, label_order, marker_last_order, range_label, range_labels
from ..operators import count_where, distribution, exact_percentiles, groups_larger_than, keep_in, number_duplicates, share_of_total
from ..params import MISSING_MARKER
from ..sources import latest_partition, lookup
from .sample import DAILY_HISTORY_COLUMNS


def _fans_ok(df: DataFrame) -> DataFrame:
    return df.where(F.col("fans_num_no_unit").isNotNull() & (F.col("fans_num_no_unit") >= 0))


def range_histogram(wide: DataFrame, edges) -> DataFrame:
    """Items per fan range, in range order."""
    base = _fans_ok(wide).where(F.col("item_id").isNotNull())
    labelled = base.select("item_id", range_label("fans_num_no_unit", edges).alias("fan_range")).where(
        F.col("fan_range").isNotNull()
    )
    agg = labelled.groupBy("fan_range").agg(F.count("item_id").cast("bigint").alias("item_count"))
    return agg.orderBy(label_order("fan_range", range_labels(edges)))


def shops_by_rank_type(wide: DataFrame) -> DataFrame:
    return (
        wide.groupBy("rank_type")
        .agg(F.countDistinct("item_shop_id").cast("bigint").alias("shop_count"))
        .orderBy(F.col("shop_count").desc())
    )


def first_image_time_range(comments: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Earliest and latest per-item first picture-review time (all items, or those in ``ids``)."""
    c = comments
    if ids is not None:
        c = keep_in(c, ids.where(F.col("item_id").isNotNull()).select("item_id").distinct(), "item_id")
    per_item = c.where(has_image("comment_images", "raw")).groupBy("item_id").agg(
        F.min("comment_time").alias("first_img_comment_time")
    )
    return per_item.agg(
        F.min("first_img_comment_time").alias("earliest_first_img_comment_time"),
        F.max("first_img_comment_time").alias("latest_first_img_comment_time"),
    )


def sale_start_range(wide: DataFrame) -> DataFrame:
    return wide.where(F.col("start_sell_date").isNotNull()).agg(
        F.min("start_sell_date").alias("min_start_sell_date"), F.max("start_sell_date").alias("max_start_sell_date")
    )


RANK_TYPES = ["1", "2", "3", "4", MISSING_MARKER]


def fan_share_by_rank_type(wide: DataFrame) -> DataFrame:
    """Fans per rank type, the total over all rank types and the percentage; the marker sorts last."""
    base = wide.where(
        F.col("rank_type").isin(RANK_TYPES)
        & F.col("fans_num_no_unit").isNotNull()
        & (F.col("fans_num_no_unit") > 0)
        & F.col("item_shop_id").isNotNull()
    )
    out = share_of_total(base, "rank_type", "fans_num_no_unit", "total_fans", "all_fans", "percentage")
    return out.orderBy(marker_last_order("rank_type", MISSING_MARKER))


def marker_audit(wide: DataFrame) -> DataFrame:
    """Row counts and fan totals of the rows whose rank type is the missing marker."""
    m = wide.where(F.col("rank_type") == F.lit(MISSING_MARKER))
    return m.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_rows"),
        F.count("item_shop_id").cast("bigint").alias("non_null_shop_id"),
        F.count("fans_num_no_unit").cast("bigint").alias("non_null_fans"),
        count_where(F.col("fans_num_no_unit") > 0).alias("positive_fans_count"),
        F.sum("fans_num_no_unit").cast("bigint").alias("sum_fans"),
    )


def fan_distribution(wide: DataFrame) -> DataFrame:
    return distribution(_fans_ok(wide), "fans_num_no_unit")


PERCENTILES = {"p50_median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def fan_percentiles(wide: DataFrame) -> DataFrame:
    return exact_percentiles(_fans_ok(wide), "fans_num_no_unit", PERCENTILES)


def oversized_groups(wide: DataFrame, key: str = "item_shop_id", n: int = 3, limit: int = 1000) -> DataFrame:
    """Wide rows of keys with more than ``n`` rows, first ``limit`` by (key, item)."""
    return groups_larger_than(wide, key, n, [F.col(key).asc(), F.col("item_id").asc()], limit)


def oversized_comment_groups(comments: DataFrame, n: int = 3, limit: int = 1000) -> DataFrame:
    """Comments of items with more than ``n`` comments, first ``limit`` by (item, comment id)."""
    return groups_larger_than(comments, "item_id", n, [F.col("item_id").asc(), F.col("comment_id").asc()], limit)


def numbered_wide(wide: DataFrame, limit: int = 3000) -> DataFrame:
    """Wide rows numbered inside each item, first ``limit`` by (item, number)."""
    order = [F.col(c).asc() for c in ("first_img_comment_time", "item_shop_id", "start_sell_date", "shop_seller_id")]
    return number_duplicates(wide, "item_id", order, limit)


def numbered_duplicates(daily: DataFrame, limit: int = 3000) -> DataFrame:
    """Daily rows numbered inside each item (crawl order), first ``limit`` by (item, number)."""
    d = daily.select(*DAILY_HISTORY_COLUMNS)
    order = [
        F.col("insert_time").asc(),
        F.col("pt").asc(),
        *[F.col(c).asc() for c in ("cprice", "day_sales_volume", "day_30_sales_volume", "add_volume", "add_amount", "shop_id")],
    ]
    return number_duplicates(d, "item_id", order, limit)


def latest_daily_snapshot(daily: DataFrame) -> DataFrame:
    """Daily columns of the newest partition."""
    return latest_partition(daily.select(*DAILY_HISTORY_COLUMNS), "pt")


def latest_daily_preview(daily: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` rows, by all columns, of the newest partition."""
    return latest_daily_snapshot(daily).orderBy(*[F.col(c).asc() for c in DAILY_HISTORY_COLUMNS]).limit(n)


def comments_at_time(comments: DataFrame, ts: dt.datetime) -> DataFrame:
    """Picture comments (non-empty text) at one exact timestamp."""
    return lookup(comments, comment_time=ts.isoformat(sep=" ")).where(has_image("comment_images", "nonempty"))

"""Timing counts and wide item tables (first picture review vs sale start)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    day_string,
    days_between,
    gap_at_least,
    has_image,
    never_or_after,
    no_image,
    parse_day,
    str_date_le,
    valid_sale_start,
)
from ..operators import count_where, min_where, row_count
from ..params import WideParams
from ..sources import Sources
from ..sources.schemas import WIDE_ITEM_COLUMNS

SHOP_COLUMNS = [
    ("seller_id", "shop_seller_id"),
    ("rank", "rank"),
    ("rank_type", "rank_type"),
    ("main_industry", "main_industry"),
    ("good_comment_rate", "good_comment_rate"),
    ("status", "shop_status"),
    ("label_industry", "label_industry"),
    ("label_type", "label_type"),
    ("label_style", "label_style"),
    ("total_sales_volume", "shop_total_sales_volume"),
    ("total_sale", "shop_total_sale"),
    ("total_item_amount", "total_item_amount"),
    ("fans_num_no_unit", "fans_num_no_unit"),
]

WIDE_COLUMNS = [("item_shop_id" if c == "shop_id" else "item_cprice" if c == "cprice" else c) for c in WIDE_ITEM_COLUMNS] + [
    "img_comment_cnt",
    "no_img_comment_cnt",
    "first_img_comment_time",
    *[alias for _, alias in SHOP_COLUMNS],
    "first_img_comment_date_str",
    "days_diff",
]


SHOP_SUBSET = ["shop_id", *[c for c, _ in SHOP_COLUMNS]]
COMMENT_SUBSET = ["item_id", "seller_id", "comment_id", "comment_content", "comment_images", "comment_sku", "comment_time"]


def item_master_columns(items: DataFrame) -> DataFrame:
    """The 31 item-master columns the wide tables carry (column pruning reaches the scan)."""
    return items.select(*WIDE_ITEM_COLUMNS)


def shop_columns(shops: DataFrame) -> DataFrame:
    """The 14 shop columns the wide tables carry."""
    return shops.select(*SHOP_SUBSET)


def comments_with_images(comments: DataFrame) -> DataFrame:
    """The 7 comment columns, picture reviews only (the unfinished ``WHERE comment_images`` read
    as the default picture test)."""
    return comments.select(*COMMENT_SUBSET).where(has_image("comment_images", "trimmed_n"))


def first_image_time(comments: DataFrame, variant: str) -> DataFrame:
    """Per item, the earliest comment carrying pictures."""
    return (
        comments.where(has_image("comment_images", variant))
        .groupBy("item_id")
        .agg(F.min("comment_time").alias("first_img_comment_time"))
    )


def date_mismatch_count(src: Sources) -> DataFrame:
    """Items whose first picture-review day (as text) differs from the sale-start text."""
    v = src.items.where(valid_sale_start(reject_empty_list=True)).select("item_id", "start_sell_date")
    f = first_image_time(src.comments, "trimmed")
    t = v.join(f, "item_id").where(F.col("start_sell_date") != day_string("first_img_comment_time"))
    return row_count(t, "item_count")


def late_image_count(src: Sources, wp: WideParams) -> DataFrame:
    """Items whose first picture review is on/after the sale start and at least ``late_days`` later."""
    v = src.items.where(valid_sale_start()).select("item_id", "start_sell_date")
    f = first_image_time(src.comments, "trimmed")
    sale = parse_day("start_sell_date", wp.sale_date_format)
    t = v.join(f, "item_id").select("item_id", sale.alias("first_actual_sale_date"), "first_img_comment_time")
    t = t.where(
        (F.col("first_img_comment_time") >= F.col("first_actual_sale_date"))
        & gap_at_least("first_img_comment_time", "first_actual_sale_date", wp.late_days)
    )
    return row_count(t, "item_count")


def comment_image_stats(comments: DataFrame) -> DataFrame:
    """Per item, in one scan: picture reviews, other reviews, first picture-review time."""
    pic = has_image("comment_images", "trimmed_n")
    return comments.groupBy("item_id").agg(
        count_where(pic).alias("img_comment_cnt"),
        count_where(no_image("comment_images")).alias("no_img_comment_cnt"),
        min_where(pic, "comment_time").alias("first_img_comment_time"),
    )


def _item_cols(i: str = "item") -> list:
    out = []
    for c in WIDE_ITEM_COLUMNS:
        alias = "item_shop_id" if c == "shop_id" else "item_cprice" if c == "cprice" else c
        out.append(F.col(f"{i}.{c}").alias(alias))
    return out


def _shop_cols(s: str = "shop") -> list:
    return [F.col(f"{s}.{c}").alias(a) for c, a in SHOP_COLUMNS]


def wide_items(src: Sources, wp: WideParams) -> DataFrame:
    """49-column wide table: items with a first picture review ``min_days`` or more after the sale start."""
    stats = comment_image_stats(src.comments).alias("st")
    item = src.items.alias("item")
    shop = src.shops.alias("shop")
    sale = parse_day(F.col("item.start_sell_date"), wp.sale_date_format)
    first = F.col("st.first_img_comment_time")
    joined = item.join(stats, F.col("item.item_id") == F.col("st.item_id")).join(
        shop, F.col("item.shop_id") == F.col("shop.shop_id")
    )
    filtered = joined.where(
        (F.col("item.start_sell_volume") > 0)
        & F.col("item.start_sell_date").isNotNull()
        & (F.trim(F.col("item.start_sell_date")) != "")
        & first.isNotNull()
        & (first >= sale)
        & gap_at_least(first, sale, wp.min_days)
    )
    return filtered.select(
        *_item_cols(),
        F.col("st.img_comment_cnt"),
        F.col("st.no_img_comment_cnt"),
        first.alias("first_img_comment_time"),
        *_shop_cols(),
        day_string(first).alias("first_img_comment_date_str"),
        days_between(first, sale).alias("days_diff"),
    )


def control_items(src: Sources, wp: WideParams) -> DataFrame:
    """Same 49 columns for items on sale by ``sale_by`` with no picture review up to ``cutoff``.

    One pass over the comments gives both the first picture time and the counts (the
    original scans the comments twice); outer-joined, with counts zero-filled.
    """
    stats = comment_image_stats(src.comments).alias("st")
    item = src.items.alias("item")
    shop = src.shops.alias("shop")
    first = F.col("st.first_img_comment_time")
    joined = item.join(shop, F.col("item.shop_id") == F.col("shop.shop_id")).join(
        stats, F.col("item.item_id") == F.col("st.item_id"), "left"
    )
    filtered = joined.where(
        F.col("item.start_sell_date").isNotNull()
        & str_date_le(F.col("item.start_sell_date"), wp.sale_by)
        & never_or_after(first, wp.cutoff)
    )
    sale = parse_day(F.col("item.start_sell_date"), wp.control_date_format)
    return filtered.select(
        *_item_cols(),
        F.coalesce(F.col("st.img_comment_cnt"), F.lit(0)).cast("bigint").alias("img_comment_cnt"),
        F.coalesce(F.col("st.no_img_comment_cnt"), F.lit(0)).cast("bigint").alias("no_img_comment_cnt"),
        first.alias("first_img_comment_time"),
        *_shop_cols(),
        day_string(first).alias("first_img_comment_date_str"),
        F.when(first.isNotNull(), days_between(first, sale)).alias("days_diff"),
    )

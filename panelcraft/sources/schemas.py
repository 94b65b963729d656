"""Typed schemas of the four source tables (the columns the library reads) and the wide table.

Ids, counts and money are BIGINT in the sources; the typed wide-table sink stores ids as
STRING and money as DOUBLE, and the cast happens only there (``sinks.create_table``).
"""

from __future__ import annotations

from pyspark.sql import types as T

L, S, D, TS = T.LongType(), T.StringType(), T.DoubleType(), T.TimestampType()


def _schema(fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True, {"comment": c} if c else {}) for n, t, c in fields])


# Item master: the 31 columns of the wide table plus the four read by the study.
ITEM_FIELDS = [
    ("item_id", L, "item id"),
    ("title", S, "item title"),
    ("pic_url", S, "main picture url"),
    ("pic_url_list", S, "carousel picture urls"),
    ("category_id", L, "category id"),
    ("category_name", S, "category name"),
    ("shop_id", L, "shop id"),
    ("sale_time", TS, "listing time"),
    ("cprice", L, "promotion price"),
    ("collect", L, "favourites"),
    ("comment_count", L, "reviews"),
    ("first_day_sales_volume", L, "first-day units"),
    ("first_day_sale", L, "first-day revenue"),
    ("first_week_sales_volume", L, "first-week units"),
    ("first_week_sale", L, "first-week revenue"),
    ("first_month_sales_volume", L, "first-month units"),
    ("first_month_sale", L, "first-month revenue"),
    ("first_day_collect", L, "first-day favourites"),
    ("sale_day", L, "units yesterday"),
    ("sale_7day", L, "units last 7 days"),
    ("sale_30day", L, "units last 30 days"),
    ("total_sale_volume", L, "total units"),
    ("total_sale_amount", L, "total revenue"),
    ("first_insert_time", TS, "first crawl time"),
    ("video_url", S, "video url"),
    ("bad_rate", D, "current bad-review rate"),
    ("properties", S, "attributes"),
    ("bad_comment_count", L, "bad reviews"),
    ("start_sell_volume", L, "units on the first selling day"),
    ("start_sell_date", S, "first selling day (text)"),
    ("start_sell_amount", L, "revenue on the first selling day"),
    ("usual_cprice", L, "usual price"),
    ("max_bad_rate", D, "highest bad-review rate"),
    ("nearly_sale_time", TS, "latest listing time"),
]
ITEM = _schema(ITEM_FIELDS)

# The 31 item columns the wide tables carry, in order.
WIDE_ITEM_COLUMNS = [f[0] for f in ITEM_FIELDS[:31]]

DAILY = _schema(
    [
        ("item_id", L, "item id"),
        ("shop_id", L, "shop id"),
        ("sale_time", TS, "listing time"),
        ("insert_time", TS, "crawl time"),
        ("root_category_id", L, "root category id"),
        ("category_id", L, "category id"),
        ("cprice", L, "promotion price"),
        ("day_30_sales_volume", L, "30-day cumulative units"),
        ("day_sales_volume", L, "units that day"),
        ("day_sales_amount", L, "revenue that day"),
        ("add_volume", L, "cumulative units"),
        ("add_amount", L, "cumulative revenue"),
        ("pt", S, "partition day yyyymmdd"),
    ]
)
DAILY_COLUMNS = [
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

SHOP = _schema(
    [
        ("shop_id", L, "shop id"),
        ("seller_id", L, "seller id"),
        ("rank", L, "shop level 1-6"),
        ("rank_type", S, "level type"),
        ("main_industry", S, "main industry"),
        ("good_comment_rate", D, "good-review rate"),
        ("status", L, "0 invalid, 1 valid"),
        ("label_industry", S, "labelled industry"),
        ("label_type", S, "labelled type"),
        ("label_style", S, "labelled style"),
        ("total_sales_volume", L, "total units"),
        ("total_sale", L, "total revenue"),
        ("total_item_amount", L, "items listed"),
        ("fans_num_no_unit", L, "followers"),
    ]
)

COMMENT = _schema(
    [
        ("item_id", L, "item id"),
        ("seller_id", L, "seller id"),
        ("comment_id", L, "comment id"),
        ("comment_content", S, "text"),
        ("comment_seller_name", S, "anonymised reviewer"),
        ("comment_images", S, "picture list (text)"),
        ("comment_sku", S, "sku"),
        ("comment_time", TS, "comment time"),
        ("version", S, "version"),
    ]
)

# Declared column types of the typed wide table (ids STRING, money DOUBLE).
WIDE_TABLE_TYPES = {
    "item_id": "string",
    "category_id": "string",
    "item_shop_id": "string",
    "item_cprice": "double",
    "first_day_sale": "double",
    "first_week_sale": "double",
    "first_month_sale": "double",
    "total_sale_amount": "double",
    "start_sell_amount": "double",
    "shop_seller_id": "string",
    "rank_type": "string",
    "shop_status": "string",
    "shop_total_sale": "double",
}

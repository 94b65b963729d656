"""The four source tables reproduced from the driver's synthetic TPC-H-like parquet files.

Each source column is one SQL expression over a driver table.  The expressions are written
in the common subset of Spark SQL and DuckDB SQL, so the Spark sources (``F.expr``) and the
DuckDB oracle views are built from the very same text; only the timestamp type name
differs (``{ts}``).  ``chr(92)`` writes the backslash because the engines read ``'\\\\N'``
differently.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SALE_DATE = "(date '1995-01-01' + cast(p_partkey % 1000 as int))"

ITEM_EXPR = {
    "item_id": "p_partkey",
    "title": "p_name",
    "pic_url": "concat('x', cast(p_partkey as string))",
    "pic_url_list": "case when p_partkey % 4 = 0 then '[]' else concat('[\"p/', cast(p_partkey as string), '\"]') end",
    "category_id": "cast(floor((p_size - 1) / 10.0) as bigint)",
    "category_name": "concat('SIZE-', cast(cast(floor((p_size - 1) / 10.0) as bigint) as string))",
    "shop_id": "p_partkey % 10",
    "sale_time": f"cast({_SALE_DATE} as {{ts}})",
    "cprice": "case when p_partkey % 10 = 0 then null else cast(round(p_retailprice * 90) as bigint) end",
    "collect": "p_partkey % 50",
    "comment_count": "p_partkey % 30",
    "first_day_sales_volume": "p_partkey % 3",
    "first_day_sale": "p_partkey % 300",
    "first_week_sales_volume": "p_partkey % 9",
    "first_week_sale": "p_partkey % 900",
    "first_month_sales_volume": "p_partkey % 27",
    "first_month_sale": "p_partkey % 2700",
    "first_day_collect": "p_partkey % 8",
    "sale_day": "p_partkey % 4",
    "sale_7day": "p_partkey % 14",
    "sale_30day": "p_partkey % 60",
    "total_sale_volume": "p_partkey % 100",
    "total_sale_amount": "p_partkey % 10000",
    "first_insert_time": f"cast({_SALE_DATE} as {{ts}})",
    "video_url": "concat('v', cast(p_partkey as string))",
    "bad_rate": "cast(p_partkey % 100 as double) / 100",
    "properties": "p_type",
    "bad_comment_count": "p_partkey % 6",
    "start_sell_volume": "case when p_partkey % 11 = 0 then null else p_partkey % 7 end",
    "start_sell_date": (
        "case when p_partkey % 17 = 0 then null when p_partkey % 13 = 0 then ' ' "
        f"when p_partkey % 19 = 0 then '[]' when p_partkey % 23 = 0 then replace(cast({_SALE_DATE} as string), '-', '') "
        f"else cast({_SALE_DATE} as string) end"
    ),
    "start_sell_amount": "p_partkey % 70",
    "usual_cprice": "case when p_partkey % 5 = 0 then null else cast(round(p_retailprice * 100) as bigint) end",
    "max_bad_rate": "cast(p_partkey % 100 as double) / 50",
    "nearly_sale_time": f"cast((date '1995-01-01' + cast(p_partkey % 1000 + 30 as int)) as {{ts}})",
}

DAILY_EXPR = {
    "item_id": "l_partkey",
    "shop_id": "l_partkey % 10",
    "sale_time": "l_shipdate",
    "insert_time": "l_shipdate",
    "root_category_id": "l_partkey % 2",
    "category_id": "l_partkey % 5",
    "cprice": "cast(round(l_extendedprice * 100 / l_quantity) as bigint)",
    "day_30_sales_volume": "cast(l_quantity * 3 as bigint)",
    "day_sales_volume": "case when l_returnflag = 'R' then cast(0 as bigint) else cast(l_quantity as bigint) end",
    "day_sales_amount": "cast(round(l_extendedprice) as bigint)",
    "add_volume": "l_orderkey % 1000",
    "add_amount": "l_orderkey % 10000",
    "pt": "case when l_orderkey % 503 = 0 then '' else replace(cast(cast(l_shipdate as date) as string), '-', '') end",
}

COMMENT_EXPR = {
    "item_id": "case when o_orderkey % 101 = 0 then null else o_custkey end",
    "seller_id": "o_custkey % 10",
    "comment_id": "o_orderkey",
    "comment_content": "o_orderstatus",
    "comment_seller_name": "concat('u', cast(o_orderkey % 97 as string))",
    "comment_images": (
        "case when o_orderpriority = '1-URGENT' then '[\"u.jpg\"]' "
        "when o_orderpriority = '2-HIGH' then (case when o_orderkey % 2 = 0 then '[]' else ' [] ' end) "
        "when o_orderpriority = '3-MEDIUM' then (case when o_orderkey % 2 = 0 then '' else ' ' end) "
        "when o_orderpriority = '4-NOT SPECIFIED' then concat(chr(92), 'N') else null end"
    ),
    "comment_sku": "concat('s', cast(o_orderkey % 5 as string))",
    "comment_time": "o_orderdate",
    "version": "'v1'",
}

SHOP_EXPR = {
    "shop_id": "s_suppkey",
    "seller_id": "s_suppkey + 1000",
    "rank": "cast(s_nationkey % 6 + 1 as bigint)",
    "rank_type": "case when s_suppkey = 3 then concat(chr(92), 'N') else cast(s_nationkey % 4 + 1 as string) end",
    "main_industry": "concat('ind', cast(s_nationkey % 3 as string))",
    "good_comment_rate": "cast(s_nationkey as double) / 25",
    "status": "s_suppkey % 2",
    "label_industry": "concat('li', cast(s_nationkey % 5 as string))",
    "label_type": "concat('lt', cast(s_suppkey % 3 as string))",
    "label_style": "concat('ls', cast(s_suppkey % 4 as string))",
    "total_sales_volume": "s_suppkey * 100",
    "total_sale": "s_suppkey * 1000",
    "total_item_amount": "s_suppkey * 10",
    "fans_num_no_unit": "cast(round(s_acctbal * 100) as bigint)",
}

# (view name, driver table, expressions); whole tables, no row filters.  Every supplier is a
# shop; items reference shops 0-9 (p_partkey % 10), the other shops stay unmatched.
VIEWS = [
    ("items", "part", ITEM_EXPR),
    ("daily", "lineitem", DAILY_EXPR),
    ("comments", "orders", COMMENT_EXPR),
    ("shops", "supplier", SHOP_EXPR),
]


def view_sql(name: str, ts_type: str) -> str:
    """SELECT text of one source view over its driver table."""
    for view, table, exprs in VIEWS:
        if view == name:
            cols = ",\n  ".join(f"{e.format(ts=ts_type)} AS {c}" for c, e in exprs.items())
            return f"SELECT\n  {cols}\nFROM {table}"
    raise KeyError(name)


@dataclass(frozen=True)
class Sources:
    """The four source tables the library operates on."""

    items: DataFrame
    daily: DataFrame
    comments: DataFrame
    shops: DataFrame


def _project(df: DataFrame, exprs: dict) -> DataFrame:
    return df.select(*[F.expr(e.format(ts="timestamp_ntz")).alias(c) for c, e in exprs.items()])


def fixture_sources(spark: SparkSession, sf_dir: str) -> Sources:
    """Lazily project the driver's parquet tables into the four source tables."""
    out = {}
    for view, table, exprs in VIEWS:
        out[view] = _project(spark.read.parquet(f"{sf_dir}/{table}.parquet"), exprs)
    return Sources(**out)

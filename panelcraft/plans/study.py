"""Multistage sample (shops -> cells -> items), post-condition checks and the final study tables."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import add_days, date_between, day_range, days_between
from ..operators import (
    broadcast_if_small,
    equal_freq_band,
    flag_in,
    global_ntile,
    keep_in,
    pin_then_fill,
    replicate,
    sample_quota,
    sample_weighted_topk,
)
from ..functions.labels import size_label
from ..params import SIZE_LABELS, StudyParams
from ..session import freeze
from .cohort import Cohort

CELL = ["shop_id", "category_id", "price_band"]


def _recent(item_shop: DataFrame) -> DataFrame:
    """Recent sales per (item, shop) with recent panel rows, from ``item_shop_stats``."""
    return item_shop.where(F.col("recent_rows") > 0).select("item_id", "shop_id", F.col("recent_sales").alias("_s"))


def _item_multiplicity(universe: DataFrame) -> DataFrame:
    return universe.groupBy("item_id").agg(F.count(F.lit(1)).cast("bigint").alias("_m"))


def shop_sales(item_shop: DataFrame, universe: DataFrame) -> DataFrame:
    """Recent sales per shop over universe items; an item listed twice counts twice (quirk Q2).

    The panel was summed per (item, shop) - one row per item instead of one per day - and only
    then meets the universe's per-item multiplicity.
    """
    joined = _recent(item_shop).join(_item_multiplicity(universe), "item_id")
    return joined.groupBy("shop_id").agg(F.sum(F.col("_s") * F.col("_m")).cast("bigint").alias("sales_3m"))


def shop_size(sales: DataFrame) -> DataFrame:
    """Sales terciles over all shops (largest first), computed without a one-partition window."""
    order = [F.col("sales_3m").desc_nulls_last(), F.col("shop_id").asc()]
    b = global_ntile(sales, order, 3, out="size_bucket")
    return b.withColumn("shop_size", size_label("size_bucket", SIZE_LABELS))


def sample_shops(sizes: DataFrame, p: StudyParams) -> DataFrame:
    """``n_shops`` shops, quota per size bucket (big/mid rounded, small takes the remainder)."""
    q_big, q_mid, q_small = p.quotas()
    out = sample_quota(sizes, "size_bucket", {1: q_big, 2: q_mid, 3: q_small}, p.seed, "shops", ["shop_id"])
    return out.select("shop_id", "sales_3m", "shop_size")


def cell_items_flagged(universe: DataFrame, treated: DataFrame) -> DataFrame:
    return flag_in(universe, treated, "item_id", "is_eligible_treated")


def shop_cells(item_shop: DataFrame, universe: DataFrame, treated: DataFrame) -> DataFrame:
    """Per shop x category x price band: recent sales and the count of eligible treated rows.

    Sales are keyed by the daily row's shop, counts by the item's shop (quirk Q12); the two
    meet in an inner join on the three keys.
    """
    u = cell_items_flagged(universe, treated)
    cell_sales = (
        _recent(item_shop).join(u.select("item_id", "category_id", "price_band"), "item_id")
        .groupBy("shop_id", "category_id", "price_band")
        .agg(F.sum("_s").cast("bigint").alias("cell_sales_3m"))
    )
    treated_cnt = u.groupBy(*CELL).agg(F.sum("is_eligible_treated").cast("bigint").alias("eligible_treated_cnt"))
    return cell_sales.join(treated_cnt, CELL).select(*CELL, "cell_sales_3m", "eligible_treated_cnt")


def sample_cells(cells: DataFrame, shops: DataFrame, p: StudyParams, zero: str = "last") -> DataFrame:
    """Per sampled shop, ``cells_per_shop`` cells drawn by recent-sales weight among cells with
    enough treated rows.  ``zero='last'`` (design A) puts zero-sales cells last; ``'unit'``
    (design B) gives them weight 1."""
    cand = keep_in(cells, shops.select("shop_id"), "shop_id").where(
        F.col("eligible_treated_cnt") >= p.min_treated_in_cell
    )
    stage = "cells_a" if zero == "last" else "cells_b"
    out = sample_weighted_topk(
        cand, ["shop_id"], "cell_sales_3m", p.cells_per_shop, p.seed, stage, ["category_id", "price_band"], zero=zero
    )
    return out.select(*CELL, "cell_sales_3m", "eligible_treated_cnt")


def sample_items(universe: DataFrame, cells: DataFrame, treated: DataFrame, p: StudyParams) -> DataFrame:
    """Per sampled cell: ``pin`` random treated rows, then ``fill`` random rows from the rest."""
    ci = cell_items_flagged(universe, treated).join(cells.select(*CELL), CELL)
    out = pin_then_fill(ci, CELL, "is_eligible_treated", p.pin, p.fill, p.seed, ["item_id", "elig_type"], key="item_id")
    return out.select("item_id", *CELL)


# --- post-condition checks ----------------------------------------------------------


def check_sample_size(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_items"), F.countDistinct("shop_id").cast("bigint").alias("n_shops")
    )


def check_count(df: DataFrame, keys: list[str], expected: int, out: str) -> DataFrame:
    """Groups whose row count differs from ``expected`` (reported, not raised)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias(out)).where(F.col(out) != expected)


# --- final tables ---------------------------------------------------------------------


def anchor_snapshot(sampled: DataFrame, treated: DataFrame, daily: DataFrame, p: StudyParams) -> DataFrame:
    """Anchor day g-1 (treated) or E-1 (others); price and cumulative sales crawled on that day.

    Every crawl row of the anchor day is kept (quirk Q3), or one row per item with
    ``p.dedupe``.  The daily table first meets the distinct (item, anchor day) keys in an inner
    join (broadcast if their counted number is small); the outer join then runs between two
    small tables.  With ``p.pt_slack_days`` the partitions of the anchor days alone (and of the
    slack around each) are read: the daily table is semi-joined on ``pt`` to those days, which
    Spark turns into dynamic partition pruning.
    """
    base = sampled.join(treated.select("item_id", "g"), "item_id", "left").select(
        "item_id",
        "shop_id",
        "category_id",
        "price_band",
        "g",
        F.when(F.col("g").isNotNull(), add_days("g", -1)).otherwise(F.lit(p.end - dt.timedelta(days=1))).alias("anchor_date"),
    )
    keys = base.select("item_id", "anchor_date").distinct()
    small = broadcast_if_small(keys)
    # The join only matches crawl days between the earliest and latest anchor day: that range,
    # written on the raw timestamp, is implied by the join (so exact) and reaches the scan,
    # where file statistics skip everything outside it.
    bounds = small.agg(F.min("anchor_date").alias("lo"), F.max("anchor_date").alias("hi")).first()
    d = daily
    if bounds is not None and bounds["lo"] is not None:
        d = d.where(day_range("insert_time", bounds["lo"], bounds["hi"]))
        pt = p.pt_range(bounds["lo"], bounds["hi"])
        if pt:
            d = d.join(F.broadcast(anchor_partitions(small, p.pt_slack_days, pt)), "pt", "left_semi")
    hits = d.select(
        "item_id",
        F.to_date("insert_time").alias("anchor_date"),
        F.col("cprice").alias("anchor_price"),
        F.col("day_30_sales_volume").alias("day_30_sales_volume_gm1"),
        F.col("add_volume").alias("add_volume_gm1"),
    ).join(small, ["item_id", "anchor_date"])
    snap = base.join(hits, ["item_id", "anchor_date"], "left")
    snap = snap.select(
        "item_id", "shop_id", "category_id", "g", "anchor_date", "anchor_price", "day_30_sales_volume_gm1", "add_volume_gm1"
    )
    if not p.dedupe:
        return snap
    rest = [c for c in snap.columns if c != "item_id"]  # NULL is the least of a struct field
    one = snap.groupBy("item_id").agg(F.min(F.struct(*rest)).alias("_one"))
    return one.select("item_id", *[F.col(f"_one.{c}") for c in rest])


def anchor_partitions(keys: DataFrame, slack: int, pt: tuple[str, str]) -> DataFrame:
    """The partition days (yyyymmdd) that can hold crawls of the anchor days: at most as many rows
    as the study has days and twice the slack."""
    around = F.sequence(F.date_sub("anchor_date", slack), F.date_add("anchor_date", slack))
    days = keys.select("anchor_date").distinct().select(F.explode(around).alias("day"))
    return days.select(F.date_format("day", "yyyyMMdd").alias("pt")).where(F.col("pt").between(*pt)).distinct()


def crawl_rows_outside_slack(daily: DataFrame, p: StudyParams) -> int:
    """Daily rows whose partition lies further than ``p.pt_slack_days`` from their crawl day (or
    is not a day): 0 means that pruning partitions by the slack loses nothing."""
    day = F.try_to_date("pt", "yyyyMMdd")
    far = F.abs(F.datediff(F.to_date("insert_time"), day)) > p.pt_slack_days
    return daily.where(F.coalesce(far, F.lit(True)) & F.col("insert_time").isNotNull()).count()


FINAL_ITEM_COLUMNS = [
    "item_id",
    "shop_id",
    "category_id",
    "category_name",
    "price_band",
    "properties",
    "pic_url",
    "pic_url_list",
    "first_day_sales_volume",
    "first_week_sales_volume",
    "first_month_sales_volume",
    "start_sell_date",
    "nearly_sale_time",
    "sale_time",
]


def final_item(snapshot: DataFrame, items: DataFrame, bands: int, keep=None) -> DataFrame:
    """Item attributes with the price band re-cut on the anchor price inside the category.

    Missing anchor prices sort first (quirk Q8).  The item master is reduced to the sampled
    items by a semi-join before the join.  ``keep`` stores the joined rows before
    banding (read by the sizing and the banding).
    """
    ids = broadcast_if_small(snapshot.select("item_id").distinct())
    it = keep_in(items, ids, "item_id").select(
        "item_id",
        "shop_id",
        "category_id",
        "category_name",
        "properties",
        "pic_url",
        "pic_url_list",
        "first_day_sales_volume",
        "first_week_sales_volume",
        "first_month_sales_volume",
        "start_sell_date",
        "nearly_sale_time",
        "sale_time",
    )
    joined = snapshot.select("item_id", "anchor_price").join(it, "item_id")
    if keep is not None:
        joined = keep(joined)
    order = [F.col("anchor_price").asc_nulls_first(), F.col("item_id").asc()]
    banded = equal_freq_band(joined, ["category_id"], order, bands, out="price_band")
    return banded.select(*FINAL_ITEM_COLUMNS)


def final_shop(fi: DataFrame, shops: DataFrame) -> DataFrame:
    """Shop attributes of the sampled shops (left join: a shop missing from the dimension keeps NULLs)."""
    x = fi.select("shop_id").distinct()
    s = shops.select(
        "shop_id",
        "seller_id",
        "rank_type",
        F.col("fans_num_no_unit").alias("fan_num"),
        "main_industry",
        "good_comment_rate",
        F.col("total_sales_volume").alias("shop_total_sales_volume"),
        "total_item_amount",
    )
    return x.join(s, "shop_id", "left")


def final_item_comment(comments: DataFrame, fi: DataFrame, treated: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Comments of sampled treated items within g +- W, with item review statistics.

    The sampled treated items are reduced to one row per (item, g) with its multiplicity,
    joined to the comments by item and interval bin (broadcast if their counted number is small),
    and the multiplicity is restored afterwards - the same rows as joining the duplicated list.
    """
    ts = fi.select("item_id").join(treated.select("item_id", "g"), "item_id")
    ts = ts.groupBy("item_id", "g").agg(F.count(F.lit(1)).alias("_m"))
    # interval bins: a day's bin is its number div W, an event meets the three bins that its window
    # touches, so the comments of a much reviewed item are dealt over many tasks
    width = max(window, 1)
    bin_of = lambda day: F.floor(F.unix_date(day) / F.lit(width)).cast("int")
    bins = F.sequence(bin_of(add_days("g", -window)), bin_of(add_days("g", window)))
    ts = broadcast_if_small(ts.withColumn("_bin", F.explode(bins)))
    # exact range implied by the window condition, pushed to the comment scan
    bounds = ts.agg(F.min("g").alias("lo"), F.max("g").alias("hi")).first()
    if bounds is not None and bounds["lo"] is not None:
        comments = comments.where(
            day_range("comment_time", bounds["lo"] - dt.timedelta(days=window), bounds["hi"] + dt.timedelta(days=window))
        )
    day = F.to_date("comment_time")
    c = comments.withColumn("_bin", bin_of(day)).join(ts, ["item_id", "_bin"])
    c = c.where(day.between(add_days("g", -window), add_days("g", window)))
    c = replicate(c, "_m")
    stats = keep_in(items, ts.select("item_id"), "item_id").select(
        "item_id", F.col("comment_count").alias("rcomment_count"), "max_bad_rate", "bad_rate"
    )
    return c.join(stats, "item_id", "left").select(
        "item_id",
        "comment_id",
        F.col("comment_seller_name").alias("reviewer_id"),
        "comment_time",
        "comment_images",
        "rcomment_count",
        "max_bad_rate",
        "bad_rate",
        "comment_content",
    )


def daily_comments(comments: DataFrame) -> DataFrame:
    """Comments per item and day (aggregated map-side, so a popular item is combined early)."""
    return comments.groupBy("item_id", F.to_date("comment_time").alias("pt")).agg(
        F.count(F.lit(1)).cast("bigint").alias("daily_comment_cnt")
    )


def final_item_day(
    panel: DataFrame, t0: DataFrame, g: DataFrame, comments: DataFrame, fi: DataFrame, snapshot: DataFrame, p: StudyParams
) -> DataFrame:
    """Full panel of the sampled items with t0, g, event time, item age, outcome, price,
    anchor snapshot and comment count (0-filled).

    Rows multiply like the original's joins by item (quirk Q3).  Every large input (panel,
    t0, g, comments) is first reduced to the sampled items with a semi-join on the id list.
    """
    ids = broadcast_if_small(fi.select("item_id").distinct())
    mult = broadcast_if_small(fi.groupBy("item_id").agg(F.count(F.lit(1)).alias("_m")))
    panel = panel.where(date_between("pt", p.start, p.end)).join(mult, "item_id")
    panel = replicate(panel, "_m").select(
        "item_id", "shop_id", "pt", "day_sales_volume", F.col("cprice").alias("price")
    )
    t0 = keep_in(t0, ids, "item_id")
    g = keep_in(g, ids, "item_id")
    snap = snapshot.select("item_id", "day_30_sales_volume_gm1", "add_volume_gm1")
    # only comment days inside the panel window can meet a panel row
    dc = daily_comments(keep_in(comments.where(day_range("comment_time", p.start, p.end)), ids, "item_id"))
    out = panel.join(t0, "item_id", "left").join(g, "item_id", "left").join(snap, "item_id", "left")
    out = out.join(dc, ["item_id", "pt"], "left")
    return out.select(
        "item_id",
        "pt",
        F.col("t0").alias("first_actual_sale_date"),
        F.col("g").alias("first_img_comment_date"),
        F.when(F.col("g").isNotNull(), days_between("pt", "g")).alias("event_time"),
        F.when(F.col("t0").isNotNull(), days_between("pt", "t0")).alias("item_age"),
        F.col("day_sales_volume").alias("outcome_day_sales_volume"),
        "price",
        "day_30_sales_volume_gm1",
        "add_volume_gm1",
        F.coalesce(F.col("daily_comment_cnt"), F.lit(0)).cast("bigint").alias("daily_comment_cnt"),
    )


class Study:
    """The multistage sample and final tables of one design (A: zero-sales cells last; B: unit weight).

    Each step is built once per instance.  Steps of one row per shop, cell or drawn item are
    read by several later steps, so they are written to the checkpoint folder once (``keep``)
    instead of recomputing the chain for every consumer.
    """

    def __init__(self, cohort: Cohort, design: str = "A", keep=None):
        self.c = cohort
        self.p = cohort.p
        self.design = design
        self.keep = keep if keep is not None else freeze

    @cached_property
    def shop_sales(self) -> DataFrame:
        return self.keep(shop_sales(self.c.item_shop, self.c.universe))

    @cached_property
    def shop_size(self) -> DataFrame:
        return shop_size(self.shop_sales)

    @cached_property
    def sampled_shops(self) -> DataFrame:
        return self.keep(sample_shops(self.shop_size, self.p))

    @cached_property
    def cells(self) -> DataFrame:
        return self.keep(shop_cells(self.c.item_shop, self.c.universe, self.c.treated))

    @cached_property
    def sampled_cells(self) -> DataFrame:
        return self.keep(sample_cells(self.cells, self.sampled_shops, self.p, zero="last" if self.design == "A" else "unit"))

    @cached_property
    def sampled_items(self) -> DataFrame:
        return self.keep(sample_items(self.c.universe, self.sampled_cells, self.c.treated, self.p))

    @cached_property
    def snapshot(self) -> DataFrame:
        return self.keep(anchor_snapshot(self.sampled_items, self.c.treated, self.c.src.daily, self.p))

    @cached_property
    def final_item(self) -> DataFrame:
        return self.keep(final_item(self.snapshot, self.c.src.items, self.p.final_bands, keep=self.keep))

    @cached_property
    def final_shop(self) -> DataFrame:
        return final_shop(self.final_item, self.c.src.shops)

    @cached_property
    def final_item_comment(self) -> DataFrame:
        return final_item_comment(self.c.src.comments, self.final_item, self.c.treated, self.c.src.items, self.p.window)

    @cached_property
    def final_item_day(self) -> DataFrame:
        c = self.c
        return final_item_day(c.panel, c.t0, c.g, c.src.comments, self.final_item, self.snapshot, self.p)

"""Event-study cohort: item-day panel, first sale (t0), first picture review (g), eligibility, universe."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import add_days, date_between, day_range, gap_at_least, has_image
from ..operators import avg_bigint, count_where, equal_freq_band, exclude, sum_or_zero
from ..params import StudyParams
from ..session import freeze
from ..sources import Sources, partition_range


def item_day(daily: DataFrame, p: StudyParams, keep: list[str] | None = None) -> DataFrame:
    """One-year item-day panel: crawl day as ``pt`` (DATE), sales, price, categories.

    Every crawl row is kept (an item may have several rows on a day, quirk Q9).  The day
    range is written on the raw timestamp so it reaches the scan as a pushed filter; with
    ``p.pt_slack_days`` a ``pt`` text range around it prunes partitions.  ``keep``: further columns.
    """
    pt = p.pt_range(p.start, p.end)
    d = partition_range(daily, *pt) if pt else daily
    d = d.where(F.col("item_id").isNotNull() & F.col("shop_id").isNotNull() & day_range("insert_time", p.start, p.end))
    return d.select(
        "item_id",
        "shop_id",
        F.to_date("insert_time").alias("pt"),
        "day_sales_volume",
        "cprice",
        "category_id",
        "root_category_id",
        *(keep or []),
    )


def first_sale(panel: DataFrame) -> DataFrame:
    """t0: per item, the first panel day with positive sales."""
    return panel.where(F.col("day_sales_volume") > 0).groupBy("item_id").agg(F.min("pt").alias("t0"))


def item_shop_stats(panel: DataFrame, p: StudyParams) -> DataFrame:
    """One pass over the panel per (item, shop): first sale, rows, price sum and count, the rows
    and sales of the last ``recent_days`` days, and the day index - all that the cohort and the
    shop and cell sales need of the panel.

    Rows are first combined per day, so the day index ``days`` (sorted days, each with its panel
    rows) has at most one entry a day of the study, however many rows an item has.
    """
    recent = date_between("pt", p.end - dt.timedelta(days=p.recent_days - 1), p.end)
    by_day = panel.groupBy("item_id", "shop_id", "pt").agg(
        F.max(F.coalesce(F.col("day_sales_volume") > 0, F.lit(False))).alias("sold"),
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.sum("cprice").alias("price_sum"),
        F.count("cprice").alias("price_rows"),
        sum_or_zero("day_sales_volume").alias("sales"),
    )
    return by_day.groupBy("item_id", "shop_id").agg(
        F.min(F.when(F.col("sold"), F.col("pt"))).alias("t0"),
        F.sum("n").cast("bigint").alias("day_rows"),
        F.sum("price_sum").alias("price_sum"),
        F.sum("price_rows").alias("price_rows"),
        F.sum(F.when(recent, F.col("n")).otherwise(0)).cast("bigint").alias("recent_rows"),
        F.sum(F.when(recent, F.col("sales")).otherwise(0)).cast("bigint").alias("recent_sales"),
        F.array_sort(F.collect_list(F.struct("pt", "n"))).alias("days"),
    )


def item_panel_stats(item_shop: DataFrame) -> DataFrame:
    """Per item, from ``item_shop_stats``: t0, panel rows and the truncated average price."""
    return item_shop.groupBy("item_id").agg(
        F.min("t0").alias("t0"),
        F.sum("day_rows").cast("bigint").alias("day_rows"),
        F.try_divide(F.sum("price_sum").cast("double"), F.sum("price_rows")).cast("bigint").alias("avg_cprice_y1"),
    )


def _indexed_days(item_shop: DataFrame) -> DataFrame:
    """(item_id, pt) of every distinct panel day, from the day index."""
    return item_shop.select("item_id", F.explode("days.pt").alias("pt")).distinct()


def count_days(item_shop: DataFrame) -> DataFrame:
    """Per item, its distinct panel days (in place of its rows, quirk Q9)."""
    return _indexed_days(item_shop).groupBy("item_id").agg(F.count(F.lit(1)).cast("bigint").alias("day_rows"))


def first_image(comments: DataFrame, p: StudyParams) -> DataFrame:
    """g: per item, the first day in the window with a picture review (variant ``raw_n``)."""
    c = comments.where(
        F.col("item_id").isNotNull() & has_image("comment_images", "raw_n") & day_range("comment_time", p.start, p.end)
    )
    return c.groupBy("item_id").agg(F.min(F.to_date("comment_time")).alias("g"))


def _rows_between(first: Column, last: Column) -> Column:
    """Panel rows of a day index on the days from ``first`` to ``last``."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate("days", zero, lambda n, d: n + F.when(d["pt"].between(first, last), d["n"]).otherwise(zero))


def panel_coverage(g: DataFrame, t0: DataFrame, item_shop: DataFrame, p: StudyParams) -> DataFrame:
    """Per item with g and t0: panel rows (days, with ``p.distinct_days``) in [g-W, g-1] (pre_days) and [g, g+W] (post_days).

    Both counts come from the day index of ``item_shop_stats``, an item-level table: the daily
    facts are not read or joined again.
    """
    base = g.join(t0, "item_id")
    gc = F.col("g")
    pre, post = (add_days(gc, -p.window), add_days(gc, -1)), (gc, add_days(gc, p.window))
    if p.distinct_days:
        rows = base.join(_indexed_days(item_shop), "item_id")
        counts = [count_where(F.col("pt").between(*x)) for x in (pre, post)]
    else:
        rows = base.join(item_shop.select("item_id", "days"), "item_id")
        counts = [F.sum(_rows_between(*x)).cast("bigint") for x in (pre, post)]
    return rows.groupBy("item_id", "g", "t0").agg(counts[0].alias("pre_days"), counts[1].alias("post_days"))


def eligible_treated(coverage: DataFrame, p: StudyParams) -> DataFrame:
    """g inside [S+W, E-W], g - t0 >= min_gap, at least min_pre / min_post panel rows around g."""
    lo = p.start + dt.timedelta(days=p.window)
    hi = p.end - dt.timedelta(days=p.window)
    return coverage.where(
        date_between("g", lo, hi)
        & gap_at_least("g", "t0", p.min_gap)
        & (F.col("pre_days") >= p.min_pre)
        & (F.col("post_days") >= p.min_post)
    ).select("item_id", "g", "t0")


def eligible_control(stats: DataFrame, p: StudyParams, treated: DataFrame | None = None) -> DataFrame:
    """At least ``min_rows`` panel rows and t0 <= E - W (``stats`` from ``item_panel_stats``).

    With ``p.exclusive`` treated items are removed."""
    out = stats.where(
        F.col("t0").isNotNull()
        & (F.col("day_rows") >= p.min_rows)
        & (F.col("t0") <= F.lit(p.end - dt.timedelta(days=p.window)))
    )
    if p.exclusive and treated is not None:
        out = exclude(out, treated, "item_id")
    return out.select("item_id", "t0", "day_rows")


def price_fallback(panel: DataFrame) -> DataFrame:
    """Per item, the panel's average price truncated to BIGINT."""
    return panel.groupBy("item_id").agg(avg_bigint("cprice").alias("avg_cprice_y1"))


def price_reference(items: DataFrame, fallback: DataFrame) -> DataFrame:
    """Per item: ``coalesce(usual_cprice, cprice, panel average price)`` (``fallback`` from
    ``price_fallback`` or ``item_panel_stats``)."""
    pf = fallback.select("item_id", "avg_cprice_y1")
    return items.select("item_id", "usual_cprice", "cprice").join(pf, "item_id", "left").select(
        "item_id",
        "usual_cprice",
        "cprice",
        "avg_cprice_y1",
        F.coalesce("usual_cprice", "cprice", "avg_cprice_y1").alias("price_ref"),
    )


def eligible_universe(
    treated: DataFrame, control: DataFrame, items: DataFrame, fallback: DataFrame, bands: int, keep=None
) -> DataFrame:
    """Tagged union of treated and control items with shop, category, reference price and price band.

    The price band is ``NTILE(bands)`` inside the category by reference price (ties broken
    by item and tag), numbered across tasks so a large category is not one task's work.
    ``keep`` (e.g. ``freeze``) stores the unbanded rows first, so sizing the categories and
    banding read the stored rows instead of recomputing the joins.
    """
    u0 = treated.select("item_id", F.lit("treated").alias("elig_type")).unionByName(
        control.select("item_id", F.lit("control").alias("elig_type"))
    )
    it = items.select("item_id", "shop_id", "category_id", "category_name", "usual_cprice", "cprice")
    u = u0.join(it, "item_id").join(fallback.select("item_id", "avg_cprice_y1"), "item_id", "left")
    price = F.coalesce("usual_cprice", "cprice", "avg_cprice_y1")
    u = u.where(F.col("shop_id").isNotNull() & F.col("category_id").isNotNull() & price.isNotNull()).select(
        "item_id", "elig_type", "shop_id", "category_id", "category_name", price.alias("price_ref")
    )
    if keep is not None:
        u = keep(u)
    order = [F.col("price_ref").asc_nulls_first(), F.col("item_id").asc(), F.col("elig_type").asc()]
    return equal_freq_band(u, ["category_id"], order, bands, out="price_band")


class Cohort:
    """The cohort tables of one study, built lazily from the sources.

    The per-item panel statistics, first review days, treated items and the universe are
    item-level tables read by most later steps; they are written once to the checkpoint folder
    (``keep``) instead of re-running the scans, joins and aggregations for every consumer.  The panel itself is
    fact-level and stays a pushed-down rescan of the source.
    """

    def __init__(self, src: Sources, p: StudyParams, keep=None):
        self.src, self.p = src, p
        self.keep = keep if keep is not None else freeze

    @cached_property
    def panel(self) -> DataFrame:
        return item_day(self.src.daily, self.p)

    @cached_property
    def item_shop(self) -> DataFrame:
        return self.keep(item_shop_stats(self.panel, self.p))

    @cached_property
    def stats(self) -> DataFrame:
        stats = item_panel_stats(self.item_shop)
        if self.p.distinct_days:
            stats = stats.drop("day_rows").join(count_days(self.item_shop), "item_id")
        return self.keep(stats)

    @cached_property
    def t0(self) -> DataFrame:
        return self.stats.where(F.col("t0").isNotNull()).select("item_id", "t0")

    @cached_property
    def g(self) -> DataFrame:
        return self.keep(first_image(self.src.comments, self.p))

    @cached_property
    def coverage(self) -> DataFrame:
        return panel_coverage(self.g, self.t0, self.item_shop, self.p)

    @cached_property
    def treated(self) -> DataFrame:
        return self.keep(eligible_treated(self.coverage, self.p))

    @cached_property
    def control(self) -> DataFrame:
        return eligible_control(self.stats, self.p, self.treated)

    @cached_property
    def universe(self) -> DataFrame:
        return self.keep(eligible_universe(self.treated, self.control, self.src.items, self.stats, self.p.bands, keep=self.keep))

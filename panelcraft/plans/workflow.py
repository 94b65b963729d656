"""End-to-end runs that store every step as a table, like the original scripts.

Each step is written with ``materialize`` (``CREATE TABLE IF NOT EXISTS ... AS`` by default,
``mode='overwrite'`` to refresh) under the table name the original scripts use, followed by the
design and a digest of the parameters, and the next step reads the stored table - so a long run
resumes from finished steps, a run with other parameters never meets another run's tables, a
lost executor never recomputes earlier steps, and every intermediate can be inspected.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bloom import bloom_table, merge_blooms
from ..params import TABLE_NAMES as N
from ..params import StudyParams, WideParams
from ..session import freeze
from ..sources import Sources, cast_to, create_by_run, create_table, materialize, overwrite_into, overwrite_partitions, record_run, typed_schema
from ..sources.refresh import refresh
from ..sources.schemas import WIDE_TABLE_TYPES
from . import cohort as co
from . import sample as sa
from . import study as st
from . import wide as wi

WIDE_VARIANTS = (3, 7, 14, 30)


def digest(params: StudyParams | WideParams) -> str:
    """Eight hex digits of all parameter values."""
    return hashlib.sha256(repr(params).encode()).hexdigest()[:8]


def _store(prefix: str, suffix: str, mode: str):
    def store(df: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
        return materialize(df, prefix + name + suffix, mode=mode, buckets=buckets, key="item_id" if buckets else None)

    return store


def run_study(
    src: Sources, p: StudyParams, design: str = "A", mode: str = "ignore", prefix: str = "", buckets: int | None = None
) -> dict[str, DataFrame]:
    """Cohort, then the multistage sample with its post-condition checks, then the final study
    tables, each stored in turn; returned by step name.

    ``buckets``: store the panel, the per-item sums with their day index, t0 and g bucketed by item
    with that many buckets, so the coverage join and later reads of the (fact-level) panel by item
    run without a shuffle.
    """
    if p.pt_slack_days is not None and (far := st.crawl_rows_outside_slack(src.daily, p)):
        raise ValueError(f"{far} daily rows lie more than {p.pt_slack_days} days from their partition")
    store = _store(prefix, f"_{design.lower()}_{digest(p)}", mode)
    zero = "last" if design == "A" else "unit"
    out: dict[str, DataFrame] = {}

    def step(name: str, df: DataFrame, buckets: int | None = None) -> DataFrame:
        out[N[name]] = store(df, N[name], buckets)
        return out[N[name]]

    panel = step("panel", co.item_day(src.daily, p), buckets)
    item_shop = step("item_shop", co.item_shop_stats(panel, p), buckets)
    stats = co.item_panel_stats(item_shop)
    if p.distinct_days:
        stats = stats.drop("day_rows").join(co.count_days(item_shop), "item_id")
    t0 = step("t0", stats.where(F.col("t0").isNotNull()).select("item_id", "t0"), buckets)
    g = step("g", co.first_image(src.comments, p), buckets)
    treated = step("treated", co.eligible_treated(co.panel_coverage(g, t0, item_shop, p), p))
    control = step("control", co.eligible_control(stats, p, treated))
    universe = step("universe", co.eligible_universe(treated, control, src.items, stats, p.bands, keep=freeze))
    shops = step("sampled_shops", st.sample_shops(st.shop_size(freeze(st.shop_sales(item_shop, universe))), p))
    cells = step("cells", st.shop_cells(item_shop, universe, treated))
    picked_cells = step("sampled_cells", st.sample_cells(cells, shops, p, zero=zero))
    items = step("sampled_items", st.sample_items(universe, picked_cells, treated, p))
    step("check_sample_size", st.check_sample_size(items))
    step("check_cells_per_shop", st.check_count(picked_cells, ["shop_id"], p.cells_per_shop, "n_cells"))
    step("check_items_per_cell", st.check_count(items, st.CELL, p.pin + p.fill, "n_items"))
    snapshot = step("snapshot", st.anchor_snapshot(items, treated, src.daily, p))
    fi = step("final_item", st.final_item(snapshot, src.items, p.final_bands, keep=freeze))
    step("final_shop", st.final_shop(fi, src.shops))
    step("final_item_comment", st.final_item_comment(src.comments, fi, treated, src.items, p.window))
    step("final_item_day", st.final_item_day(panel, t0, g, src.comments, fi, snapshot, p))
    return out


def refresh_panel(src: Sources, daily_root: str, p: StudyParams, name: str) -> list[str]:
    """Bring the stored item-day panel up to date with the daily table under ``daily_root``: only the
    source partitions that changed are read and rewritten (``sources.refresh``).  Returns them.

    The panel is stored by source partition (``src_pt``); a crawl row belongs to one, so rebuilding
    some of them equals a full run.
    """

    def build(daily: DataFrame) -> DataFrame:
        return co.item_day(daily.withColumn("src_pt", F.col("pt")), p, keep=["src_pt"])

    daily = src.daily.withColumn("src_pt", F.col("pt"))
    return refresh(daily, daily_root, name, build, col="src_pt", root_col="pt")


def load_wide(df: DataFrame, name: str, mode: str) -> DataFrame:
    """``INSERT OVERWRITE`` into the typed wide table (ids STRING, money DOUBLE), created if it is
    absent; returned with the source's types, in which the later steps join."""
    spark = df.sparkSession
    if mode == "overwrite" or not spark.catalog.tableExists(name):
        create_table(spark, name, typed_schema(df, WIDE_TABLE_TYPES), comment="wide items")
        overwrite_into(cast_to(df, WIDE_TABLE_TYPES), name)
    return cast_to(spark.table(name), dict(df.dtypes))


def run_sampling(
    src: Sources, wp: WideParams, mode: str = "ignore", prefix: str = "", ledger: str = N["ledger"], run: str | None = None
) -> dict[str, DataFrame]:
    """Wide tables, single-stage sample with history and comments, ledger append, two-stage sample.

    The single-stage sample is drawn from the wide table of ``wp.min_days``.  The ledger is the
    only state carried between runs: its ids are excluded from the two-stage draw, and this
    run's single-stage sample is one partition of it, named ``run`` (by default after the
    parameters): a repeated or half-finished run replaces its own partition and adds nothing else.
    """
    spark = src.items.sparkSession
    suffix = f"_{digest(wp)}"
    store = _store(prefix, suffix, mode)
    variants = sorted({*WIDE_VARIANTS, wp.min_days})
    wide = {
        n: load_wide(wi.wide_items(src, replace(wp, min_days=n)), prefix + N["wide"].format(n=n) + suffix, mode) for n in variants
    }
    single = store(sa.stratified_quota_sample(wide[wp.min_days], wp), N["single_sample"].format(n=wp.min_days))
    ids = sa.sampled_ids(single)
    history = store(sa.daily_history(src.daily, ids, wp.history), N["sample_history"])
    comments = store(sa.comments_of(src.comments, ids), N["sample_comments"])
    run = f"{wp.min_days}_{digest(wp)}" if run is None else run
    drawn = sa.ledger_rows(single)
    record_run(drawn, prefix + ledger, run)
    excluded = spark.table(prefix + ledger).select("item_id")
    # each run keeps a Bloom filter of its ids, so the ledger is never read again to extend it
    blooms = f"{prefix}{ledger}__bloom"
    bits = bloom_table(drawn, "item_id")
    create_by_run(bits, blooms)
    overwrite_partitions(bits.withColumn("run", F.lit(run)), blooms)
    two = store(sa.two_stage(wide[30], excluded, wp, merge_blooms(spark.table(blooms))), N["two_stage_sample"].format(n=30) + "_two_stage")
    control = store(wi.control_items(src, wp), N["control_wide"])
    out = {f"wide_{n}": df for n, df in wide.items()}
    return out | {
        "single": single,
        "history": history,
        "comments": comments,
        "ledger": excluded,
        "two_stage": two,
        "control": control,
    }

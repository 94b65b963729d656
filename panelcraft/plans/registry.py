"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per composite operator.

Each reads the driver's tables through the fixture mapping (``sources.fixtures``) with the
fixture parameters (``params.FIXTURE_*``).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import count_distinct
from ..params import FIXTURE_STUDY, FIXTURE_STUDY_B, FIXTURE_WIDE
from ..session import ensure_checkpoint_dir
from ..sources import Sources, fixture_sources, read_daily, write_partitioned
from ..sources.schemas import DAILY
from . import cohort as co
from . import profile as pr
from . import sample as sa
from . import study as st
from . import wide as wi

# Wide-table variants read by each sampling/profiling query (minimum days from sale start
# to the first picture review), as in the original scripts.
WIDE_FOR = {
    "fan_range_histogram": 14,
    "stratified_quota_sample": 3,
    "two_stage": 30,
    "shops_by_rank_type": 3,
    "first_image_time_range": 14,
    "sale_start_range": 14,
    "fan_share_by_rank_type": 7,
    "missing_marker_audit": 7,
    "fan_distribution": 14,
    "fan_percentiles": 7,
    "oversized": 7,
}
COMMENT_LOOKUP_TIME = dt.datetime(1997, 5, 28, 0, 0, 0)


def wide(src: Sources, min_days: int) -> DataFrame:
    return wi.wide_items(src, replace(FIXTURE_WIDE, min_days=min_days))


def _single(src: Sources) -> DataFrame:
    return sa.stratified_quota_sample(wide(src, WIDE_FOR["stratified_quota_sample"]), FIXTURE_WIDE)


def _ledger(src: Sources) -> DataFrame:
    return sa.ledger_rows(_single(src))


def _stored_daily(src: Sources) -> DataFrame:
    """The daily table written by day (hot days rebalanced) and read back with its declared types;
    an empty partition value comes back as null.  Stored in the shared checkpoint folder."""
    spark = src.daily.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/daily-{uuid.uuid4().hex}"
    typed = src.daily.select(*[F.col(f.name).cast(f.dataType) for f in DAILY.fields])
    write_partitioned(typed, path, "pt")
    return read_daily(spark, path)


def _study(src: Sources, design: str = "A") -> st.Study:
    p = FIXTURE_STUDY if design == "A" else FIXTURE_STUDY_B
    return st.Study(co.Cohort(src, p), design)


def _q(fn: Callable[[Sources], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(fixture_sources(spark, sf_dir))

    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Callable[[Sources], DataFrame]] = {
    # source column subsets
    "item_master_columns": lambda s: wi.item_master_columns(s.items),
    "shop_columns": lambda s: wi.shop_columns(s.shops),
    "stored_daily": _stored_daily,
    "comments_with_images": lambda s: wi.comments_with_images(s.comments),
    # timing counts and wide tables
    "date_mismatch_count": lambda s: wi.date_mismatch_count(s),
    "late_image_count": lambda s: wi.late_image_count(s, FIXTURE_WIDE),
    "comment_image_stats": lambda s: wi.comment_image_stats(s.comments),
    "wide_item_first_image": lambda s: wide(s, FIXTURE_WIDE.min_days),
    "no_early_image_control": lambda s: wi.control_items(s, FIXTURE_WIDE),
    # single-stage sample, ledger, two-stage sample
    "fan_range_histogram": lambda s: pr.range_histogram(wide(s, WIDE_FOR["fan_range_histogram"]), FIXTURE_WIDE.fan_edges),
    "stratified_quota_sample": _single,
    "sample_daily_history": lambda s: sa.daily_history(s.daily, sa.sampled_ids(_single(s))),
    "sample_comments": lambda s: sa.comments_of(s.comments, sa.sampled_ids(_single(s))),
    "sampled_id_ledger": _ledger,
    "fan_bounds": lambda s: sa.fan_bounds(wide(s, WIDE_FOR["two_stage"]), _ledger(s)),
    "equal_width_level": lambda s: sa.items_with_level(wide(s, WIDE_FOR["two_stage"]), _ledger(s), FIXTURE_WIDE.levels),
    "equal_width_level_from_one": lambda s: sa.items_with_level(wide(s, WIDE_FOR["two_stage"]), _ledger(s), FIXTURE_WIDE.levels, True),
    "two_stage_sample": lambda s: sa.two_stage(wide(s, WIDE_FOR["two_stage"]), _ledger(s), FIXTURE_WIDE),
    "sampled_item_count": lambda s: count_distinct(_single(s), "item_id", out="n_items"),
    # cohort
    "item_day_panel": lambda s: co.Cohort(s, FIXTURE_STUDY).panel,
    "first_sale_date": lambda s: co.Cohort(s, FIXTURE_STUDY).t0,
    "first_image_date": lambda s: co.Cohort(s, FIXTURE_STUDY).g,
    "panel_coverage": lambda s: co.Cohort(s, FIXTURE_STUDY).coverage,
    "eligible_treated": lambda s: co.Cohort(s, FIXTURE_STUDY).treated,
    "eligible_control": lambda s: co.Cohort(s, FIXTURE_STUDY).control,
    "price_reference": lambda s: co.price_reference(s.items, co.Cohort(s, FIXTURE_STUDY).stats),
    "eligible_universe": lambda s: co.Cohort(s, FIXTURE_STUDY).universe,
    "eligible_universe_exclusive": lambda s: co.Cohort(s, FIXTURE_STUDY.with_(exclusive=True)).universe,
    "eligible_universe_distinct_days": lambda s: co.Cohort(s, FIXTURE_STUDY.with_(distinct_days=True)).universe,
    # multistage sample and checks
    "shop_sales_recent": lambda s: _study(s).shop_sales,
    "shop_size_tercile": lambda s: _study(s).shop_size,
    "sampled_shops": lambda s: _study(s).sampled_shops,
    "shop_cell_stats": lambda s: _study(s).cells,
    "sampled_cells_a": lambda s: _study(s, "A").sampled_cells,
    "sampled_cells_b": lambda s: _study(s, "B").sampled_cells,
    "sampled_items_a": lambda s: _study(s, "A").sampled_items,
    "sampled_items_b": lambda s: _study(s, "B").sampled_items,
    "check_sample_size": lambda s: st.check_sample_size(_study(s).sampled_items),
    "check_cells_per_shop": lambda s: st.check_count(
        _study(s).sampled_cells, ["shop_id"], FIXTURE_STUDY.cells_per_shop, "n_cells"
    ),
    "check_items_per_cell": lambda s: st.check_count(
        _study(s).sampled_items, st.CELL, FIXTURE_STUDY.pin + FIXTURE_STUDY.fill, "n_items"
    ),
    # the same checks against one cell and one item more than there are: every group violates
    "check_cells_per_shop_unmet": lambda s: st.check_count(
        _study(s).sampled_cells, ["shop_id"], FIXTURE_STUDY.cells_per_shop + 1, "n_cells"
    ),
    "check_items_per_cell_unmet": lambda s: st.check_count(
        _study(s).sampled_items, st.CELL, FIXTURE_STUDY.pin + FIXTURE_STUDY.fill + 1, "n_items"
    ),
    # final tables
    "anchor_snapshot": lambda s: _study(s).snapshot,
    "anchor_snapshot_one_row": lambda s: st.Study(co.Cohort(s, FIXTURE_STUDY.with_(dedupe=True))).snapshot,
    "final_item": lambda s: _study(s).final_item,
    "final_shop": lambda s: _study(s).final_shop,
    "final_item_comment": lambda s: _study(s).final_item_comment,
    "daily_comment_count": lambda s: st.daily_comments(s.comments),
    "final_item_day": lambda s: _study(s).final_item_day,
    # profiling
    "shops_by_rank_type": lambda s: pr.shops_by_rank_type(wide(s, WIDE_FOR["shops_by_rank_type"])),
    "first_image_time_range": lambda s: pr.first_image_time_range(
        s.comments, wide(s, WIDE_FOR["first_image_time_range"])
    ),
    "first_image_time_range_all": lambda s: pr.first_image_time_range(s.comments),
    "sale_start_range": lambda s: pr.sale_start_range(wide(s, WIDE_FOR["sale_start_range"])),
    "fan_share_by_rank_type": lambda s: pr.fan_share_by_rank_type(wide(s, WIDE_FOR["fan_share_by_rank_type"])),
    "missing_marker_audit": lambda s: pr.marker_audit(wide(s, WIDE_FOR["missing_marker_audit"])),
    "fan_distribution": lambda s: pr.fan_distribution(wide(s, WIDE_FOR["fan_distribution"])),
    "fan_percentiles": lambda s: pr.fan_percentiles(wide(s, WIDE_FOR["fan_percentiles"])),
    "oversized_groups": lambda s: pr.oversized_comment_groups(s.comments),
    "oversized_wide_shops": lambda s: pr.oversized_groups(wide(s, WIDE_FOR["oversized"])),
    "numbered_wide_items": lambda s: pr.numbered_wide(wide(s, WIDE_FOR["oversized"])),
    "numbered_duplicates": lambda s: pr.numbered_duplicates(s.daily),
    "latest_daily_snapshot": lambda s: pr.latest_daily_snapshot(s.daily),
    "latest_daily_preview": lambda s: pr.latest_daily_preview(s.daily),
    "comments_at_time": lambda s: pr.comments_at_time(s.comments, COMMENT_LOOKUP_TIME),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _q(fn) for name, fn in QUERIES.items()}

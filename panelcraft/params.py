"""Parameters of the cohort study and the sampling designs.

Everything a script of the original workflow hard-coded in a one-row ``params`` CTE is a
field here and reaches the plan as a literal (``F.lit``), never as a joined row.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

# --- fixed values -------------------------------------------------------------------
# Values that must equal the original workflow's for the same results.
# Missing-value marker written into text columns by the warehouse export (two characters).
MISSING_MARKER = "\\N"
# Empty-list text that marks "no pictures".
EMPTY_LIST_TEXT = "[]"
# Fan-count edges of the four equal-width strata of the single-stage sample.
REFERENCE_FAN_EDGES = (0, 28435563, 56871126, 85306689, 113742253)
# Per-stratum quotas of the single-stage sample, in stratum order.
REFERENCE_FAN_QUOTAS = (9796, 77, 27, 100)
# Sort key given to cells with zero recent sales in sampling design A (they go last).
ZERO_SALES_KEY = 999999999
# Shop-size labels of the three sales terciles, largest first.
SIZE_LABELS = ("big", "mid", "small")
# Names of the stored step tables, as the original scripts name them (so existing readers of
# those tables keep working).
TABLE_NAMES = {
    "panel": "tmp_item_day_y1",
    "t0": "tmp_item_t0",
    "g": "tmp_item_g",
    "treated": "tmp_eligible_treated",
    "control": "tmp_eligible_control",
    "universe": "tmp_eligible_universe",
    "sampled_shops": "tmp_sampled_shops",
    "cells": "tmp_shop_cell_stats",
    "sampled_cells": "tmp_sampled_shop_cells",
    "sampled_items": "tmp_sampled_items",
    "snapshot": "final_item_anchor_snapshot",
    "final_item": "final_item",
    "final_shop": "final_shop",
    "final_item_comment": "final_item_comment",
    "final_item_day": "final_item_day",
    "wide": "tmp_item_full_info_with_first_img_comment_{n}",
    "single_sample": "tmp_sampled_items_10k_{n}",
    "sample_history": "tmp_daily_all_records_for_sampled_items",
    "sample_comments": "tmp_comments_for_sampled_items",
    "ledger": "tmp_accumulated_item_ids",
    "two_stage_sample": "tmp_sampled_items_10k_{n}",
    "control_wide": "tmp_item_no_early_img_comment",
}
# --- end of fixed values ------------------------------------------------------------
# Tables of steps that have no name there.
TABLE_NAMES |= {
    "item_shop": "tmp_item_shop_stats",
    "check_sample_size": "check_sample_size",
    "check_cells_per_shop": "check_cells_per_shop",
    "check_items_per_cell": "check_items_per_cell",
}


@dataclass(frozen=True)
class StudyParams:
    """Event-study parameters (window, thresholds, sample sizes, seed)."""

    start: dt.date = dt.date(2025, 1, 1)  # S: first day of the observation year
    end: dt.date = dt.date(2025, 12, 31)  # E: last day
    window: int = 60  # W: days before/after the event (also the boundary margin)
    min_gap: int = 21  # g - t0 >= min_gap
    min_pre: int = 50  # panel rows in [g-W, g-1]
    min_post: int = 50  # panel rows in [g, g+W]
    min_rows: int = 100  # control: panel rows in the year
    recent_days: int = 90  # shop / cell sales window ending at E
    bands: int = 4  # equal-frequency price bands inside a category (universe)
    final_bands: int = 4  # price bands re-cut on the anchor price (final item table)
    n_shops: int = 1000
    size_shares: tuple[float, float, float] = (0.30, 0.50, 0.20)
    cells_per_shop: int = 2
    min_treated_in_cell: int = 2
    pin: int = 3  # treated items drawn first in a cell
    fill: int = 7  # further items drawn from the rest of the cell
    seed: int = 42
    # partitions of days outside [first - slack, last + slack] of a crawl-day range are not
    # read; None reads all of them (no assumption on how far pt may lie from the crawl day)
    pt_slack_days: int | None = None
    exclusive: bool = False  # True: treated items are removed from the control pool (quirk Q1)
    dedupe: bool = False  # True: one snapshot row per item (quirk Q3)
    distinct_days: bool = False  # True: coverage counts distinct days, not panel rows (quirk Q9)

    def quotas(self) -> tuple[int, int, int]:
        """big / mid / small shop quotas; SQL ROUND is half-up, small takes the remainder."""
        n = Decimal(self.n_shops)
        big = int((n * Decimal(str(self.size_shares[0]))).quantize(Decimal(1), ROUND_HALF_UP))
        mid = int((n * Decimal(str(self.size_shares[1]))).quantize(Decimal(1), ROUND_HALF_UP))
        return big, mid, self.n_shops - big - mid

    def pt_range(self, first: dt.date, last: dt.date) -> tuple[str, str] | None:
        """Partition days (yyyymmdd) that can hold crawl days ``first`` .. ``last``."""
        if self.pt_slack_days is None:
            return None
        slack = dt.timedelta(days=self.pt_slack_days)
        return (first - slack).strftime("%Y%m%d"), (last + slack).strftime("%Y%m%d")

    def with_(self, **kw) -> StudyParams:
        return replace(self, **kw)


@dataclass(frozen=True)
class WideParams:
    """Parameters of the wide item tables and the single/two-stage samples."""

    min_days: int = 3  # first image review at least this many days after sale start
    late_days: int = 7  # threshold of the scalar timing count
    sale_by: str = "20251031"  # control: start_sell_date <= sale_by (string comparison)
    cutoff: dt.date = dt.date(2025, 12, 31)  # control: no image review up to this date
    sale_date_format: str = "yyyy-MM-dd"  # format in which the wide load reads start_sell_date
    control_date_format: str = "yyyyMMdd"  # format in which the control load reads it
    fan_edges: tuple[int, ...] = REFERENCE_FAN_EDGES
    fan_quotas: tuple[int, ...] = REFERENCE_FAN_QUOTAS
    levels: int = 4  # equal-width levels of the two-stage sample
    shops_per_level: int = 250
    items_per_shop: int = 10
    zero_to_one: bool = False  # True: the minimum fan count is in level 1, not 0 (quirk Q4)
    history: tuple[str, str] | None = None  # partition days (yyyymmdd) of the sampled history; None: all
    seed: int = 42


# Parameters used with the driver's synthetic tables (FIXTURES.md section 4): the synthetic
# panel spans 1995-2001 with about 30 rows per item, so the one-year thresholds are scaled.
FIXTURE_STUDY = StudyParams(
    start=dt.date(1995, 1, 1),
    end=dt.date(2001, 12, 31),
    window=365,
    min_gap=21,
    min_pre=3,
    min_post=3,
    min_rows=6,
    recent_days=365,
    bands=2,
    final_bands=4,
    n_shops=6,
    pin=3,
    fill=7,
    seed=42,
)
FIXTURE_STUDY_B = FIXTURE_STUDY.with_(pin=2, fill=8)

FIXTURE_WIDE = WideParams(
    min_days=3,
    late_days=7,
    sale_by="2000-10-31",
    cutoff=dt.date(2000, 12, 31),
    fan_edges=(0, 250000, 500000, 750000, 1000000),
    seed=42,
)


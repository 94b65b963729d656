"""Run the stored workflow from the command line.

    python -m panelcraft study   --items P --daily P --comments P --shops P [--format orc] [options]
    python -m panelcraft sampling --items P --daily P --comments P --shops P [--format orc] [options]
    python -m panelcraft study   --fixture-dir /root/testdata/sf0.01      # the driver's tables

Every step is stored as a table (``--mode ignore``: keep existing tables, ``overwrite``:
refresh) under the usual names, with an optional ``--prefix``.  Under spark-submit the
cluster's master and settings apply.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
from dataclasses import replace

from .params import FIXTURE_STUDY, FIXTURE_WIDE, StudyParams, WideParams
from .plans.workflow import run_sampling, run_study
from .session import build_session
from .sources import fixture_sources, read_sources


def _date(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def main(argv: list[str] | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="panelcraft")
    ap.add_argument("command", choices=["study", "sampling"])
    ap.add_argument("--items")
    ap.add_argument("--daily")
    ap.add_argument("--comments")
    ap.add_argument("--shops")
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--fixture-dir", help="use the driver's TPC-H-like tables through the fixture mapping")
    ap.add_argument("--master", default=None)
    ap.add_argument("--mode", default="ignore", choices=["ignore", "overwrite"])
    ap.add_argument("--prefix", default="")
    ap.add_argument("--design", default="A", choices=["A", "B"])
    ap.add_argument("--start", type=_date)
    ap.add_argument("--end", type=_date)
    ap.add_argument("--seed", type=int)
    ap.add_argument("--n-shops", type=int)
    ap.add_argument("--exclusive", action="store_true", help="remove treated items from the control pool")
    ap.add_argument("--min-days", type=int)
    ap.add_argument("--pt-slack-days", type=int, help="read only partitions within this many days of the crawl days needed (checked first)")
    ap.add_argument("--dedupe", action="store_true", help="one anchor snapshot row per item")
    ap.add_argument("--distinct-days", action="store_true", help="coverage counts distinct days, not panel rows")
    ap.add_argument("--zero-to-one", action="store_true", help="the minimum fan count is in level 1, not 0")
    ap.add_argument("--buckets", type=int, help="store panel, t0 and g bucketed by item (shuffle-free coverage join)")
    a = ap.parse_args(argv)

    spark = build_session(master=a.master, shuffle_partitions=None, app=f"panelcraft-{a.command}")
    if a.fixture_dir:
        src = fixture_sources(spark, a.fixture_dir)
        study, wide = FIXTURE_STUDY, FIXTURE_WIDE
    else:
        if not all([a.items, a.daily, a.comments, a.shops]):
            ap.error("--items, --daily, --comments and --shops are required without --fixture-dir")
        src = read_sources(spark, a.items, a.daily, a.comments, a.shops, a.format)
        study, wide = StudyParams(), WideParams()
    if a.design == "B":
        study = study.with_(pin=2, fill=8)
    overrides = {k: v for k, v in {"start": a.start, "end": a.end, "seed": a.seed, "n_shops": a.n_shops, "pt_slack_days": a.pt_slack_days}.items() if v is not None}
    study = study.with_(**overrides, exclusive=a.exclusive, dedupe=a.dedupe, distinct_days=a.distinct_days)
    chosen = {k: v for k, v in {"seed": a.seed, "min_days": a.min_days}.items() if v is not None}
    wide = replace(wide, **chosen, zero_to_one=a.zero_to_one)

    if a.command == "study":
        tables = run_study(src, study, design=a.design, mode=a.mode, prefix=a.prefix, buckets=a.buckets)
    else:
        tables = run_sampling(src, wide, mode=a.mode, prefix=a.prefix)
    summary = {name: df.count() for name, df in tables.items()}
    print(json.dumps(summary))
    return summary


if __name__ == "__main__":
    main()

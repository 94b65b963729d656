"""Plan-shape regressions over every registered query."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcraft.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_or_python_in_plan(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    for bad in FORBIDDEN:
        assert bad not in plan, bad


def test_draws_limit_before_the_shuffle(spark):
    # sf0.01: at sf0.001 the ledger already holds every wide item, so the two-stage input is empty
    from panelcraft.params import FIXTURE_STUDY
    from panelcraft.plans import cohort as co
    from panelcraft.plans import study as st
    from panelcraft.sources import fixture_sources

    sf = "/root/testdata/sf0.01"
    for name in ("stratified_quota_sample", "two_stage_sample"):
        assert "WindowGroupLimit" in _plan(QUERIES[name](spark, sf))
    study = st.Study(co.Cohort(fixture_sources(spark, sf), FIXTURE_STUDY))  # its steps are stored: plan them unstored
    for zero in ("last", "unit"):
        assert "WindowGroupLimit" in _plan(st.sample_cells(study.cells, study.sampled_shops, FIXTURE_STUDY, zero))
    assert "WindowGroupLimit" in _plan(st.sample_items(study.c.universe, study.sampled_cells, study.c.treated, FIXTURE_STUDY))


def test_final_item_day_scans(spark):
    """The study reads the daily fact three times (panel sums with the day index, anchor days, final
    panel) and the comments twice, however many tables are built from them."""
    from panelcraft.params import FIXTURE_STUDY
    from panelcraft.plans import cohort as co
    from panelcraft.plans import study as st
    from panelcraft.session import freeze
    from panelcraft.sources import fixture_sources

    src = fixture_sources(spark, SF)
    scans = {"daily": 0, "comments": 0}

    def keep(df):
        count(df)
        return freeze(df)

    def count(df):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        for name, column in (("daily", "l_shipdate"), ("comments", "o_orderdate")):
            scans[name] += sum("Relation [" in x and column in x for x in lines)

    study = st.Study(co.Cohort(src, FIXTURE_STUDY, keep=keep), keep=keep)
    count(study.final_item_day)
    assert scans["daily"] <= 3 and scans["comments"] <= 2, scans


def test_panel_scan_pushes_day_range_and_prunes_columns(spark):
    plan = _plan(QUERIES["item_day_panel"](spark, SF))  # long plan fields are truncated in toString
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_partkey), GreaterThanOrEqual(l_shipdate,1995-01-01T00:00)" in plan
    assert "FileScan parquet [l_partkey#" in plan and "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double,l_returnflag:string" in plan


def test_anchor_snapshot_prunes_partitions(spark, scratch):
    """With a slack, only the partitions near the anchor days are read; without, no row is lost."""
    from panelcraft.params import FIXTURE_STUDY
    from panelcraft.plans.study import anchor_snapshot, crawl_rows_outside_slack
    from panelcraft.sources import fixture_sources, write_partitioned

    daily = fixture_sources(spark, SF).daily.where("pt <> '' and insert_time < timestamp '1995-02-01'")
    write_partitioned(daily, f"{scratch}/daily")
    stored = spark.read.parquet(f"{scratch}/daily").withColumn("pt", F.col("pt").cast("string"))
    row = daily.orderBy("insert_time").first()
    treated = spark.createDataFrame([(row.item_id, row.insert_time.date() + dt.timedelta(days=1))], "item_id long, g date")
    sampled = spark.createDataFrame([(row.item_id, row.shop_id, 0, 1)], "item_id long, shop_id long, category_id long, price_band long")
    p = FIXTURE_STUDY.with_(pt_slack_days=1)
    assert crawl_rows_outside_slack(stored, p) == 0
    snap = anchor_snapshot(sampled, treated, stored, p)
    assert snap.where("anchor_price is not null").count() > 0
    assert "dynamicpruning" in snap._jdf.queryExecution().toString()


def test_anchor_snapshot_reads_the_anchor_days_only(spark, scratch):
    """Two anchor days far apart: the days between them are not read."""
    from panelcraft.params import FIXTURE_STUDY
    from panelcraft.plans.study import anchor_snapshot

    day = dt.date(1996, 1, 1)
    rows = [(i, dt.datetime.combine(day + dt.timedelta(days=d), dt.time(5)), d, 1, 1, f"{day + dt.timedelta(days=d):%Y%m%d}") for d in range(60) for i in (1, 2)]
    columns = "item_id long, insert_time timestamp, cprice long, day_30_sales_volume long, add_volume long, pt string"
    spark.createDataFrame(rows, columns).write.partitionBy("pt").parquet(f"{scratch}/daily")
    stored = spark.read.schema(columns).parquet(f"{scratch}/daily")
    treated = spark.createDataFrame([(1, day + dt.timedelta(days=3)), (2, day + dt.timedelta(days=51))], "item_id long, g date")
    sampled = spark.createDataFrame([(1, 1, 0, 1), (2, 1, 0, 1)], "item_id long, shop_id long, category_id long, price_band long")
    snap = anchor_snapshot(sampled, treated, stored, FIXTURE_STUDY.with_(pt_slack_days=1))
    assert sorted((r.item_id, r.anchor_price) for r in snap.collect()) == [(1, 2), (2, 50)]
    plan = snap._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert files_read(snap) == 6  # two anchor days, a day of slack on either side


def files_read(df) -> int:
    """Files that the dynamically pruned scans of a finished query read, from its metrics."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if "FileSourceScan" in name and "dynamicpruning" in node.toString():
                found += node.metrics().apply("numFiles").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return found


def test_no_date_bound_drops_rows(spark):
    from panelcraft.params import StudyParams
    from panelcraft.plans.cohort import item_day

    p = StudyParams(start=dt.date(2026, 1, 1), end=dt.date(2027, 6, 30))
    cols = "item_id long, shop_id long, insert_time timestamp, day_sales_volume long, cprice long, category_id long, root_category_id long, pt string"
    rows = [(1, 1, dt.datetime(y, 1, 5), 1, 1, 1, 1, f"{y}0105") for y in (2026, 2027)]
    daily = spark.createDataFrame(rows, cols)
    assert item_day(daily, p).count() == 2
    assert item_day(daily, p.with_(pt_slack_days=2)).count() == 2


def test_anti_and_semi_joins(spark):
    assert "LeftAnti" in _plan(QUERIES["fan_bounds"](spark, SF))
    assert "LeftSemi" in _plan(QUERIES["sample_comments"](spark, SF))

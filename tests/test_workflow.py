"""The stored end-to-end runs give the same tables as the registered (lazy) queries."""

from panelcraft.params import FIXTURE_STUDY, FIXTURE_WIDE
from panelcraft.plans import registry
from panelcraft.plans.workflow import digest, run_sampling, run_study
from panelcraft.sources import fixture_sources

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_run_study_equals_queries(spark):
    src = fixture_sources(spark, SF)
    out = run_study(src, FIXTURE_STUDY, prefix="ps_")
    q = registry.queries()
    assert _rows(out["tmp_sampled_items"]) == _rows(q["sampled_items_a"](spark, SF))
    assert _rows(out["final_item_day"]) == _rows(q["final_item_day"](spark, SF))
    assert _rows(out["final_item_comment"]) == _rows(q["final_item_comment"](spark, SF))
    assert out["check_cells_per_shop"].count() == 0 and out["check_sample_size"].first().n_items > 0
    # other parameters are other tables; the same ones resume from the stored tables
    other = run_study(src, FIXTURE_STUDY.with_(seed=7, n_shops=3), prefix="ps_")
    assert other["tmp_sampled_items"].select("shop_id").distinct().count() <= 3
    again = run_study(src, FIXTURE_STUDY, prefix="ps_")
    assert _rows(again["tmp_sampled_items"]) == _rows(out["tmp_sampled_items"])


def test_run_sampling_ledger_excludes_previous_draws(spark):
    src = fixture_sources(spark, SF)
    out = run_sampling(src, FIXTURE_WIDE, prefix="pa_")
    q = registry.queries()
    assert _rows(out["single"]) == _rows(q["stratified_quota_sample"](spark, SF))
    assert _rows(out["two_stage"]) == _rows(q["two_stage_sample"](spark, SF))
    drawn = {r.item_id for r in out["ledger"].collect()}
    assert drawn and not drawn & {r.item_id for r in out["two_stage"].collect()}
    assert set(out) >= {"wide_3", "wide_7", "wide_14", "wide_30"}
    assert dict(spark.table(f"pa_tmp_item_full_info_with_first_img_comment_3_{digest(FIXTURE_WIDE)}").dtypes)["item_id"] == "string"
    again = run_sampling(src, FIXTURE_WIDE, prefix="pa_")  # a second run appends no id twice
    assert again["ledger"].count() == len(drawn)


def test_cli_study_on_fixture(spark):
    from panelcraft.__main__ import main

    summary = main(["study", "--fixture-dir", SF, "--prefix", "cli_", "--mode", "overwrite"])
    assert summary["final_item_day"] > 0 and summary["tmp_sampled_items"] > 0
    assert spark.table(f"cli_final_item_day_a_{digest(FIXTURE_STUDY)}").count() == summary["final_item_day"]


def test_cli_sampling_on_fixture(spark):
    from panelcraft.__main__ import main

    summary = main(["sampling", "--fixture-dir", SF, "--prefix", "clis_", "--mode", "overwrite"])
    assert summary["single"] > 0 and summary["ledger"] == summary["single"]


def test_bucketed_panel_joins_without_shuffle(spark):
    from panelcraft.plans.cohort import panel_coverage

    src = fixture_sources(spark, SF)
    out = run_study(src, FIXTURE_STUDY, prefix="pb_", mode="overwrite", buckets=4)
    q = registry.queries()
    assert _rows(out["tmp_eligible_treated"]) == _rows(q["eligible_treated"](spark, SF))
    end = f"_a_{digest(FIXTURE_STUDY)}"
    item_shop, t0, g = (spark.table(f"pb_{n}{end}") for n in ("tmp_item_shop_stats", "tmp_item_t0", "tmp_item_g"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = panel_coverage(g, t0, item_shop, FIXTURE_STUDY)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_ledger_survives_repeated_and_killed_runs(spark):
    """A run replaces its own partition: repeats add nothing, other runs' ids are left alone."""
    from panelcraft.sources import record_run

    spark.sql("DROP TABLE IF EXISTS t_runs")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "item_id bigint")
    record_run(ids(1, 2, 3), "t_runs", "a")
    record_run(ids(3, 4), "t_runs", "b")  # 3 stands in the ledger already
    assert sorted(map(tuple, spark.table("t_runs").collect())) == [(1, "a"), (2, "a"), (3, "a"), (4, "b")]
    record_run(ids(1, 2, 3), "t_runs", "a")  # a repeat
    record_run(ids(3, 4), "t_runs", "b")
    assert sorted(map(tuple, spark.table("t_runs").collect())) == [(1, "a"), (2, "a"), (3, "a"), (4, "b")]

    def dies(batches):
        yield from batches
        raise RuntimeError("lost")

    try:  # a run that dies while it writes leaves the ledger as it was
        record_run(ids(1, 9).mapInArrow(dies, "item_id bigint"), "t_runs", "a")
        raise AssertionError("the run should have failed")
    except Exception as e:
        assert "lost" in str(e)
    spark.catalog.refreshTable("t_runs")
    assert sorted(map(tuple, spark.table("t_runs").collect())) == [(1, "a"), (2, "a"), (3, "a"), (4, "b")]
    record_run(ids(1, 9), "t_runs", "a")
    assert sorted(map(tuple, spark.table("t_runs").collect())) == [(1, "a"), (4, "b"), (9, "a")]
    spark.sql("DROP TABLE t_runs")


def test_two_writers_of_the_ledger(spark):
    from concurrent.futures import ThreadPoolExecutor

    from panelcraft.sources import record_run

    spark.sql("DROP TABLE IF EXISTS t_two")
    record_run(spark.createDataFrame([(0,)], "item_id bigint"), "t_two", "first")
    with ThreadPoolExecutor(2) as pool:
        done = [pool.submit(record_run, spark.range(i * 100, i * 100 + 50).toDF("item_id"), "t_two", f"run{i}") for i in (1, 2)]
        [x.result() for x in done]
    spark.catalog.refreshTable("t_two")
    assert spark.table("t_two").count() == 101 and spark.table("t_two").select("item_id").distinct().count() == 101
    spark.sql("DROP TABLE t_two")


def test_refreshed_panel_equals_a_full_run(spark, scratch):
    """One changed day: one partition is rewritten, and the panel is that of a full run."""
    import datetime as dt

    from pyspark.sql import functions as F

    from panelcraft.plans.cohort import item_day
    from panelcraft.plans.workflow import refresh_panel
    from panelcraft.sources import Sources

    for t in ("pr_panel", "pr_panel__manifest"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    root = f"{scratch}/daily"
    whole = fixture_sources(spark, SF).daily.where("insert_time < timestamp'1995-02-15' AND insert_time >= timestamp'1994-12-20'")
    whole.write.partitionBy("pt").parquet(root)

    def src():
        daily = spark.read.schema(whole.schema).parquet(root).select(*whole.columns)
        return Sources(items=None, daily=daily, comments=None, shops=None)

    def full():
        return sorted(map(tuple, item_day(src().daily, FIXTURE_STUDY).collect()), key=repr)

    def stored():
        spark.catalog.refreshTable("pr_panel")
        return sorted(map(tuple, spark.table("pr_panel").drop("src_pt").collect()), key=repr)

    first = refresh_panel(src(), root, FIXTURE_STUDY, "pr_panel")
    assert len(first) > 20 and stored() == full() and stored()
    day = whole.where("pt = '19950110'").limit(1).withColumn("cprice", F.lit(123456).cast("bigint"))
    day.write.mode("append").partitionBy("pt").parquet(root)
    assert refresh_panel(src(), root, FIXTURE_STUDY, "pr_panel") == ["19950110"]
    assert stored() == full() and any(123456 in r for r in stored())
    assert refresh_panel(src(), root, FIXTURE_STUDY, "pr_panel") == []
    assert dt.date(1995, 1, 10) in {r[2] for r in stored()}

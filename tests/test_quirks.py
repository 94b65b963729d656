"""Row-multiplicity quirks of the workflow are kept by default and switchable."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcraft.params import FIXTURE_STUDY
from panelcraft.plans.cohort import Cohort
from panelcraft.plans.study import anchor_snapshot, final_item_comment
from panelcraft.sources import fixture_sources

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def src(spark):
    return fixture_sources(spark, SF)


def test_treated_items_also_in_control_by_default(src):
    u = Cohort(src, FIXTURE_STUDY).universe
    twice = u.groupBy("item_id").count().where("count = 2").count()
    treated = u.where("elig_type = 'treated'").count()
    assert treated > 0 and twice == treated


def test_exclusive_universe_has_one_row_per_item(src):
    u = Cohort(src, FIXTURE_STUDY.with_(exclusive=True)).universe
    assert u.groupBy("item_id").count().where("count > 1").count() == 0


def test_universe_band_counts(src):
    u = Cohort(src, FIXTURE_STUDY).universe
    assert u.count() == 256 and u.select("item_id").distinct().count() == 200


def test_anchor_snapshot_keeps_every_crawl_of_the_day(spark):
    p = FIXTURE_STUDY
    sampled = spark.createDataFrame(
        [(1, 10, 3, 1), (2, 10, 3, 1), (3, 10, 3, 1)], "item_id long, shop_id long, category_id long, price_band long"
    )  # item 3 has no crawl on its anchor day
    treated = spark.createDataFrame([(1, dt.date(2000, 5, 2))], "item_id long, g date")
    daily = spark.createDataFrame(
        [
            (1, dt.datetime(2000, 5, 1, 3), 100, 7, 9),
            (1, dt.datetime(2000, 5, 1, 20), 110, 8, 10),  # second crawl on the anchor day
            (1, dt.datetime(2000, 5, 2, 1), 120, 9, 11),
            (2, dt.datetime(2001, 12, 30, 5), 50, 1, 2),  # control item: anchor E-1
        ],
        "item_id long, insert_time timestamp_ntz, cprice long, day_30_sales_volume long, add_volume long",
    ).withColumn("pt", F.date_format("insert_time", "yyyyMMdd"))
    snap = anchor_snapshot(sampled, treated, daily, p).collect()
    got = sorted((r.item_id, r.anchor_date, r.anchor_price) for r in snap)
    assert got == [
        (1, dt.date(2000, 5, 1), 100),
        (1, dt.date(2000, 5, 1), 110),
        (2, dt.date(2001, 12, 30), 50),
        (3, dt.date(2001, 12, 30), None),
    ]
    # optional partition pruning gives the same rows
    pruned = anchor_snapshot(sampled, treated, daily, p.with_(pt_slack_days=1)).collect()
    assert sorted((r.item_id, r.anchor_date, r.anchor_price) for r in pruned) == got


def test_final_item_comment_repeats_comments_per_copy(spark):
    fi = spark.createDataFrame([(1,), (1,)], "item_id long")  # an item sampled twice
    treated = spark.createDataFrame([(1, dt.date(2000, 5, 2))], "item_id long, g date")
    items = spark.createDataFrame([(1, 4, 0.1, 0.2)], "item_id long, comment_count long, bad_rate double, max_bad_rate double")
    comments = spark.createDataFrame(
        [(1, 11, "a", dt.datetime(2000, 5, 3), "[]", "x"), (1, 12, "b", dt.datetime(2001, 5, 3), "[]", "y")],
        "item_id long, comment_id long, comment_seller_name string, comment_time timestamp_ntz, comment_images string, comment_content string",
    )
    out = final_item_comment(comments, fi, treated, items, 60).collect()
    assert sorted(r.comment_id for r in out) == [11, 11]


def test_same_seed_same_sample_under_any_shuffle_partitions(spark, src):
    from panelcraft.plans.registry import queries

    q = queries()["sampled_items_a"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, q(spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2] and results[0]


def test_ledger_empty_and_full(spark, src):
    from panelcraft.params import FIXTURE_WIDE
    from panelcraft.plans.registry import wide
    from panelcraft.plans.sample import fan_bounds, two_stage

    w30 = wide(src, 30)
    empty = spark.createDataFrame([], "item_id bigint")
    full = w30.select("item_id")
    assert two_stage(w30, empty, FIXTURE_WIDE).count() > 0
    assert two_stage(w30, full, FIXTURE_WIDE).count() == 0
    b = fan_bounds(w30, full).first()
    assert b.min_fan is None and b.max_fan is None

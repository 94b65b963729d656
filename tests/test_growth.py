"""Structures that are kept while data grows: sketches, samples, clustered files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcraft.operators import count_distinct, exact_percentiles, sample_quota
from panelcraft.operators.maintained import extend_sample
from panelcraft.operators.sketches import LG, K, approx_count_distinct, approx_percentiles, daily_sketches, merged
from panelcraft.session import freeze
from panelcraft.sources import fixture_sources
from panelcraft.sources.clustered import files_for, lookup_clustered, write_clustered, zone_map

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def daily(spark):
    return freeze(fixture_sources(spark, SF).daily.select("item_id", "cprice", F.to_date("insert_time").alias("pt")))


def test_sketches_are_within_their_bounds_of_the_exact_forms(spark, daily):
    sketches = freeze(daily_sketches(daily, "cprice", "pt", "item_id"))
    assert sketches.count() == daily.select("pt").distinct().count()
    ps = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    for first, last in ((None, None), (dt.date(1995, 3, 1), dt.date(1996, 2, 10)), (dt.date(1997, 1, 1), dt.date(1997, 1, 3))):
        part = daily.where(F.col("pt").between(first or dt.date(1900, 1, 1), last or dt.date(2100, 1, 1)))
        exact, n = count_distinct(part, "item_id").first()[0], part.count()
        got = approx_count_distinct(sketches, first, last).first()[0]
        assert abs(got - exact) <= max(1, 4 * 1.04 / 2 ** (LG / 2) * exact)
        told = approx_percentiles(sketches, ps, first, last).first()
        for name, p in ps.items():  # the error is one of the rank
            share = part.where(F.col("cprice") < told[name]).count() / n, part.where(F.col("cprice") <= told[name]).count() / n
            assert share[0] - 4 * 1.7 / K <= p <= share[1] + 4 * 1.7 / K
        assert merged(sketches, first, last).first().rows == n


def test_sketches_of_no_rows(spark, daily):
    sketches = daily_sketches(daily, "cprice")
    none = dt.date(2500, 1, 1)
    assert approx_count_distinct(sketches, none).first()[0] == 0
    assert approx_percentiles(sketches, {"p50": 0.5}, none).first()[0] is None


def test_inexact_flag(spark, daily):
    exact, close = (count_distinct(daily, "item_id", exact=x).first()[0] for x in (True, False))
    assert abs(exact - close) <= 0.04 * exact
    a, b = (exact_percentiles(daily, "cprice", {"p50": 0.5}, exact=x).first()[0] for x in (True, False))
    assert abs(a - b) <= 0.1 * a


def test_extended_sample_equals_a_fresh_draw(spark):
    """Three appends give the draw over all rows, also where a stratum is not yet full."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 2990, "b").otherwise("c").alias("s"))
    quotas = {"a": 40, "b": 7, "c": 1000}
    args = ("s", quotas, 42, "kept", ["id"])
    parts = [rows.where("id < 100"), rows.where("id >= 100 AND id < 2000"), rows.where("id >= 2000")]
    sample = None
    for i, part in enumerate(parts):
        sample = freeze(extend_sample(sample, part, *args))
        so_far = rows.where(f"id < {[100, 2000, 3000][i]}")
        fresh = sample_quota(so_far, *args)
        assert sorted(map(tuple, sample.select("id", "s", "rn").collect())) == sorted(map(tuple, fresh.select("id", "s", "rn").collect()))
    before = sample.select("id", "rn").collect()
    again = extend_sample(sample, rows.limit(0), *args)
    assert sorted(map(tuple, again.select("id", "rn").collect())) == sorted(map(tuple, before))


def test_most_appended_rows_are_rejected_by_their_key(spark):
    rows = spark.range(20_000).select("id", F.lit("a").alias("s"))
    args = ("s", {"a": 20}, 42, "kept", ["id"])
    sample = freeze(extend_sample(None, rows.where("id < 10000"), *args))
    text = extend_sample(sample, rows.where("id >= 10000"), *args)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (s" in text or "NOT CASE" in text or "_draw_key" in text
    last = sample.agg(F.max("_draw_key")).first()[0]
    from panelcraft.functions.hashing import draw_key

    assert rows.where("id >= 10000").where(draw_key(42, "kept", "s", "id") <= last).count() < 200


def test_point_lookup_reads_a_few_clustered_files(spark, scratch):
    src = fixture_sources(spark, SF).daily.select("item_id", "pt", "cprice", "shop_id")
    write_clustered(src, f"{scratch}/z", ["item_id", "pt"], 32)
    stored = spark.read.parquet(f"{scratch}/z")
    assert stored.count() == src.count()
    zones = freeze(zone_map(spark, f"{scratch}/z", ["item_id", "pt"]))
    files = zones.count()
    assert files >= 24
    some = src.where("pt <> ''").orderBy(F.xxhash64("item_id", "pt")).limit(5).collect()
    for r in some:
        assert len(files_for(zones, item_id=r.item_id)) <= files // 2
        assert len(files_for(zones, pt=r.pt)) <= files // 2
        assert len(files_for(zones, item_id=r.item_id, pt=r.pt)) <= files // 4
        got = lookup_clustered(spark, f"{scratch}/z", zones, item_id=r.item_id, pt=r.pt)
        want = src.where((F.col("item_id") == r.item_id) & (F.col("pt") == r.pt))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(*got.columns).collect()), key=repr)
    assert lookup_clustered(spark, f"{scratch}/z", zones, item_id=-5).count() == 0

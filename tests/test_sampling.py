import pytest
from pyspark.sql import functions as F

from panelcraft.functions import draw_key, uniform
from panelcraft.operators import pin_then_fill, sample_quota, sample_topk, sample_weighted_topk, two_stage_sample


@pytest.fixture(scope="module")
def items(spark):
    # 20 groups; group 0 holds a third of all rows
    rows = [(i, 0 if i % 3 == 0 else i % 20, i % 7, i % 2) for i in range(3000)]
    return spark.createDataFrame(rows, "item_id long, grp long, w long, flag long")


def test_draw_key_matches_reference_value(spark):
    # md5('42:7') -> first 13 hex digits as an integer (the same in any SQL engine)
    v = spark.range(1).select(F.conv(F.substring(F.md5(F.lit("42:7")), 1, 13), 16, 10).cast("bigint")).first()[0]
    assert v == 1477910627807661
    k = spark.range(1).select(draw_key(42, "x", F.lit(1)).alias("k"), uniform(42, "x", F.lit(1)).alias("u")).first()
    assert 0 <= k.k < 2**52 and 0 < k.u < 1


def test_topk_never_exceeds_k_and_plans_partial_limit(items):
    out = sample_topk(items, ["grp"], 5, 42, "s", ["item_id"])
    counts = {r.grp: r["count"] for r in out.groupBy("grp").count().collect()}
    assert max(counts.values()) == 5 and len(counts) == 20
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_same_seed_same_sample_any_partitioning(spark, items, parts):
    base = sorted(r.item_id for r in sample_topk(items, ["grp"], 7, 3, "s", ["item_id"]).collect())
    shuffled = items.repartition(parts, "flag")
    again = sorted(r.item_id for r in sample_topk(shuffled, ["grp"], 7, 3, "s", ["item_id"]).collect())
    assert base == again


def test_different_seed_different_sample(items):
    a = {r.item_id for r in sample_topk(items, ["grp"], 7, 1, "s", ["item_id"]).collect()}
    b = {r.item_id for r in sample_topk(items, ["grp"], 7, 2, "s", ["item_id"]).collect()}
    assert a != b


def test_quota_per_stratum_and_missing_stratum(items):
    out = sample_quota(items, "grp", {0: 50, 1: 3, 2: 1000}, 42, "q", ["item_id"])
    counts = {r.grp: r["count"] for r in out.groupBy("grp").count().collect()}
    assert counts[0] == 50 and counts[1] == 3
    assert counts[2] == items.where("grp = 2").count()  # stratum smaller than its quota
    assert set(counts) == {0, 1, 2}  # strata without a quota keep nothing


def test_weighted_draw_favours_heavy_rows(spark):
    df = spark.createDataFrame([(i, 1 if i < 50 else 20) for i in range(100)], "item_id long, w long").withColumn("g", F.lit(1))
    heavy = 0
    for seed in range(30):
        picked = [r.item_id for r in sample_weighted_topk(df, ["g"], "w", 5, seed, "w", ["item_id"]).collect()]
        heavy += sum(1 for i in picked if i >= 50)
    assert heavy > 0.8 * 30 * 5


def test_weighted_zero_weights(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 5), (4, 0)], "item_id long, w long").withColumn("g", F.lit(1))
    last = [r.item_id for r in sample_weighted_topk(df, ["g"], "w", 1, 1, "w", ["item_id"], zero="last").collect()]
    assert last == [3]  # zero / NULL weights go last
    unit = sample_weighted_topk(df, ["g"], "w", 4, 1, "w", ["item_id"], zero="unit").count()
    assert unit == 4


def test_two_stage_limits(items):
    out = two_stage_sample(items, "flag", "grp", 3, 4, 42, ["item_id"])
    per_level = {r.flag: r.c for r in out.groupBy("flag").agg(F.countDistinct("grp").alias("c")).collect()}
    assert all(v <= 3 for v in per_level.values())
    assert max(r["count"] for r in out.groupBy("flag", "grp").count().collect()) <= 4


def test_pin_then_fill(items):
    df = items.withColumn("elig_type", F.lit("x")).withColumn("flag", ((F.col("item_id") / 20).cast("long") % 2))
    out = pin_then_fill(df, ["grp"], "flag", 2, 5, 42, ["item_id", "elig_type"])
    rows = out.collect()
    by_grp = {}
    for r in rows:
        by_grp.setdefault(r.grp, []).append(r)
    for g, rs in by_grp.items():
        assert len(rs) == 7
        assert len({r.item_id for r in rs}) == 7  # pinned rows are excluded from the fill
        assert sum(r.flag for r in rs) >= 2


def test_large_quota_is_the_plain_draw(spark):
    """The key histogram only drops rows that cannot be drawn."""
    from panelcraft.operators.sampling import ranked

    rows = [(i, 0 if i % 2 else 1 + i % 3) for i in range(20000)]  # group 0 holds half the rows
    df = spark.createDataFrame(rows, "item_id long, grp long")
    quotas = {0: 2000, 1: 5, 2: 3000}
    plain = ranked(df, ["grp"], [draw_key(9, "q", F.col("grp"), F.col("item_id")), F.col("item_id")]).collect()
    expected = sorted(r.item_id for r in plain if r.grp in quotas and r.rn <= quotas[r.grp])
    drawn = sample_quota(df, "grp", quotas, 9, "q", ["item_id"])
    assert sorted(r.item_id for r in drawn.collect()) == expected
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    assert before == "10000"  # set with the session, not by a query

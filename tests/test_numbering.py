import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcraft.operators import bands, equal_freq_band, exact_percentiles, global_ntile, number_within
from panelcraft.operators.numbering import pieces
from panelcraft.operators.ordering import sort_keys


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        # one hot group holds a third of the rows; values with many ties and some NULLs
        g = 0 if i % 3 == 0 else rnd.randint(1, 40)
        v = None if i % 97 == 0 else rnd.randint(0, 50)
        rows.append((i, g, v))
    return spark.createDataFrame(rows, "id long, g long, v long")


def test_number_within_matches_row_number(skewed):
    order = [F.col("v").asc_nulls_first(), F.col("id").asc()]
    ours = number_within(skewed, ["g"], order, rn="rn", size="n").select("id", "rn", "n")
    w = Window.partitionBy("g").orderBy(*order)
    ref = skewed.select("id", F.row_number().over(w).cast("bigint").alias("rn"), F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 50])
def test_equal_freq_band_matches_ntile(skewed, n):
    order = [F.col("v").asc_nulls_first(), F.col("id").asc()]
    ours = equal_freq_band(skewed, ["g"], order, n, out="b").select("id", "b")
    ref = equal_freq_band(skewed, ["g"], order, n, out="b", distributed=False).select("id", "b")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.collect()))


@pytest.mark.parametrize("rows", [1, 2, 5, 1001])
def test_global_ntile_matches_window(spark, rows):
    df = spark.range(rows).withColumn("v", (F.col("id") * 7919) % 13)
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    ours = global_ntile(df, order, 3, out="b").select("id", "b")
    ref = global_ntile(df, order, 3, out="b", distributed=False).select("id", "b")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.collect()))


def test_global_ntile_empty(spark):
    df = spark.range(0).withColumn("v", F.col("id"))
    assert global_ntile(df, [F.col("v")], 3).count() == 0


def test_global_ntile_has_no_single_partition_exchange(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 10)
    plan = global_ntile(df, [F.col("v").desc(), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    # the only single-partition exchange carries the per-partition counts (one row per partition)
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate(keys=[_pid" in lines[i + 1]
    assert "ntile(" not in plan


def test_exact_percentiles_match_percentile(skewed):
    ps = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}
    ours = exact_percentiles(skewed, "v", ps).first().asDict()
    ref = skewed.agg(*[F.round(F.percentile("v", p), 6).alias(k) for k, p in ps.items()]).first().asDict()
    assert ours == ref


def test_exact_percentiles_hot_value(spark):
    # one value holds most rows: still exact
    df = spark.createDataFrame([(5,)] * 500 + [(i,) for i in range(100)], "v long")
    ours = exact_percentiles(df, "v", {"m": 0.5, "p": 0.9}).first()
    ref = df.agg(F.round(F.median("v"), 6).alias("m"), F.round(F.percentile("v", 0.9), 6).alias("p")).first()
    assert (ours.m, ours.p) == (ref.m, ref.p)


@pytest.mark.parametrize("values", [[7] * 10, [3], [None, None, 1], [2, 2, 1, 1]])
def test_bands_edge_cases(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long").withColumn("g", F.lit(1))
    order = [F.col("v").asc_nulls_first(), F.col("id").asc()]
    ours = equal_freq_band(df, ["g"], order, 4, out="b").select("id", "b")
    ref = equal_freq_band(df, ["g"], order, 4, out="b", distributed=False).select("id", "b")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.collect()))


def test_percentiles_with_ties_are_even(spark):
    """90 % of the rows share one value: it is one counted row, and no task gets the ties."""
    from panelcraft.operators.aggregates import _cumulated_values

    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("v"))
    rows = _cumulated_values(df, "v")
    assert rows.count() == 4001
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    ours = exact_percentiles(df, "v", {"p": 0.95}).first().p
    assert ours == df.agg(F.round(F.percentile("v", 0.95), 6).alias("p")).first().p


def test_hot_groups_are_cut_into_pieces(spark):
    # group 1 holds two thirds of the rows, others are small; nulls and ties in the first key
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id") % 50 + 2).alias("g"),
        F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") * 7919) % 40).alias("v"), "id",
    )
    _, cut = pieces(df, ["g"], ["-v", "id"])
    assert len(cut) == 1 and len(cut[0]) > 30
    for order in (["-v", "id"], ["v", "-id"]):
        got = number_within(df, ["g"], order, rn="rn", size="n")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and "Join" not in plan  # no store, no join back
        w = Window.partitionBy("g").orderBy(*[k.column for k in sort_keys(order)])
        want = df.select("id", F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n"))
        assert sorted(map(tuple, got.select("id", "rn", "n").collect())) == sorted(map(tuple, want.collect()))


def test_pieces_of_a_hot_group_are_even(spark):
    df = spark.range(20000).select((F.col("id") % 2).alias("g"), F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, 0, 0, cast(id % 5000 as int))").alias("t"), "id")
    piece, cut = pieces(df, ["g"], ["t", "id"])
    sizes = [r["count"] for r in df.groupBy(piece.alias("p")).count().collect()]
    assert len(sizes) == sum(map(len, cut)) and max(sizes) < 4 * 20000 / len(sizes)


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("n", [2, 3, 5])
def test_exact_selection_narrows_large_groups(spark, skewed, monkeypatch, by, n):
    monkeypatch.setattr(bands, "FINISH", 20)  # groups of more rows are bracketed
    monkeypatch.setattr(bands, "SHARE", 100_000)
    monkeypatch.setattr(bands, "BRACKETS", 30)
    order = ["-v", "id"]
    got = equal_freq_band(skewed, by, order, n, out="b")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange range" not in plan and "Sort " not in plan
    want = equal_freq_band(skewed, by, order, n, out="b", distributed=False)
    assert sorted(map(tuple, got.select("id", "b").collect())) == sorted(map(tuple, want.select("id", "b").collect()))


@pytest.mark.parametrize("finish", [20, 100_000])
def test_bands_that_begin_among_equal_keys(spark, monkeypatch, finish):
    """Copies of a row are split between bands like any other rows, in the numbers that NTILE gives."""
    monkeypatch.setattr(bands, "FINISH", finish)
    monkeypatch.setattr(bands, "SHARE", 100_000)
    for rows in ([(1, 1)] * 100, [(1, i // 7) for i in range(100)], [(i % 2, i // 30) for i in range(90)]):
        df = spark.createDataFrame(rows, "g long, v long")
        for by in ([], ["g"]):
            got, want = (equal_freq_band(df, by, ["v"], 3, out="b", distributed=x) for x in (True, False))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bands_with_too_many_groups_are_numbered(spark, skewed, monkeypatch):
    monkeypatch.setattr(bands, "MAX_GROUPS", 5)
    order = [F.col("v").asc_nulls_first(), F.col("id").asc()]
    got, want = (equal_freq_band(skewed, ["g"], order, 4, out="b", distributed=x).select("id", "b").collect() for x in (True, False))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_orders_must_be_plain_columns():
    assert [k.descending for k in sort_keys(["-a", "b", F.col("c").desc()])] == [True, False, True]
    with pytest.raises(ValueError):
        sort_keys([F.abs("a").desc()])

import datetime as dt

from pyspark.sql import functions as F

from panelcraft.sources import append_into, create_table, latest_partition, latest_partition_value, materialize, read_daily, write_bucketed, write_partitioned
from panelcraft.sources.schemas import DAILY


def test_materialize_ignore_keeps_stale_rows(spark):
    spark.sql("DROP TABLE IF EXISTS t_ignore")
    materialize(spark.range(3), "t_ignore")
    again = materialize(spark.range(10), "t_ignore")
    assert again.count() == 3
    assert materialize(spark.range(10), "t_ignore", mode="overwrite").count() == 10
    spark.sql("DROP TABLE t_ignore")


def test_ledger_append(spark):
    spark.sql("DROP TABLE IF EXISTS t_ledger")
    create_table(spark, "t_ledger", spark.createDataFrame([], "item_id bigint").schema, comment="ids already sampled")
    append_into(spark.createDataFrame([(1,), (2,)], "item_id bigint"), "t_ledger")
    append_into(spark.createDataFrame([(3,)], "item_id bigint"), "t_ledger")
    assert sorted(r.item_id for r in spark.table("t_ledger").collect()) == [1, 2, 3]
    spark.sql("DROP TABLE t_ledger")


def test_bucketed_layout_avoids_shuffle(spark):
    for t in ("t_b1", "t_b2"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
        write_bucketed(spark.range(100).withColumn("shop_id", F.col("id") % 7), t, n=4, key="shop_id")
    a, b = spark.table("t_b1"), spark.table("t_b2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a.join(b, "shop_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
    for t in ("t_b1", "t_b2"):
        spark.sql(f"DROP TABLE {t}")


def test_partitioned_layout_and_latest_partition(spark, scratch):
    rows = [(i, 1, None, dt.datetime(2025, 1, d), 1, 1, 100, 1, 1, 1, 1, 1, f"202501{d:02d}") for i in range(3) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, DAILY)
    path = f"{scratch}/daily"
    write_partitioned(df, path, "pt")
    back = read_daily(spark, path)
    spark.createDataFrame(rows[:1], DAILY).withColumn("pt", F.lit(None).cast("string")).write.mode("append").partitionBy("pt").parquet(path)
    back = read_daily(spark, path)
    assert latest_partition_value(back, "pt") == latest_partition_value(back, "pt", root=path) == "20250103"  # the null partition is none
    latest = latest_partition(back, "pt", root=path)
    assert {r.pt for r in latest.collect()} == {"20250103"}
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pt" in plan


def test_typed_wide_table_overwrite(spark):
    from panelcraft.plans.registry import wide
    from panelcraft.sources import cast_to, fixture_sources, overwrite_into, typed_schema
    from panelcraft.sources.schemas import WIDE_TABLE_TYPES

    w = wide(fixture_sources(spark, "/root/testdata/sf0.001"), 3)
    spark.sql("DROP TABLE IF EXISTS t_wide_typed")
    create_table(spark, "t_wide_typed", typed_schema(w, WIDE_TABLE_TYPES, {"days_diff": "days from sale start"}), comment="wide items")
    overwrite_into(cast_to(w, WIDE_TABLE_TYPES), "t_wide_typed")
    overwrite_into(cast_to(w, WIDE_TABLE_TYPES), "t_wide_typed")  # overwrite, not append
    t = spark.table("t_wide_typed")
    types = dict(t.dtypes)
    assert types["item_id"] == "string" and types["item_cprice"] == "double" and types["days_diff"] == "bigint"
    assert t.count() == w.count()
    spark.sql("DROP TABLE t_wide_typed")


def test_a_hot_day_is_written_by_several_tasks(spark, scratch):
    """A day with most of the rows is split over tasks and files; no row is lost or moved."""
    import glob

    df = spark.range(0, 200_000, 1, 8).select("id", F.md5(F.col("id").cast("string")).alias("x"), F.when(F.col("id") % 10 > 0, "20250101").otherwise(F.concat(F.lit("2025020"), F.col("id") % 7)).alias("pt"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1000000")
    try:
        write_partitioned(df, f"{scratch}/hot")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(glob.glob(f"{scratch}/hot/pt=20250101/*.parquet")) >= 3
    assert len(glob.glob(f"{scratch}/hot/pt=20250201/*.parquet")) <= 2
    back = spark.read.parquet(f"{scratch}/hot")
    assert {r.pt: r["count"] for r in back.groupBy(F.col("pt").cast("string").alias("pt")).count().collect()} == {r.pt: r["count"] for r in df.groupBy("pt").count().collect()}


def test_one_file_a_bucket(spark):
    spark.sql("DROP TABLE IF EXISTS t_files")
    write_bucketed(spark.range(0, 1000, 1, 8).withColumn("shop_id", F.col("id") % 97), "t_files", n=4, key="shop_id")
    assert len(spark.table("t_files").inputFiles()) == 4
    spark.sql("DROP TABLE t_files")


def daily_rows(spark, days):
    rows = [(i, i % 3, d, i * 10) for d in days for i in range(5)]
    return spark.createDataFrame(rows, "item_id long, shop_id long, pt string, cprice long")


def test_refresh_rebuilds_changed_days_only(spark, scratch):
    import os

    from panelcraft.sources.refresh import refresh

    for t in ("t_fresh", "t_fresh__manifest"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    root, built = f"{scratch}/src", []
    daily_rows(spark, ["20250101", "20250102", "20250103"]).write.partitionBy("pt").parquet(root)

    def build(df):
        built.append(sorted(r.pt for r in df.select("pt").distinct().collect()))
        return df.where("item_id > 0").select("item_id", "pt", (F.col("cprice") + 1).alias("price"))

    def source():
        spark.catalog.refreshByPath(root)
        return spark.read.schema("item_id long, shop_id long, cprice long, pt string").parquet(root)

    def same_as_full():
        full = source().where("item_id > 0").select("item_id", (F.col("cprice") + 1).alias("price"), "pt")
        spark.catalog.refreshTable("t_fresh")
        return sorted(map(tuple, spark.table("t_fresh").select("item_id", "price", "pt").collect())) == sorted(map(tuple, full.collect()))

    assert refresh(source(), root, "t_fresh", build) == ["20250101", "20250102", "20250103"] and same_as_full()
    assert refresh(source(), root, "t_fresh", build) == []  # nothing changed: nothing is read
    files = {f for f in spark.table("t_fresh").inputFiles()}
    daily_rows(spark, ["20250104"]).union(spark.createDataFrame([(9, 9, "20250102", 9)], "item_id long, shop_id long, pt string, cprice long")).write.mode("append").partitionBy("pt").parquet(root)
    assert refresh(source(), root, "t_fresh", build) == ["20250102", "20250104"] and same_as_full()
    assert built == [["20250101", "20250102", "20250103"], ["20250102", "20250104"]]
    kept = {f for f in spark.table("t_fresh").inputFiles()}
    assert all(("pt=20250101" in f or "pt=20250103" in f) == (f in kept) for f in files)  # other days' files are untouched
    for f in os.listdir(f"{root}/pt=20250103"):
        os.remove(f"{root}/pt=20250103/{f}")
    assert refresh(source(), root, "t_fresh", build) == ["20250103"] and same_as_full()
    # a day whose rows are all filtered away now
    spark.createDataFrame([(0, 1, 1)], "item_id long, shop_id long, cprice long").write.mode("overwrite").parquet(f"{root}/pt=20250104")
    assert refresh(source(), root, "t_fresh", build) == ["20250104"] and same_as_full()
    # killed after the rows, before the manifest: the next refresh does the day again
    spark.sql("ALTER TABLE t_fresh__manifest DROP PARTITION (value='20250101')")
    assert refresh(source(), root, "t_fresh", build) == ["20250101"] and same_as_full()
    for t in ("t_fresh", "t_fresh__manifest"):
        spark.sql(f"DROP TABLE {t}")

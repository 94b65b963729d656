import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcraft.functions import (
    HAS_IMAGE_VARIANTS,
    day_range,
    day_string,
    days_between,
    has_image,
    no_image,
    parse_day,
    valid_sale_start,
)

BS = "\\"
VALUES = [None, "", " ", "[]", " [] ", BS + "N", " " + BS + "N ", '["a.jpg"]']
# expected has_image per variant, in VALUES order (None = SQL NULL predicate result)
EXPECTED = {
    "trimmed": [False, False, False, False, False, True, True, True],
    "trimmed_n": [False, False, False, False, False, False, False, True],
    "raw_n": [False, False, False, False, True, False, True, True],
    "raw": [None, False, True, False, True, True, True, True],
    "nonempty": [False, False, True, True, True, True, True, True],
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")


@pytest.mark.parametrize("variant", HAS_IMAGE_VARIANTS)
def test_has_image_truth_table(texts, variant):
    rows = texts.select("i", has_image("v", variant).alias("p")).orderBy("i").collect()
    assert [r.p for r in rows] == EXPECTED[variant]


def test_no_image_is_null_safe_complement(texts):
    rows = texts.select(has_image("v", "trimmed_n").alias("p"), no_image("v").alias("q")).collect()
    for r in rows:
        assert r.q is not None
        assert r.q == (not r.p)


def test_valid_sale_start(spark):
    df = spark.createDataFrame(
        [(1, 5, "2025-01-02"), (2, 0, "2025-01-02"), (3, None, "2025-01-02"), (4, 3, " "), (5, 3, None), (6, 3, "[]")],
        "id int, start_sell_volume bigint, start_sell_date string",
    )
    keep = [r.id for r in df.where(valid_sale_start()).collect()]
    keep_strict = [r.id for r in df.where(valid_sale_start(reject_empty_list=True)).collect()]
    assert sorted(keep) == [1, 6]
    assert sorted(keep_strict) == [1]


def test_parse_day_formats(spark):
    df = spark.createDataFrame([("2025-03-04",), ("20250304",), ("",), ("x",), (None,)], "s string")
    dashed = [r[0] for r in df.select(parse_day("s", "yyyy-MM-dd")).collect()]
    compact = [r[0] for r in df.select(parse_day("s", "yyyyMMdd")).collect()]
    assert dashed == [dt.date(2025, 3, 4), None, None, None, None]
    assert compact == [None, dt.date(2025, 3, 4), None, None, None]


def test_day_string_uses_month_not_minutes(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 3, 4, 5, 6),)], "ts timestamp_ntz")
    assert df.select(day_string("ts")).first()[0] == "2025-03-04"


def test_days_between_counts_day_boundaries(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1, 23, 0), dt.datetime(2025, 1, 2, 0, 6))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(days_between("b", "a")).first()[0] == 1


def test_day_range_equals_to_date_between(spark):
    ts = [dt.datetime(2025, 12, 31, 0, 0), dt.datetime(2025, 12, 31, 23, 59, 59), dt.datetime(2026, 1, 1, 0, 0), dt.datetime(2024, 12, 31, 23, 59)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz")
    lo, hi = dt.date(2025, 1, 1), dt.date(2025, 12, 31)
    a = sorted(r.t for r in df.where(day_range("t", lo, hi)).collect())
    b = sorted(r.t for r in df.where(F.to_date("t").between(F.lit(lo), F.lit(hi))).collect())
    assert a == b == ts[:2]


def test_day_range_is_pushed_to_scan(spark, scratch):
    path = f"{scratch}/t"
    spark.createDataFrame([(dt.datetime(2025, 1, 2),)], "t timestamp_ntz").write.parquet(path)
    plan = spark.read.parquet(path).where(day_range("t", dt.date(2025, 1, 1), dt.date(2025, 1, 31)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t," in plan


def test_never_or_after_counts_the_cutoff_day_after_midnight(spark):
    from panelcraft.functions import never_or_after

    ts = [None, dt.datetime(2025, 12, 31, 0, 0, 0), dt.datetime(2025, 12, 31, 0, 0, 1), dt.datetime(2025, 12, 30, 23, 0)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, t timestamp_ntz")
    kept = sorted(r.i for r in df.where(never_or_after("t", dt.date(2025, 12, 31))).collect())
    assert kept == [0, 2]  # never, or after midnight of the cutoff day (quirk Q7)

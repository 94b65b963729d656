"""Property tests: the NTILE arithmetic and the distributed numbering under random layouts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcraft.operators import equal_freq_band, number_within


def ntile_reference(n_rows: int, k: int) -> list[int]:
    """SQL NTILE: sizes differ by at most one, larger buckets first."""
    base, extra = divmod(n_rows, k)
    out = []
    for b in range(1, k + 1):
        out += [b] * (base + (1 if b <= extra else 0))
    return out


def ntile_formula(i: int, n: int, k: int) -> int:
    # same arithmetic as operators.numbering.ntile_of, in Python
    q, r = divmod(n, k)
    big = r * (q + 1)
    return i // (q + 1) + 1 if i < big else r + (i - big) // max(q, 1) + 1


@given(st.integers(min_value=0, max_value=500), st.integers(min_value=1, max_value=60))
def test_ntile_formula_equals_sql_ntile(n, k):
    assert [ntile_formula(i, n, k) for i in range(n)] == ntile_reference(n, k)


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20)), min_size=1, max_size=120),
    st.integers(1, 6),
    st.integers(1, 9),
)
def test_distributed_band_equals_window(spark, rows, k, parts):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id long, g long, v long").repartition(parts)
    order = [F.col("v").asc(), F.col("id").asc()]
    ours = equal_freq_band(df, ["g"], order, k, out="b").select("id", "b").collect()
    ref = df.select("id", F.ntile(k).over(Window.partitionBy("g").orderBy(*order)).cast("bigint").alias("b")).collect()
    assert sorted(map(tuple, ours)) == sorted(map(tuple, ref))


@settings(max_examples=5, deadline=None)
@given(st.integers(1, 400), st.integers(1, 12))
def test_numbering_is_a_permutation(spark, n, parts):
    df = spark.range(n).withColumn("g", F.col("id") % 2).repartition(parts)
    out = number_within(df, ["g"], [F.col("id").desc()], rn="rn", size="sz").collect()
    for g in (0, 1):
        rns = sorted(r.rn for r in out if r.g == g)
        assert rns == list(range(1, len(rns) + 1))
        assert all(r.sz == len(rns) for r in out if r.g == g)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" []\\Na", max_size=5)), min_size=1, max_size=40))
def test_picture_predicates_agree_with_duckdb(spark, texts):
    import duckdb

    from panelcraft.functions import HAS_IMAGE_VARIANTS, has_image, no_image
    from panelcraft.plans import oracle

    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "i int, v string")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    for variant in HAS_IMAGE_VARIANTS:
        # compare as filters (NULL and FALSE both drop the row), as the queries use them
        ours = sorted(r.i for r in df.where(has_image("v", variant)).collect())
        theirs = sorted(r[0] for r in con.execute(f"SELECT i FROM t WHERE {oracle.has_image('v', variant)}").fetchall())
        assert ours == theirs, variant
    ours = sorted(r.i for r in df.where(no_image("v")).collect())
    theirs = sorted(r[0] for r in con.execute(f"SELECT i FROM t WHERE {oracle.no_image('v')}").fetchall())
    assert ours == theirs

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcraft.llm import hard_negatives as hn

ROW = "vec_id long, label int, embedding array<float>"


def brute_force(rows, is_anchor, positives=5, negatives=3):
    """Every pair of rows in plain numbers; rows as (id, label, vector)."""
    whole = set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, v in whole:
        if not is_anchor(a):
            continue
        told = sorted((-score(v, w), i, other) for i, other, w in whole if i != a)
        for s, p, _ in [x for x in told if x[2] == label][:positives]:
            inside = [x for x in told if x[2] != label and -50 * s <= -100 * x[0] <= -95 * s][:negatives]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(df, is_anchor, **kw):
    got = hn.hard_negatives(df, is_anchor, **kw)
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.select(*cols).collect())


@pytest.fixture(scope="module")
def vectors():
    """Two hot directions, ties, repeats, several lengths, and rows that take no part."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 12))
    rows = []
    for i in range(900):
        label = 0 if i % 3 == 0 else int(rng.integers(4))
        v = centres[label] + rng.normal(scale=1.0 if i % 2 else 0.2, size=12)
        rows.append((i, label, (v * (5 if i % 7 == 0 else 0.3)).tolist()))
    rows += [(900 + i, i % 4, centres[0].tolist()) for i in range(200)]  # one vector, all labels
    rows += rows[:20]  # repeated rows
    rows += [(5, 3, centres[1].tolist()), (1200, 1, [0.0] * 12), (1201, 1, [1.0, 2.0]), (1202, 2, [])]
    rows += [(1300, None, [1.0] * 12), (1301, 1, None), (1302, 1, [None] * 12), (None, 1, [1.0] * 12)]
    rows += [(1350, 1, [float("nan")] * 12), (1400, 2, [float("inf")] + [0.0] * 11)]
    return rows


def test_brute_force(spark, vectors, monkeypatch):
    df = spark.createDataFrame(vectors, ROW).repartition(3)
    want = brute_force(vectors, lambda i: i % 50 == 0)
    assert len(want) > 50
    by_id = F.col("vec_id") % 50 == 0
    assert mined(df, by_id) == want
    monkeypatch.setattr(hn, "CHUNK", 7)  # the anchors in several blocks
    assert mined(df, by_id) == want


def test_whole_numbers_beyond_exact_floats(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, (rng.integers(-(2**21), 2**21, 4) + 2.0**20).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, ROW)
    want = brute_force(rows, lambda i: i % 10 == 0)
    assert max(abs(r[4]) for r in want) > 2**53 and mined(df, F.col("vec_id") % 10 == 0) == want
    with pytest.raises(ValueError):
        hn.hard_negatives(spark.createDataFrame([(0, 1, [1e12])], ROW), F.col("vec_id") % 10 == 0)


def test_pruned_candidates_hold_every_row_that_scores(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(-300, 300, (400, 8))
    v[:60] = v[0] + rng.integers(-30, 30, (60, 8))
    v = np.rint(v * 1000 / np.sqrt((v**2).sum(axis=1))[:, None]).astype(np.int64)  # of one length, as in a bucket
    ids, n2 = np.arange(400), (v.astype(float) ** 2).sum(axis=1)
    order = np.argsort(-n2)
    b = hn.Bucket(ids[order], 0, v[order], n2[order], np.float64)
    table = pa.table({"vec_id": ids[:40], "label": ids[:40] * 0 + 1, "v": pa.array(v[:40].tolist(), pa.list_(pa.int64()))})
    a = hn.Anchors(table, 8, True)
    scores = a.q @ b.v.T.astype(np.int64)
    need = np.sort(scores, axis=1)[:, -5]
    whole, some = b.candidates(a, np.arange(40), need)
    assert len(some) > 20 and all(len(rows) <= 150 for _, rows in some)
    seen = {int(i): set(range(400)) for i in whole} | {i: set(rows.tolist()) for i, rows in some}
    for i in range(40):
        assert set(np.flatnonzero(scores[i] >= need[i]).tolist()) <= seen[i]
    beyond = a.length * b.longest * 1.01
    assert [len(x) for x in b.candidates(a, np.arange(40), beyond)] == [0, 0]  # the bucket is skipped


def test_query_relabels_and_reads_whole_table(spark, sf, scratch):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(10)), rng.normal(scale=0.2, size=16).tolist()) for i in range(1500)]
    spark.createDataFrame(rows, ROW).write.parquet(f"{scratch}/embeddings.parquet")
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    got = hn.op11_hard_negatives(spark, scratch)
    assert dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == brute_force(moved, lambda i: i % 50 == 0)


def test_edge_tables(spark, vectors):
    empty = spark.createDataFrame([], ROW)
    assert mined(empty, F.col("vec_id") % 50 == 0) == []
    df = spark.createDataFrame(vectors, ROW)
    assert mined(df, F.col("vec_id") < 0) == []
    clash = df.withColumnsRenamed({"vec_id": "v", "label": "slot"}).selectExpr("*", "1 as vec_id", "2 as label", "3 as score")
    got = hn.hard_negatives(clash, F.col("vec_id") % 50 == 0, "v", "slot", "embedding")
    assert got.count() == len(brute_force(vectors, lambda i: i % 50 == 0))

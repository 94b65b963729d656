import zlib

import numpy as np
import pytest

from panelcraft.llm import toxicity as tx


@pytest.fixture(scope="module")
def corpus(spark, sf):
    """Texts of neutral words; a fifth has one of three bad words; half of all rows has a label."""
    rng = np.random.default_rng(4)
    words, bad = [f"word{i}" for i in range(300)], ["scumbag", "idiotic", "moronic"]
    docs, labels = [], []
    for i in range(3000):
        text = rng.choice(words, 40).tolist()
        toxic = i % 5 == 0
        if toxic:
            text[int(rng.integers(40))] = bad[int(rng.integers(3))]
        docs.append((i, " ".join(text)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(corpus):
    docs, labels = corpus
    model = tx.train(docs, labels)
    rows = tx.with_scores(docs, model, "score").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    toxic = np.array([r.doc_id % 5 == 0 for r in held])
    predicted = np.array([r.score >= tx.THRESHOLD for r in held])
    assert (predicted[toxic]).mean() > 0.95 and (predicted[~toxic]).mean() < 0.01
    assert all(0 <= r.score <= 1 for r in rows)
    kept = {r.doc_id for r in tx.drop_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if r.score < tx.THRESHOLD}


def test_held_out_labels_change_nothing(corpus):
    docs, labels = corpus
    other = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1, 1 - toxic, toxic) as toxic")
    a, b = tx.train(docs, labels), tx.train(docs, other)
    assert (a.hashes == b.hashes).all() and (a.weights == b.weights).all() and a.bias == b.bias


def test_negative_risk_does_not_go_below_zero():
    """Separable samples: without the correction the negatives' risk would become negative."""
    positive = [np.array([1, 10 + i % 3], np.uint64) for i in range(40)]
    unlabelled = [np.array([10 + i % 3] + [1] * (i < 4), np.uint64) for i in range(60)]
    m = tx.fit_nnpu(positive, [np.unique(u) for u in unlabelled], 0.3)
    f_p, f_u = m.bias + m.weights.sum(), np.array([m.bias + m.weights.sum() * (i < 4) for i in range(60)])
    risk = np.logaddexp(0, f_u).mean() - 0.3 * np.logaddexp(0, f_p)
    assert risk > -0.05 and f_p > 0 > m.bias


def test_query(spark, sf, documents):
    rows = {r.doc_id: r for r in tx.op10_toxicity(spark, sf).collect()}
    assert sorted(rows) == sorted(d for d, _ in documents)
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)


def test_odd_documents(spark, odd, empty, corpus):
    docs, labels = corpus
    model = tx.train(docs, labels)
    scores = {r.doc_id: r.score for r in tx.with_scores(odd, model, "score").collect()}
    base = round(float(tx.sigmoid(np.array([model.bias]))[0]), 9)
    assert scores[0] == scores[1] == scores[2] == base
    assert tx.with_scores(empty, model, "score").count() == 0
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert tx.train(odd, none) is None and tx.drop_toxic(odd, none).count() == odd.count()
    clash = odd.withColumnsRenamed({"lang": "toxicity"})
    assert tx.drop_toxic(clash, labels).columns == clash.columns


def test_a_repeated_id_is_learnt_from_once(spark, corpus, monkeypatch):
    """An id in very many rows neither fills the sample nor reaches the driver row by row."""
    docs, labels = corpus
    hot = docs.where("doc_id = 5").crossJoin(spark.range(20_000).select()).unionByName(docs)
    taken = []
    fit = tx.fit_nnpu
    monkeypatch.setattr(tx, "fit_nnpu", lambda p, u, prior: taken.append((p, u)) or fit(p, u, prior))
    a, b = tx.train(docs, labels, 50, 100), tx.train(hot, labels, 50, 100)
    (p1, u1), (p2, u2) = taken
    assert len(p2) <= 50 and len(u2) <= 100 and [len(p1), len(u1)] == [len(p2), len(u2)]
    assert (a.hashes == b.hashes).all() and (a.weights == b.weights).all()

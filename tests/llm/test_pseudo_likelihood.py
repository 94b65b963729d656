import numpy as np
import pyarrow as pa

from panelcraft.llm import pseudo_likelihood as pl
from panelcraft.llm.words import word_blocks


def test_training_beats_word_frequencies(spark, monkeypatch):
    """Texts of a fixed word order are predictable from both sides, and shuffled ones are not."""
    rng = np.random.default_rng(1)
    cycle = [f"w{i}" for i in range(20)]
    ordered = [(i, " ".join(cycle * 15)) for i in range(60)]
    mixed = [(100 + i, " ".join(rng.permutation(cycle * 15))) for i in range(3)]
    df = spark.createDataFrame(ordered + mixed, "doc_id long, text string").repartition(3)
    scores = {r.doc_id: r for r in pl.score(df).collect()}
    assert scores[0].n_words == 300 and scores[0].log_prob == round(scores[0].log_prob, 4)
    trained = np.mean([scores[i].mean_log_prob for i in range(60)])
    assert trained > np.mean([scores[100 + i].mean_log_prob for i in range(3)]) + 0.5
    assert trained > -np.log(20) + 0.5  # the frequencies alone give -log(20)


def test_gradient_matches_differences():
    rng = np.random.default_rng(2)
    net = pl.Network.start(np.full(pl.SIZE, 1 / pl.SIZE, np.float32))
    net.flat[:] = rng.normal(0, 0.3, len(net.flat))
    context, target = rng.integers(0, pl.SIZE + 1, (len(pl.OFFSETS), 40)), rng.integers(0, pl.SIZE, 40)
    g = net.gradient(context, target)
    for i in [*np.argsort(-np.abs(g))[:5], len(g) - 1]:
        step = np.zeros(len(g), np.float32)
        step[i] = 0.05
        up, down = (-pl.Network(net.flat + s * step).log_probs(context, target).mean() for s in (1, -1))
        assert abs((up - down) / 0.1 - g[i]) < 2e-3


def test_words_of_one_class_have_their_own_probabilities(spark):
    """Two texts that differ in one rare word each, of one class, differ by the words' counts."""
    names = [f"r{i}" for i in range(400)]
    classes = next(word_blocks(pa.array([" ".join(names)]))).hashes % np.uint64(pl.RARE)
    often, seldom = [n for n, c in zip(names, classes, strict=True) if c == classes[0]][:2]
    frequent = " ".join(f"f{i}" for i in range(pl.TOP))
    docs = [(i, frequent) for i in range(30)] + [(100, f"f1 f2 {often} f3 f4"), (101, f"f1 f2 {seldom} f3 f4")]
    docs += [(200 + i, often) for i in range(19)]
    got = {r.doc_id: r.log_prob for r in pl.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert abs(got[100] - got[101] - np.log(20)) < 1e-3


def test_every_position_is_learnt_from(spark):
    df = spark.createDataFrame([(i, "a b c") for i in range(40)] + [(99, "a b c d e f g " * 30)], "doc_id long, text string").repartition(3)
    net, none = pl.Network.start(np.full(pl.SIZE, 1 / pl.SIZE, np.float32)), np.zeros(0, np.uint64)
    learnt = [r.n for k in range(pl.ROUNDS) for r in pl._local(df, net, none, none.astype(np.int64), k).collect()]
    assert sum(learnt) == 40 * 3 + 30 * 7


def test_odd_documents(odd, empty):
    rows = {r.doc_id: r for r in pl.score(odd).collect()}
    assert pl.score(odd).count() == odd.count()
    assert (rows[0].n_words, rows[0].log_prob, rows[0].mean_log_prob) == (0, 0.0, 0.0) and rows[2].n_words == 0
    assert rows[3].n_words == 3 and rows[3].log_prob < 0
    assert pl.score(empty).count() == 0


def test_query_scores_every_document(spark, sf, documents):
    rows = pl.op4_pseudo_likelihood(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in documents)
    assert all(r.log_prob <= 0 for r in rows)


def plain_sum(text, net, known, counts):
    """A text's summed log probability word by word, from the definition."""
    words = next(word_blocks(pa.array([text])))
    hashes = words.hashes.tolist()
    number = lambda h: known[h] if h in known else pl.TOP + h % pl.RARE
    in_class = {}
    for h, n in counts.items():
        in_class[number(h)] = in_class.get(number(h), 0) + n
    total = 0.0
    for i, h in enumerate(hashes):
        hidden = net.hidden_bias.astype(float)
        for j, o in enumerate(pl.OFFSETS):
            at = i + o
            hidden = hidden + net.embed[j, number(hashes[at]) if 0 <= at < len(hashes) else pl.SIZE]
        hidden = np.tanh(hidden)
        cluster, leaf = divmod(number(h), pl.LEAVES)
        for weights, bias, own in ((net.out, net.out_bias, cluster), (net.leaf[cluster], net.leaf_bias[cluster], leaf)):
            logits = [sum(hidden[d] * float(weights[d, c]) for d in range(pl.DIM)) + float(bias[c]) for c in range(weights.shape[1])]
            total += logits[own] - np.log(sum(np.exp(x) for x in logits))
        total += np.log(counts[h] / in_class[number(h)]) if h not in known else 0
    return total


def test_scores_match_a_plain_computation(spark, sf, monkeypatch):
    """Every document's sum, of a small corpus with more words than there are classes."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 4000) for _ in range(150)] + ["only", "", "two words"]
    kept = []
    real = pl.train
    monkeypatch.setattr(pl, "train", lambda *a: kept.append(real(*a)) or kept[0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.log_prob for r in pl.score(df).collect()}
    net, top, ids = kept[0]
    known = dict(zip(top.tolist(), ids.tolist(), strict=True))
    counts = {}
    for b in word_blocks(pa.array(texts)):
        for h in b.hashes.tolist():
            counts[h] = counts.get(h, 0) + 1
    for d in [0, 1, 75, 149, 150, 151, 152]:
        assert abs(got[d] - plain_sum(texts[d], net, known, counts)) < 1e-2


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    net = pl.Network.start(np.full(pl.SIZE, 1 / pl.SIZE, np.float32))
    net.flat[:] = rng.normal(0, 0.5, len(net.flat))
    context = np.repeat(rng.integers(0, pl.SIZE + 1, (len(pl.OFFSETS), 1)), pl.SIZE, axis=1)
    assert abs(np.exp(net.log_probs(context, np.arange(pl.SIZE)).astype(float)).sum() - 1) < 1e-4


def test_clashing_columns(spark, sf):
    df = spark.createDataFrame([(1, "a b", 5, 6, "x")], "doc_id long, text string, row long, n_words long, hash string")
    assert pl.score(df).first().n_words == 2

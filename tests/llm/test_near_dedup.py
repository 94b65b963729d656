import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelcraft.llm import near_dedup as nd

from .test_words import plain_words


def shingle_set(text):
    w = plain_words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0))


def brute_classes(docs):
    """doc_id -> smallest doc_id, by all pairs that share a shingle."""
    sets, parent, owners, first = {d: shingle_set(t) for d, t in docs}, {d: d for d, _ in docs}, defaultdict(list), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    for d, t in docs:
        join(d, first.setdefault(t or "", d))
        for s in sets[d]:
            owners[s].append(d)
    for a, b in {(x, y) for o in owners.values() for i, x in enumerate(o) for y in o[i + 1 :]}:
        common = sum((sets[a] & sets[b]).values())
        if common >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - common):
            join(a, b)
    return {d: root(d) for d, _ in docs}


def test_classes_match_all_pairs(spark, sf, documents):
    got = {r.doc_id: (r.class_id, r.kept) for r in nd.op1_dart_minhash(spark, sf).collect()}
    expected = brute_classes(documents)
    assert {d: c for d, (c, _) in got.items()} == expected
    assert {d for d, (_, k) in got.items() if k} == set(expected.values())


def test_large_group_of_copies_and_chains(spark, sf):
    """A group larger than the leaders, whose members are often below the similarity pairwise."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(300), 5):
            words[at] = f"x{rng.random()}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, " ".join(f"y{rng.random()}" for _ in range(80))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()} == brute_classes(docs)


def edited(words, rng, n, name):
    """The words with n of them replaced, far from each other, by new ones."""
    words, step = list(words), len(words) // n
    for i in range(n):
        words[i * step + rng.randrange(step - 5)] = f"{name}n{i}"
    return words


def test_links_between_members_that_lead_no_bucket(spark, sf):
    """Second copies like one text of a large group only, and two groups that only such texts connect."""
    rng = random.Random(11)
    docs = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(400)]
        texts = [edited(base, rng, 1, f"g{g}c{i}") for i in range(40)]
        for i in range(40):
            a = edited(base, rng, 3, f"g{g}a{i}")
            b = edited(a, rng, 6, f"g{g}b{i}")
            texts += [a, b]
            if i == 0:
                texts += [edited(b, rng, 1, f"g{g}d{j}") for j in range(40)]
        docs += [(g * 1000 + i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    expected = brute_classes(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()} == expected


def test_pairs_in_a_family_below_the_similarity(spark, sf):
    """Near duplicates all of whose buckets are large and full of texts of other classes."""
    rng = random.Random(12)
    base, docs = [f"w{i}" for i in range(400)], []
    for i in range(300):
        a = edited(base, rng, 12, f"a{i}")
        docs.append((i, " ".join(a)))
        if i % 5 == 0:
            docs.append((1000 + i, " ".join(edited(a, rng, 7, f"b{i}"))))
    expected = brute_classes(docs)
    assert len(set(expected.values())) == 300
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df, bands=6, leaders=1).collect()} == expected


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    element = rng.integers(1, 2**63, 120).astype(np.uint64)
    a, b = rng.integers(1, 9, 120), rng.integers(1, 9, 120)
    row = np.repeat([0, 1], 120)
    sig = nd.dart_signatures(row, np.concatenate([element, element]), np.concatenate([a, b]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    alone = nd.dart_signatures(np.zeros(120, int), element, a, 1, 4000)
    assert (alone[0] == sig[0]).all()  # a set's signature does not depend on its batch
    one = nd.dart_signatures(np.array([0]), element[:1], np.array([1]), 1, 50)
    assert (one != 0).all()


def test_odd_documents(odd, empty):
    rows = nd.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[0][0].class_id == by[1][0].class_id == 0  # null and empty are equal texts
    assert by[2][0].class_id == 2  # without words: only exact copies
    assert {r.class_id for r in by[3]} == {3} and by[4][0].class_id == 3  # case is folded
    assert by[6][0].class_id == 5 and by[None][0].class_id is None and by[None][0].kept
    kept = nd.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.select("doc_id").collect()) == [-1, 0, 2, 3, 5, 7, 8, 9, 10, 11, 12]
    assert nd.near_duplicates(empty).count() == 0 and nd.drop_near_duplicates(empty).count() == 0


def test_clashing_columns(odd):
    renamed = odd.withColumnsRenamed({"lang": "text_key", "source": "key", "n_chars": "rep"})
    out = nd.drop_near_duplicates(renamed)
    assert out.columns == renamed.columns and out.count() == 11


@pytest.mark.parametrize("edges, expected", [([(2, 1), (3, 2), (9, 8), (4, 3), (7, 9)], {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}), ([], {})])
def test_components(spark, sf, edges, expected):
    links = spark.createDataFrame(edges, "a long, b long")
    assert {r.v: r.comp for r in nd.components(links, lambda df: df.checkpoint()).collect()} == expected

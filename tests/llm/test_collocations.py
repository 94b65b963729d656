import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from panelcraft.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(docs, min_count, subsumed_pct, top):
    """The definition in whole numbers; documents as (lang, text)."""
    grams, sizes = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            grams.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {g: n for g, n in grams.items() if len(g) > 2 and n >= min_count}
    out = {}
    for g, a in found.items():
        lang, words = g[0], g[1:]
        inside = [t for t in found if len(t) > len(g) and t[0] == lang and any(t[i : i + len(words)] == words for i in range(1, len(t)))]
        if any(100 * found[t] >= subsumed_pct * a for t in inside):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = grams[(lang, *words[:k])], grams[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, sizes[lang], -s)
        for lang, rows in out.items()
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)
    )


def texts(n, seed):
    """Few words, fixed phrases, pieces, letters of several bytes, and one phrase in a third of all rows."""
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "日本", "e", "Ä", "z\x00z", "|"]
    phrases = ["new york city", "Hot Phrase goes on", "salt and pepper", "beta beta beta"]
    out = []
    for i in range(n):
        parts = [rnd.choice(phrases) if rnd.random() < 0.3 else rnd.choice(words) for _ in range(rnd.randrange(1, 25))]
        text = "".join(p + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for p in parts)
        out.append((rnd.choice(["en", "de", None, "und"]), text + ("Hot Phrase goes on" if i % 3 == 0 else "")))
    return [*out, ("en", None), (None, ""), ("en", " .,\n"), ("xx", "once only here"), *out[:10]]


def mined(spark, docs, **kw):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, text string, n long, code string").repartition(3)
    return sorted(map(tuple, co.collocations(df, **kw).collect()))


def test_brute_force(spark, sf):
    docs = texts(250, 1)
    for kw in ({"min_count": 3, "subsumed_pct": 50, "top": 1000}, {"min_count": 5, "subsumed_pct": 80, "top": 7}):
        want = brute_force(docs, **kw)
        assert len(want) > 20 and mined(spark, docs, **kw) == want


def test_hot_prefixes_are_dealt_out(spark, sf, monkeypatch):
    """Prefixes whose stripes lie in segments have the same counts."""
    monkeypatch.setattr(co, "HOT_SHARE", 100)
    docs = texts(200, 2)
    kw = {"min_count": 2, "subsumed_pct": 50, "top": 500}
    assert mined(spark, docs, **kw) == brute_force(docs, **kw)


def test_another_seed_gives_the_same_phrases(spark, sf):
    docs = texts(80, 3)
    assert mined(spark, docs, min_count=2, seed=5) == mined(spark, docs, min_count=2)


def test_words_that_share_an_id_are_noticed(spark, sf):
    """Rows of a shared id carry different checks, which is what the operator looks for."""
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array(["a b a", "a"])], names=["lang", "text"])
    (b, langs), = co._blocks(batch, 0, checked=True)
    assert langs == ["en", "de"] and len(set(b.ids.tolist())) == len(set(b.check.tolist())) == 3  # "a" per language
    df = spark.createDataFrame([("en", "a b a"), ("de", "a")], "lang string, text string")
    rows = co.count_words(df, 0).collect()
    assert {r.lang: r.n for r in rows if r.lang} == {"en": 3, "de": 1}
    assert all(r.lo == r.hi for r in rows)


def test_combined_counts_are_given_out_whole(monkeypatch):
    monkeypatch.setattr(co, "FLUSH", 50)
    rng = np.random.default_rng(1)
    held, want, got = co.Combiner(2), Counter(), Counter()

    def take():
        keys, n = held.take()
        for a, b, c in zip(*map(np.ndarray.tolist, keys), n.tolist(), strict=True):
            got[a, b] += c

    for _ in range(200):
        a, b = rng.integers(0, 12, (2, 9)).astype(np.uint64)
        want.update(zip(a.tolist(), b.tolist(), strict=True))
        if held.add([a, b], np.ones(9, np.int64)):
            take()
    take()
    assert got == want


def test_bitmap_has_what_was_put_in(spark, sf):
    h = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 3000)
    bits = co.Bitmap(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert bits.has(h.view(np.uint64)).all()
    assert bits.has(np.random.default_rng(3).integers(0, 2**63, 10_000).astype(np.uint64)).mean() < 0.01


def test_odd_and_empty_documents(spark, odd, empty):
    assert co.collocations(empty.select("lang", "text")).count() == 0
    assert {tuple(r) for r in co.collocations(odd, min_count=2).collect()} == set(brute_force([(r.lang, r.text) for r in odd.collect()], 2, 50, 2000))

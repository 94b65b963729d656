import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelcraft.llm import language_id as li


def grams_of(texts, order):
    """Counts of the highest-order grams of normalised texts, one character after the other."""
    out = Counter()
    for t in texts:
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        s = [0] * (order - 1) + [ord(c) if c != " " else 0 for c in " ".join(s.split())] + [0]
        out.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    return out


class Plain:
    """Interpolated Kneser-Ney by dictionaries, straight from its definition."""

    def __init__(self, texts, order):
        self.counts = {order: grams_of(texts, order)}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.order, self.followers, self.total, self.d = order, {}, {}, {}
        for n, counts in self.counts.items():
            once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
            self.d[n] = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))
            self.followers[n], self.total[n] = defaultdict(int), defaultdict(int)
            for g, c in counts.items():
                self.followers[n][g[:-1]] += 1
                self.total[n][g[:-1]] += c

    def p(self, g):
        n = len(g)
        if n == 0:
            return li.UNSEEN
        total = self.total[n][g[:-1]]
        if not total:
            return self.p(g[1:])
        own = max(self.counts[n][g] - self.d[n], 0) / total if self.counts[n][g] else 0
        return own + self.d[n] * self.followers[n][g[:-1]] / total * self.p(g[1:])


TEXTS = {"aa": ["the cat, the Hat; that", "a cat that sat"], "bb": ["der hut und der Hund", "über den hund hinaus"], "cc": ["ça va là"]}


def models(order):
    langs = sorted(TEXTS)
    rows = [(i, *g, n) for i, x in enumerate(langs) for g, n in grams_of(TEXTS[x], order).items()]
    m = np.array(rows)
    return li.fit_kneser_ney(langs, m[:, 0], m[:, 1:-1], m[:, -1])


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_probabilities_match_the_definition(order):
    m = models(order)
    plain = [Plain(TEXTS[x], order) for x in m.langs]
    for text in ["the cat", "Hund", "zzz the über", "ça日", "that, that!"]:
        rows, bits, chars = m.cross_entropy([text])
        grams = list(grams_of([text], order).elements())
        assert rows.tolist() == [0] and chars[0] == len(grams)
        for j, own in enumerate(plain):
            want = -sum(math.log2(own.p(g)) for g in grams) / len(grams)
            assert abs(bits[0, j] - want) < 1e-4


def test_probabilities_of_a_context_sum_to_one():
    plain = Plain(TEXTS["bb"], 3)
    letters = {g[-1] for g in plain.counts[3]}
    for context in [(ord("d"), ord("e")), (0, 0), (ord("q"), ord("x"))]:
        total = sum(plain.p((*context, c)) for c in letters)
        unseen = plain.p((*context, 0x3FFF))  # the same for every character that was never seen
        assert abs(total + (1 / li.UNSEEN - len(letters)) * unseen - 1) < 1e-9


def test_symbols():
    s, rows, bounds = li.symbols(["Ab1 c", "--", "", "É!", "नमस्ते"], 3)
    assert rows.tolist() == [0, 3, 4] and bounds.tolist()[:3] == [0, 7, 11]
    assert s[:7].tolist() == [0, 0, ord("a"), ord("b"), 0, ord("c"), 0]
    assert s[7:11].tolist() == [0, 0, ord("é"), 0]
    assert (s[11:] != 0).sum() == len("नमस्ते")  # marks stay with their letters


def test_hashed_arrays_find_their_rows():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    t = li.Hashed(h[::-1].copy(), np.arange(len(h))[::-1, None])
    assert (t.rows[t.find(h), 0] == np.arange(len(h))).all()
    assert (t.find(h - np.uint64(1)) == -1).all()


@pytest.fixture(scope="module")
def told(spark, sf):
    return {r.doc_id: r for r in li.op13_language_id(spark, sf).collect()}


def test_held_out_languages_are_told(spark, sf, told):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(told) == set(lang)
    held = [d for d in told if zlib.crc32(str(d).encode()) % 4 == 2]
    assert held and all(told[d].held_out == (d in set(held)) for d in told)
    right = [told[d].lang_pred == lang[d] for d in held if lang[d] is not None]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.lang_pred in {*lang.values()} for r in told.values())
    assert np.mean([r.accepted for r in told.values()]) > 0.9


def test_held_out_rows_change_nothing(spark, sf, told):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, 'zz', lang) as lang", "text"
    )
    again = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(docs.select("doc_id", "text"), li.train(docs)).collect()}
    assert again == {d: (r.lang_pred, r.score) for d, r in told.items()}


def test_foreign_text_is_not_accepted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    strange = spark.createDataFrame([(1, "zxqj wvkq " * 30)], "doc_id long, text string")
    row = li.identify(strange, li.train(docs)).first()
    assert not row.accepted and row.lang_pred != "und"


def test_sample_is_bounded_whatever_repeats(spark, sf):
    rows = [(4 * i, "aa", f"alpha beta gamma {i}") for i in range(400)] + [(3, "bb", "eine lange Rede " * 4000)]
    rows += [(5, "aa", "the same text again")] * 2000
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    m = li.train(df, sample_chars=1000)
    assert m.langs == ["aa", "bb"]  # the only text of a language is learnt, however long
    assert li.identify(df.select("doc_id", "text"), m).where("lang_pred = 'bb'").count() == 1


def test_odd_documents(spark, odd, empty, sf):
    models = li.train(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = li.identify(odd.select("doc_id", "text"), models).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    for d in (0, 1, 2, 10, 11):
        assert (by[d].lang_pred, by[d].score, by[d].bits, by[d].accepted) == ("und", 0.0, None, False)
    assert by[5].lang_pred in models.langs and by[9].lang_pred in models.langs
    assert li.identify(empty.select("doc_id", "text"), models).count() == 0
    assert li.train(empty) is None and li.train(odd) is not None  # one row of the odd ones has a lang
    assert {r.lang_pred for r in li.identify(odd.select("doc_id", "text"), None).collect()} == {"und"}
    clash = odd.selectExpr("doc_id as row", "text", "lang as draw")
    assert li.identify(clash, models).columns[:2] == ["row", "draw"]

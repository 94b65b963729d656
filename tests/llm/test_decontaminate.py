import hashlib
import re

import pytest

from panelcraft.llm import decontaminate as dc


def brute_force(docs: list[tuple], items: list[tuple], n: int = dc.N) -> list[tuple]:
    """The contract read literally, for tests: (doc_id, n_words, n_hit, n_items, sha256)."""
    def words(t):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(str(i) if i is not None else "null")
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in wins:
                    hit.update(range(s, s + k))
                    got |= wins[tuple(w[s : s + k])]
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()))
    return out


def as_rows(df):
    found = df.collect()
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found)


def test_query_matches_brute_force(spark, sf, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert as_rows(dc.op3_decontaminate(spark, sf)) == sorted(brute_force(documents, items))


ITEMS = [(1, "a b c d e f g h i j k"), (2, "one two"), (3, None), (4, ""), (None, "ß é"), (2, "one two"), (5, "c d e f g h i j k l")]


@pytest.mark.parametrize("block_windows", [1000, 2])
def test_short_null_and_repeated_items_in_blocks(spark, odd, block_windows):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = dc.find_benchmark(odd, bench, "scan", block_windows=block_windows).select("doc_id", "text", "scan.*").collect()
    expected = brute_force([(r.doc_id, r.text) for r in odd.collect()], ITEMS)
    got = [(r.doc_id, r.n_words, sum(h.stop - h.start for h in r.hits), len(r["items"])) for r in found]
    assert sorted(got, key=str) == sorted((e[:4] for e in expected), key=str)


def test_documents_and_spans_are_removed(spark, odd, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = dc.remove_documents(odd, bench)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.select("doc_id").collect()) == [-1, 0, 1, 2, 7, 8, 9, 10, 11, 12]
    cut = {r.doc_id: r.text for r in dc.remove_spans(odd, bench).where("doc_id in (0, 4, 5, 7)").collect()}
    assert cut == {0: None, 4: " three", 5: "", 7: "日本語 текст ß É 😀 😀"}
    clash = odd.withColumnsRenamed({"lang": "benchmark_scan"})
    assert dc.remove_documents(clash, bench).columns == clash.columns
    assert dc.remove_documents(empty, bench).count() == 0
    assert dc.remove_documents(odd, bench.limit(0)).count() == odd.count()


def test_a_window_of_very_many_items_is_broadcast_once(spark, sf, monkeypatch):
    """A line that many items share is one window on the driver; the items meet it in a join."""
    bench = spark.range(5000).selectExpr("id as item_id", "'shared line of the prompts' as text")
    sent = []
    scan = dc.scan
    monkeypatch.setattr(dc, "scan", lambda docs, windows, *a: sent.append(windows.count()) or scan(docs, windows, *a))
    docs = spark.createDataFrame([(1, "here a shared line of the prompts stands"), (2, "nothing")], "doc_id long, text string")
    got = {r.doc_id: (len(r["items"]), r.hits) for r in dc.find_benchmark(docs, bench, "scan").select("doc_id", "scan.*").collect()}
    assert sent == [1] and got[1][0] == 5000 and got[2] == (0, [])
    clash = docs.selectExpr("doc_id", "text", "1 as row", "2 as kept", "3 as hash")
    assert dc.find_benchmark(clash, bench, "scan").drop("scan").columns == clash.columns

from panelcraft.llm import licenses as li

from .test_words import plain_words


def base_places(text):
    w = plain_words(text)
    return w, [(i, label) for p, label in li.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]


def check(rows, docs):
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d, t in docs:
        w, places = base_places(t)
        at = [i for i, _ in places]
        expected = (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert expected in [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in by[d]]
        for r in by[d]:
            assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert len(rows) == len(docs)


def test_query_matches_brute_force(spark, sf, documents):
    check(li.op8_licenses(spark, sf).collect(), documents)


def scan(spark, texts, tmp):
    path = f"{tmp}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    return sorted(li.op8_licenses(spark, tmp).collect(), key=lambda r: r.doc_id)


def test_notices_with_changed_words_and_repeats(spark, sf, scratch):
    mit = next(t for n, t in li.TEMPLATES if t.startswith("Permission"))
    words = mit.split()
    texts = [
        f"before {mit} after",
        " ".join([*words[:9], "really", *words[9:]]),  # a word more: two neighbouring diagonals
        " ".join(words[: len(words) // 2]),  # half a notice is not enough
        "CC-BY cc by, cc by! all rights reserved all rights reserved",
        "all rights are reserved general public general license",
        None,
        "",
        "ALL RIGHTS\n\nRESERVED",
        "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.",
    ]
    rows = scan(spark, texts, scratch)
    check(rows, list(enumerate(texts)))
    assert [r.labels for r in rows[:3]] == ["mit", "mit", ""] and rows[0].score == 1 and rows[1].score > 0.8
    assert (rows[3].n_base, rows[3].first_word, rows[3].last_word) == (5, 0, 9) and rows[3].labels == "cc-by,reserved"
    assert rows[4].n_base == 0 and rows[5].n_words == rows[6].n_words == 0 and rows[7].base_labels == "reserved"
    assert rows[8].labels == "cc-by,cc-by-nc-4.0" and rows[8].n_base == 2


def test_odd_documents(spark, odd, empty, scratch):
    odd.write.parquet(f"{scratch}/documents.parquet")
    check(li.op8_licenses(spark, scratch).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert li.scan_spans(empty).count() == 0
    assert li.scan_spans(odd, templates=[], base={"two three": "x"}).where("label = 'x'").count() == 3


def longest_rise(points):
    """Length of the longest subset that rises in both numbers, by trying all beginnings."""
    return max((1 + longest_rise([b for b in points if b[0] > a[0] and b[1] > a[1]]) for a in points), default=0)


def covers(template, text):
    """The best share of a template's word pairs in any span of the text whose drift is bounded."""
    t, w = plain_words(template), plain_words(text)
    pairs = list(zip(t, t[1:]))
    hits = [(p, d) for p, x in enumerate(pairs) for d in range(len(w) - 1) if (w[d], w[d + 1]) == x]
    low = sorted({d - p for p, d in hits})
    return max((longest_rise([(p, d) for p, d in hits if 0 <= d - p - x <= li.DRIFT]) / len(pairs) for x in low), default=0)


def test_spans_match_brute_force(spark, sf, scratch):
    """Repeated, dropped, added and swapped words: labels and scores as over all spans."""
    import random

    rnd = random.Random(3)
    texts = [
        "MIT License MIT License MIT License",  # the same pair again and again is no notice
        "the MIT the MIT the MIT License",
        "released released under under the the MIT MIT License License",
        "Released under the very MIT License",
        "License MIT the under Released",
    ]
    notices = [t for _, t in li.TEMPLATES if len(t.split()) <= 10]
    for i in range(120):
        words = rnd.choice(notices).split()
        for _ in range(i % 4):
            at = rnd.randrange(len(words))
            words[at : at + 1] = rnd.choice([[], [words[at], "extra"], [words[at]] * 2, [rnd.choice(words)]])
        texts.append(" ".join(["some", "words", *words, *rnd.choice(notices).split()[: i % 5], "end"]))
    rows = scan(spark, texts, scratch)
    for r, text in zip(rows, texts, strict=True):
        best = {}
        for label, t in li.TEMPLATES:
            best[label] = max(best.get(label, 0), covers(t, text))
        labels = {x for x, c in best.items() if c >= li.COVERAGE}
        assert set(r.labels.split(",")) - set(r.base_labels.split(",")) - {""} == labels, text
        if not r.base_labels:
            assert abs(r.score - max((c for c in best.values() if c >= li.COVERAGE), default=0)) < 1e-9, text
    assert [r.labels for r in rows[:2]] == ["", ""] and rows[3].labels == "mit"


def test_spans_start_in_the_text_and_repeat(spark):
    mit = "Released under the MIT License"
    df = spark.createDataFrame([(1, f"{mit}. {mit}. x {mit}")], "doc_id long, text string")
    spans = sorted((r.start, r.cover) for r in li.scan_spans(df).where("label = 'mit'").collect())
    assert spans == [(0, 1.0), (5, 1.0), (11, 1.0)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "cc by", "a", 2, 3)], "doc_id long, text string, label string, row long, n_words long")
    assert {r.label for r in li.scan_spans(df).collect()} == {None, "cc-by"}

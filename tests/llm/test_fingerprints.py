import hashlib

import numpy as np

from panelcraft.llm import fingerprints as fp


def expected_rows(docs):
    docs = sorted(((d, t or "") for d, t in docs), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]))
    out = []
    for i, (d, t) in enumerate(docs):
        n = docs[(i + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        a, b, c = fp.chunks(t), fp.chunks(edited), fp.chunks(n)
        row = (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.written(a), fp.written(b))
        out.append((*row, fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


def test_query_matches_neighbours_in_order(spark, sf, documents):
    assert sorted(map(tuple, fp.op6_fingerprints(spark, sf).collect()), key=str) == expected_rows(documents)


def test_odd_documents_and_ranges(odd, empty, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for docs, ranges in ((odd.repartition(4), 3), (odd, 4096), (odd.limit(1), 10)):
        schema = fp_schema()
        real = fp.ranged
        fp.ranged = lambda d, ranges=ranges: real(d, ranges)
        try:
            got = sorted(map(tuple, fp.with_next(docs, fp._prepare, fp._finish, schema).collect()), key=str)
        finally:
            fp.ranged = real
        assert got == expected_rows(rows if docs.count() > 1 else rows[:1])
    assert fp.fingerprint(empty).count() == 0
    assert fp.with_next(empty, fp._prepare, fp._finish, fp_schema()).count() == 0


def fp_schema():
    return "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def test_chunks_resist_shifts(documents):
    text = max((t for _, t in documents if t), key=len)
    a = fp.chunks(text)
    assert fp.likeness(a, fp.chunks("A few words more. " + text)) > 0.9
    middle = len(text) // 2
    assert fp.likeness(a, fp.chunks(text[:middle] + " inserted words " + text[middle:])) > 0.9
    half = fp.chunks(text[:middle])
    assert fp.likeness(half, a) > 0.9 and 0.4 < fp.likeness(a, half) < 0.6  # containment


def test_cut_points_cover_and_bound():
    rng = np.random.default_rng(0)
    for n in (0, 1, 15, 16, 17, 255, 256, 257, 5000):
        for data in (rng.integers(0, 256, n).astype(np.uint8), np.zeros(n, np.uint8)):
            ends = fp.cut_points(data)
            sizes = np.diff([0, *ends])
            assert (ends[-1] if ends else 0) == n and (sizes <= fp.LARGEST).all() and (sizes[:-1] >= fp.LEAST).all()
    assert fp.likeness({}, {}) == 1 and fp.likeness({}, {"a": (1, 1)}) == 0 and fp.likeness({"a": (1, 1)}, {}) == 0


def plain_chunks(raw):
    """Normalised chunking byte by byte, from the definition: the hash of a place is the sum of the
    table values of the last 32 bytes, each shifted left by its distance, in 32 bits."""
    mixed = lambda x: int(fp.mix(np.array([x], np.uint64))[0])
    gear = [mixed((b + 1) * 0x9E3779B97F4A7C15 % 2**64) >> 32 for b in range(256)]
    out, start = [], 0
    while start < len(raw):
        end = None
        for at in range(start + fp.LEAST, min(start + fp.LARGEST, len(raw)) + 1):
            h = 0
            for back in range(min(32, at)):
                h = (h + (gear[raw[at - 1 - back]] << back)) % 2**32
            bits = fp.STRICT_BITS if at - start <= fp.NORMAL else fp.LOOSE_BITS
            if h >> (32 - bits) == 0:
                end = at
                break
        end = end or min(start + fp.LARGEST, len(raw))
        out.append(raw[start:end])
        start = end
    return out


def test_boundaries_match_the_plain_gear_hash(documents):
    texts = ["", "short", "a" * 700, "é" * 400] + [t for _, t in documents if t and len(t) < 6000][:25]
    for t in texts:
        raw = t.encode()
        ends = fp.cut_points(np.frombuffer(raw, np.uint8))
        plain = plain_chunks(raw)
        assert [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)] == plain
        sizes = {}
        for c in plain:
            sizes.setdefault(c, []).append(len(c))
        assert sorted((n, c) for n, c in fp.chunks(t).values()) == sorted((len(c), len(n)) for c, n in sizes.items())


def test_string_ids_and_a_hot_id(spark, sf):
    """Ids of any ordered type; an id with most rows is cut into ranges by its texts."""
    rows = [(f"id{i:04d}", f"text {i} " * 5) for i in range(300)] + [("id0100", f"{i * 7919 % 1000:03d} of the hot id") for i in range(900)]
    df = spark.createDataFrame([*rows, (None, "no id"), (None, None), ("", "empty id")], "doc_id string, text string").repartition(5)
    buckets = {r.bucket: r["count"] for r in fp.ranged(df, 16).where("NOT guest").groupBy("bucket").count().collect()}
    assert len(buckets) > 8 and max(buckets.values()) < 300
    real, fp_ranged = fp.ranged, lambda d: real(d, 16)
    fp.ranged = fp_ranged
    try:
        schema = fp_schema().replace("doc_id long", "doc_id string")
        got = sorted(map(tuple, fp.with_next(df, fp._prepare, fp._finish, schema).collect()), key=str)
    finally:
        fp.ranged = real
    docs = sorted(((d, t or "") for d, t in [*rows, (None, "no id"), (None, None), ("", "empty id")]), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    want = []
    for i, (d, t) in enumerate(docs):
        edited = fp.edited_text(t, docs[(i + 1) % len(docs)][1])
        a, b, c = fp.chunks(t), fp.chunks(edited), fp.chunks(docs[(i + 1) % len(docs)][1])
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.written(a), fp.written(b), fp.likeness(a, b), fp.likeness(a, c)))
    assert got == sorted(want, key=str)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, True, "x")], "doc_id long, text string, bucket int, guest boolean, begins string")
    assert fp.with_next(df, fp._prepare, fp._finish, fp_schema()).count() == 1

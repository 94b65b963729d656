import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcraft.llm import packing as pk


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(pk.default_tokenizer())


def check_pieces(rows, docs, exact):
    """Every id of every document lies in exactly one piece, sequences are gapless and unpadded."""
    left = [list(exact.encode(t or "", add_special_tokens=False).ids) + [0] for _, t in docs]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d in by_doc:
        got = sorted(by_doc[d], key=lambda r: r.start)
        ids = [np.frombuffer(r.ids, "<u4").tolist() for r in got]
        expected = sorted(x for (i, _), x in zip(docs, left, strict=True) if i == d)
        assert sorted(x for p in ids for x in p) == sorted(x for e in expected for x in e)
        if len(expected) == 1:
            assert [x for p in ids for x in p] == expected[0] and {r.doc_tokens for r in got} == {len(expected[0])}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        size = 0
        for r in pieces:
            assert r.offset == size and r.length == len(r.ids) // 4 > 0
            size += r.length
        assert size <= 1024 and size & (size - 1) == 0  # full, or a power of two
    assert set(by_doc) == {d for d, _ in docs}


def test_pack_documents(spark, sf, documents, exact):
    rows = pk.pack(spark.read.parquet(f"{sf}/documents.parquet").repartition(6)).collect()
    check_pieces(rows, documents, exact)
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in pk.op2_pack(spark, sf).collect()}
    ids = {d: np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in documents}
    at = {}
    for d, start in sorted(digests):
        at.setdefault(d, []).append(start)
    for d, starts in at.items():
        for a, b in zip(starts, [*starts[1:], len(ids[d])], strict=True):
            assert digests[d, a] == zlib.crc32(ids[d][a:b].tobytes())


def test_odd_documents(odd, empty, exact):
    rows = pk.pack(odd).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in odd.collect()], exact)
    assert pk.pack(empty).count() == 0
    assert pk.pack(odd.select(F.col("doc_id").alias("n"), F.col("text").alias("ids")), "n", "ids").count() == len(rows)


def test_leftovers_of_many_partitions_are_merged_in_rounds(spark, sf, exact):
    docs = [(i, "ab " * (i % 50)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    check_pieces(pk.pack(df, open_windows=2).collect(), docs, exact)


def test_fast_ids_equal_the_tokenizer_over_all_characters(exact):
    encode = pk.load_encoder(pk.default_tokenizer())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 97 == 0)]
    for i in range(0, len(chars), 50):
        text = " ".join(f"a{c}1 {c}.{c}" for c in chars[i : i + 50])
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    special = "x<|endoftext|>y"
    assert encode(special).tolist() == exact.encode(special, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 4))
def test_packer_fills_every_sequence(sizes, open_windows):
    out = []
    packer = pk.Packer(16, open_windows, out.append)
    for i, n in enumerate(sizes):
        packer.add(pk._Piece(i, 0, np.arange(n), n))
        assert len(packer.windows) <= open_windows
    assert all(sum(len(p.ids) for p in s) == 16 for s in out)
    packer.flush()
    assert sum(len(p.ids) for s in out for p in s) == sum(sizes)

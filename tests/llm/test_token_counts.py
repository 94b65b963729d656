import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from panelcraft.llm import token_counts as tc


@pytest.fixture(scope="module", params=[True, False], ids=["bytes", "unknown"])
def pair(request):
    """(our counter, the library's tokenizer) with and without byte pieces."""
    pieces, unknown = tc.unigram_pieces(tc.default_vocabulary())
    if not request.param:
        pieces = [p for p in pieces if not p[0].startswith("<0x")]
    exact = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=request.param))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tc.MARK, prepend_scheme="always", split=True)
    return tc.Counter(pieces, unknown), exact


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("theandofr XÉ日☃😀\n\t▁1.<0x0A>"), max_size=60))
def test_counts_equal_the_library(pair, text):
    counter, exact = pair
    assert counter.text(text) == len(exact.encode(text, add_special_tokens=False).ids)


def test_counts_of_documents(pair, documents):
    counter, exact = pair
    for _, t in documents:
        assert counter.text(t or "") == len(exact.encode(t or "", add_special_tokens=False).ids)


def test_ties_take_the_longest_piece_first():
    pieces = [("<unk>", -9.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)]
    exact = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tc.MARK, prepend_scheme="always", split=True)
    counter = tc.Counter(pieces, 0)
    for text in ("ab", "abab", "aab", "b", "c", "acb ccc"):
        assert counter.text(text) == len(exact.encode(text).ids)


def test_query_and_odd_documents(spark, sf, documents, odd, empty, monkeypatch):
    counter = tc.load_counter(tc.default_vocabulary())
    expected = sorted((d, len(t or ""), counter.text(t or "")) for d, t in documents)
    assert sorted(map(tuple, tc.op7_token_counts(spark, sf).collect())) == expected
    rows = {r.doc_id: r.n_tokens for r in tc.count_tokens(odd).collect()}
    assert rows[0] == rows[1] == 0 and rows[3] == counter.text("one two three")
    assert tc.count_tokens(empty).count() == 0
    monkeypatch.setattr(tc, "REMEMBERED", 3)  # a small memory changes nothing
    fresh = tc.Counter(*tc.unigram_pieces(tc.default_vocabulary()))
    assert [fresh.text(t or "") for _, t in documents[:20]] == [counter.text(t or "") for _, t in documents[:20]]

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcraft.llm.words import word_blocks, words_hash


def plain_words(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aBé9 _-\n日"), max_size=25)), max_size=12), st.integers(1, 40))
def test_words_and_grams_match_a_regular_expression(texts, block_bytes):
    got, grams = [], []
    for b in word_blocks(pa.array(texts, pa.string()), block_bytes):
        for r in range(b.rows):
            got.append([b.word(i).decode() for i in range(b.bounds[r], b.bounds[r + 1])])
        start, h = b.grams(2)
        grams += [(b.words(i, i + 2).decode(), int(x)) for i, x in zip(start, h, strict=True)]
    expected = [plain_words(t) for t in texts]
    assert got == expected
    assert [g for g, _ in grams] == [" ".join(w[i : i + 2]) for w in expected for i in range(len(w) - 1)]
    assert all(words_hash(g.encode()) == h for g, h in grams)

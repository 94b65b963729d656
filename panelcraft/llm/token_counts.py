"""Token counts of a unigram tokenizer by count-only Viterbi.

Method: an Aho-Corasick automaton over the vocabulary enumerates every piece that ends at each
character of a word; dynamic programming over the characters carries the best score and the
number of pieces of the best segmentation, never the pieces.  Ties follow the exact rules of
the ``tokenizers`` library's Unigram model: candidates of an end are tried from the longest
piece (earliest start) down and replace the best only if strictly better; a character that no
one-character piece covers also offers an unknown step at the least score minus 10, and
neighbouring unknown characters fuse into one token, or one per byte where the vocabulary has
all byte pieces.

The vocabulary is that of a public ``sentencepiece`` file (``piece_bpe_32k.model``).  Its BPE
file stores merge ranks as scores, so the unigram log score of a piece is given by the rule
``-ln(rank + 2)``; control pieces are left out.  Blanks become the mark U+2581, which starts
every word (one is put before a text without it), and words are segmented by themselves.

Scale: one pass over the texts, no shuffle.  A task remembers the counts of words it has seen,
up to ``REMEMBERED`` of them, then starts anew; memory follows that bound and the longest word.

Defined cases: a null or empty text has no tokens; repeated rows are counted row by row; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import id_text, table

MARK, UNKNOWN_PENALTY, REMEMBERED = "▁", 10.0, 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def unigram_pieces(path: str) -> tuple[list[tuple[str, float]], int]:
    """([(piece, log score)], index of the unknown piece) of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(sp.id_to_piece(i), -math.log(i + 2)) for i in range(sp.get_piece_size()) if not sp.is_control(i)]
    unknown = sp.id_to_piece(sp.unk_id())
    return pieces, next(i for i, (p, _) in enumerate(pieces) if p == unknown)


class Counter:
    """Piece counts of words under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown_score = min(score for _, score in pieces) - UNKNOWN_PENALTY
        named = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in named for b in range(256))
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces in the best segmentation of one word."""
        n = len(word)
        low = -math.inf
        best, count, unk = [low] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        ends: list[list] = [[] for _ in range(n)]
        single = [False] * n
        for end, (length, score) in self.automaton.iter(word):
            ends[end].append((length, score))
            if length == 1:
                single[end] = True
        for end in range(n):
            top, at, is_unk = low, -1, False
            for length, score in ends[end]:  # longest first
                s = best[end + 1 - length] + score
                if s > top:
                    top, at, is_unk = s, end + 1 - length, False
            if not single[end]:
                s = best[end] + self.unknown_score
                if s > top:
                    top, at, is_unk = s, end, True
            best[end + 1], unk[end + 1] = top, is_unk
            if not is_unk:
                count[end + 1] = count[at] + 1
            elif self.bytes:
                count[end + 1] = count[at] + len(word[end].encode())
            else:
                count[end + 1] = count[at] + (0 if unk[at] else 1)
        return count[n]

    def text(self, text: str) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:  # the text starts with a blank: nothing is put before it
            del words[0]
        known, total = self.known, 0
        for w in words:
            c = known.get(w)
            if c is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                c = known[w] = self.word(MARK + w)
            total += c
        return total


@lru_cache(maxsize=2)
def load_counter(path: str) -> Counter:
    return Counter(*unigram_pieces(path))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_chars and n_tokens of every text."""
    path = vocabulary or default_vocabulary()
    picked = id_text(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load_counter(path)
        for batch in batches:
            counts = np.fromiter((counter.text(t.as_py()) for t in batch.column("text")), np.int64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chars"), pa.array(counts)], names=["doc_id", "n_chars", "n_tokens"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_chars long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: characters and unigram tokens."""
    return count_tokens(table(spark, sf_dir, "documents"))

"""Phrase collocations of two and three words by the stripes pattern.

Method: every prefix (none, one word, two words) keys a stripe, an associative counter of the
words that follow it.  Tasks combine their stripes before the shuffle, the shuffle brings the
stripes of a prefix together, and they are merged element by element.  Extensions (the entries),
prefix totals (the prefix's own entry in the stripe of the shorter prefix) and the counts that
subsume a phrase (the greatest entries) all come from these stripes.

Only prefixes that can matter have stripes: a phrase is as rare as its rarest part at least, so
a first pass counts words, and a word, then a pair of words, below ``min_count`` opens no stripe.
Which ones are frequent reaches the tasks as a bitmap of a fixed size; where two share a bit, a
stripe too many is counted and dropped after the merge, so results do not depend on it.

Exactness: words are 64-bit ids per language; the first pass also carries a second hash of every
word, and if two words ever share an id, all is done again with another seed.  Scores are
computed in decimals of 38 digits.

Scale: four passes over the texts (words, pairs, triples, and the spelling of the words that the
first phrases need), none of which shuffles them; a prefix with a thousandth of
all words or more (at most a thousand of them) has its stripe dealt over ``SEGMENTS`` tasks by the
next word; the ranking is numbered across tasks.  Nothing but the bitmaps and the at most 1000 hot
prefixes reaches the driver.

Defined cases: a null text is empty and has no words; a null lang counts as ``und``, as a lang of
that name does; repeated rows count as often as they stand there; a very long text is read whole,
in one block; ties are settled by phrase, so ranks have no gaps; extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_within
from .tables import Scratch, table
from .words import BLOCK_BYTES, U, _powers, mix, signed, text_bytes

MIN_COUNT, SUBSUMED_PCT, TOP = 10, 50, 2000
BITMAP_BITS, HOT_SHARE, SEGMENTS, FLUSH = 27, 1000, 64, 1_000_000
NONE = 0  # no word: the second word of a one-word prefix
PAIR = U(0xA24BAED4963EE407)
LANG = U(0xFFFFFFFF)


def _kinds() -> np.ndarray:
    """0: byte of a word, 1: blank, 2: end of a piece."""
    kinds = np.zeros(256, np.uint8)
    kinds[[0x20, 0x09]] = 1
    kinds[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    return kinds


KINDS = _kinds()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Spelled:
    """The words of a block of texts, in order."""

    low: np.ndarray  # lower-cased bytes
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray  # the block's row of every word
    ids: np.ndarray  # uint64, per language
    check: np.ndarray  # second hash and the language's code, empty unless asked for
    joined: np.ndarray  # whether the next word stands in the same piece

    def texts(self, at: np.ndarray) -> pa.Array:
        """The words with these numbers as strings."""
        size = self.ends[at] - self.starts[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = self.low[np.arange(offsets[-1]) + np.repeat(self.starts[at] - offsets[:-1], size)]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes()))


def _bytes_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def _hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    up, down = _powers(len(low) + 1)
    total = np.zeros(len(low) + 1, U)
    np.cumsum(_bytes_table(seed)[low] * up[: len(low)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def lang_seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def spell(raw: np.ndarray, offsets: np.ndarray, langs: np.ndarray, seed: int, checked: bool = False) -> Spelled:
    """The words of rows of bytes; ``langs`` has the hash of every row's language."""
    kind, low = KINDS[raw], LOWER[raw]
    n = len(raw)
    inside = kind == 0
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    starts = np.flatnonzero(inside & (before | cut[:n]))
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    ids = mix(_hashes(low, starts, ends, 2 * seed) + langs[row])
    ids[ids == NONE] = U(1)
    check = np.zeros(0, U)
    if checked:  # half a second hash, half the language
        check = (_hashes(low, starts, ends, 2 * seed + 1) & ~LANG) | (langs[row] & LANG)
    piece = np.cumsum(kind == 2, dtype=np.int64)[starts] if n else np.zeros(0, np.int64)
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    return Spelled(low, starts, ends, row, ids, check, joined)


def _blocks(batch: pa.RecordBatch, seed: int, checked: bool = False) -> Iterator[tuple[Spelled, list[str]]]:
    """(words, language of every row) of the rows (lang, text) of a batch, about 1 MB at a time."""
    data, offsets = text_bytes(batch.column(1))
    langs = batch.column(0).fill_null("und").dictionary_encode()
    names = langs.dictionary.to_pylist()
    code = langs.indices.to_numpy()
    seeds = np.array([lang_seed(x) for x in names], U)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1))
        part = code[i:j]
        yield spell(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], seeds[part], seed, checked), [names[c] for c in part]
        i = j


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first places of the runs of equal keys in it)."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order, first = _runs(*keys)
    if not len(order):
        return keys, counts
    return [k[order[first]] for k in keys], np.add.reduceat(counts[order], first)


class Combiner:
    """Counts by several 64-bit keys, summed as they gather; gives them out when they are many."""

    def __init__(self, width: int) -> None:
        self.width, self.parts, self.size = width, [], 0

    def add(self, keys: list[np.ndarray], counts: np.ndarray) -> bool:
        self.parts.append((*keys, counts))
        self.size += len(counts)
        if self.size >= FLUSH:
            keys, counts = self.take()
            self.parts, self.size = [(*keys, counts)], len(counts)
        return self.size >= FLUSH // 2

    def take(self) -> tuple[list[np.ndarray], np.ndarray]:
        parts, self.parts, self.size = self.parts, [], 0
        if not parts:
            return [np.zeros(0, U)] * self.width, np.zeros(0, np.int64)
        *keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _summed(keys, counts)


def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.int64)


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """(id, n, lo, hi) of every word of every language; lo < hi where an id is not of one word.
    Rows with a ``lang`` hold all words of that language, and its code, instead of an id's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = Combiner(2), Counter()
        names = ["lang", "id", "check", "n"]

        def out() -> pa.RecordBatch:
            (ids, check), n = held.take()
            return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.string()), pa.array(signed(ids)), pa.array(signed(check)), pa.array(n)], names=names)

        for batch in batches:
            for b, langs in _blocks(batch, seed, checked=True):
                for lang, n in zip(langs, np.bincount(b.row, minlength=len(langs)).tolist(), strict=True):
                    sizes[lang] += n
                keys, n = _summed([b.ids, b.check], _ones(len(b.ids)))
                if held.add(keys, n):
                    yield out()
        yield out()
        none = pa.array([0] * len(sizes), pa.int64())
        codes = pa.array([lang_seed(x) & int(LANG) for x in sizes], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.string()), none, codes, pa.array(list(sizes.values()), pa.int64())], names=names)

    counted = docs.mapInArrow(run, "lang string, id long, check long, n long")
    return counted.groupBy("lang", "id").agg(F.sum("n").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITMAP_BITS)).astype(np.int64)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * PAIR + b)


class Bitmap:
    """A set of 64-bit hashes by their leading bits: 16 MB, whatever it holds."""

    def __init__(self, hashes: DataFrame) -> None:
        """From a column ``h``; what reaches the driver is the non-zero words of the bitmap."""
        slot = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
        words = hashes.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits"))
        got = words.toArrow()
        self.words = np.zeros(1 << (BITMAP_BITS - 6), U)
        self.words[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(U)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = _slot(h)
        return (self.words[at >> 6] >> (at & 63).astype(U)) & U(1) != 0


def _segments(hot: np.ndarray, prefix: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which part of its prefix's stripe an entry belongs to: 0 unless the prefix is hot."""
    if not len(hot):
        return np.zeros(len(prefix), np.int64)
    at = np.minimum(np.searchsorted(hot, prefix), len(hot) - 1)
    return np.where(hot[at] == prefix, 1 + (following & U(SEGMENTS - 1)).astype(np.int64), 0)


STRIPE = "p1 long, p2 long, seg int, entries array<long>"


def _stripes(keys: list[np.ndarray], counts: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Entries (prefix words ..., next word) as rows of stripes: next word, count, next word ..."""
    *prefix, following = keys
    seg = _segments(hot, prefix[0] if len(prefix) == 1 else pair_hash(*prefix), following)
    order, first = _runs(*prefix, seg.astype(U))
    entries = np.column_stack([signed(following)[order], counts[order]]).reshape(-1)
    lists = pa.ListArray.from_arrays(pa.array(2 * np.append(first, len(order)), pa.int32()), pa.array(entries))
    words = [pa.array(signed(p[order[first]])) for p in prefix]
    words += [pa.array(np.full(len(first), NONE, np.int64))] * (2 - len(prefix))
    return pa.RecordBatch.from_arrays([*words, pa.array(seg[order[first]], pa.int32()), lists], names=["p1", "p2", "seg", "entries"])


def stripes(docs: DataFrame, seed: int, frequent, hot: np.ndarray, width: int) -> DataFrame:
    """Stripes of prefixes of ``width`` words (1 or 2), each task's own.  ``frequent`` has the words
    (or the pairs) that a prefix and what extends it must consist of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = frequent.value, Combiner(width + 1)
        for batch in batches:
            for b, _ in _blocks(batch, seed):
                if width == 1:
                    use = known.has(b.ids)
                    at = np.flatnonzero(b.joined[:-1] & use[:-1] & use[1:])
                else:
                    use = np.zeros(len(b.ids), bool)  # words i, i + 1 are a frequent pair
                    pair = np.flatnonzero(b.joined)
                    use[pair] = known.has(pair_hash(b.ids[pair], b.ids[pair + 1]))
                    at = np.flatnonzero(use[:-1] & use[1:])
                if held.add(*_summed([b.ids[at + i] for i in range(width + 1)], _ones(len(at)))):
                    yield _stripes(*held.take(), hot)
        yield _stripes(*held.take(), hot)

    return docs.mapInArrow(run, STRIPE)


def spellings(docs: DataFrame, seed: int, wanted) -> DataFrame:
    """(id, word) of the wanted ids, and of some others that share a bit with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for batch in batches:
            for b, _ in _blocks(batch, seed):
                at = np.flatnonzero(known.has(b.ids))
                ids, first = np.unique(b.ids[at], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(ids)), b.texts(at[first]).cast(pa.string())], names=["id", "word"])

    return docs.mapInArrow(run, "id long, word string").groupBy("id").agg(F.min("word").alias("word"))


def merge_stripes(stripes: DataFrame, min_count: int) -> DataFrame:
    """The stripes (or segments of hot ones) of every prefix merged element by element; rows
    (p1, p2, next, a) of the entries that reach ``min_count``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # merged so far of the last prefix, which the next batch may go on with
        for batch in batches:
            head = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            sizes = np.diff(batch.column(3).offsets.to_numpy()) // 2
            following, n = batch.column(3).flatten().to_numpy().reshape(-1, 2).T
            if left is not None:
                head = [np.concatenate(x) for x in zip(left[0], head, strict=True)]
                sizes = np.concatenate([[len(left[1])], sizes])
                following, n = np.concatenate([left[1], following]), np.concatenate([left[2], n])
            if not len(sizes):
                continue
            new = np.ones(len(sizes), bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in head])
            first = np.flatnonzero(new)
            group = np.repeat(np.cumsum(new) - 1, sizes)
            (group, following), n = _summed([group.astype(U), following.view(U)], n)
            group, following = group.astype(np.int64), following.view(np.int64)
            cut = int(np.searchsorted(group, len(first) - 1))
            yield _entries([x[first] for x in head], group[:cut], following[:cut], n[:cut], min_count)
            left = ([x[first[-1:]] for x in head], following[cut:], n[cut:])
        if left is not None:
            yield _entries(left[0], np.zeros(len(left[1]), np.int64), left[1], left[2], min_count)

    dealt = stripes.repartition("p1", "p2", "seg").sortWithinPartitions("p1", "p2", "seg")
    return dealt.mapInArrow(run, "p1 long, p2 long, next long, a long")


def _entries(head: list, group: np.ndarray, following: np.ndarray, n: np.ndarray, min_count: int) -> pa.RecordBatch:
    keep = np.flatnonzero(n >= min_count)
    cols = [head[0][group[keep]], head[1][group[keep]], following[keep], n[keep]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["p1", "p2", "next", "a"])


def _score(a, left, right):
    exact = lambda c: F.col(c).cast("decimal(19,0)").cast("decimal(38,0)")
    return F.call_function("div", exact(a) * exact(a) * F.lit(1_000_000).cast("decimal(7,0)"), exact(left) * exact(right)).cast("long")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, subsumed_pct: int = SUBSUMED_PCT, top: int = TOP, seed: int = 0) -> DataFrame:
    """The ``top`` phrases of every language of documents (lang, text): lang, rank, phrase, a, l,
    r, n, score (see the module's docstring; ``a`` is the phrase's count, ``l`` and ``r`` those of
    the parts of its lowest-scoring cut, ``n`` all words of the language)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    store = Scratch(spark, "collocations")
    while True:
        counted = store.keep(count_words(docs, seed))
        words, sizes = counted.where("lang IS NULL"), counted.where("lang IS NOT NULL").select("lang", F.col("lo").alias("code"), "n")
        seen = words.agg(F.sum("n").alias("n"), F.max((F.col("lo") != F.col("hi")).cast("int")).alias("clash")).first()
        if not seen.clash and not sizes.groupBy("code").count().where("count > 1").limit(1).count():
            break
        seed += 1
    words = words.where(F.col("n") >= min_count)
    hot_from = max(min_count, (seen.n or 0) // HOT_SHARE + 1)
    unsigned = lambda rows: np.sort(np.array(rows, np.int64).view(U))
    send = lambda ids: spark.sparkContext.broadcast(Bitmap(ids))

    # the entries of one-word stripes are the frequent pairs, those of two-word ones the triples
    hot = unsigned([r.id for r in words.where(F.col("n") >= hot_from).select("id").collect()])
    singles = stripes(docs, seed, send(words.select(F.col("id").alias("h"))), hot, 1)
    pairs = store.keep(merge_stripes(singles, min_count).select(F.col("p1").alias("w1"), F.col("next").alias("w2"), "a"))
    hashed = pairs.mapInArrow(_hash_pairs, "h long, a long")
    hot = unsigned([r.h for r in hashed.where(F.col("a") >= hot_from).collect()])
    doubles = merge_stripes(stripes(docs, seed, send(hashed), hot, 2), min_count)
    triples = store.keep(doubles.select(F.col("p1").alias("w1"), F.col("p2").alias("w2"), F.col("next").alias("w3"), "a"))

    word = lambda n, *cols: words.select(F.col("id").alias(f"w{n}"), F.col("n").alias(f"f{n}"), *cols)
    code = F.col("lo").bitwiseAND(F.lit(int(LANG))).alias("code")
    # a pair is dropped for a triple that begins or ends with it
    begun = triples.groupBy("w1", "w2").agg(F.max("a").alias("after"))
    ended = triples.groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("before"))
    pair = pairs.join(begun, ["w1", "w2"], "left").join(ended, ["w1", "w2"], "left")
    longest = F.greatest(F.coalesce("after", F.lit(0)), F.coalesce("before", F.lit(0)))
    pair = pair.where(~((longest >= min_count) & (longest * 100 >= F.col("a") * subsumed_pct)))
    pair = pair.join(word(1, code), "w1").join(word(2), "w2")
    number = ["code", "w1", "w2", "w3", "a"]
    two = pair.withColumn("w3", F.lit(None).cast("long")).select(*number, F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))
    begin = pairs.select("w1", "w2", F.col("a").alias("f12"))
    end = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    triple = triples.join(begin, ["w1", "w2"]).join(end, ["w2", "w3"]).join(word(1, code), "w1").join(word(3), "w3")
    cuts = triple.withColumns({"s1": _score("a", "f1", "f23"), "s2": _score("a", "f12", "f3")})
    lower = F.col("s2") < F.col("s1")
    three = cuts.select(
        *number, F.when(lower, F.col("f12")).otherwise(F.col("f1")).alias("l"), F.when(lower, F.col("f3")).otherwise(F.col("f23")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    best = store.keep(two.unionByName(three))

    # the phrases at or above the score and count of the last rank are spelled out and ranked
    last = number_within(best.select("code", "score", "a", "w1", "w2"), ["code"], ["-score", "-a", "w1", "w2"], rn="rank", size=None).where(F.col("rank") == top)
    last = last.select("code", F.col("score").alias("least"), F.col("a").alias("least_a"))
    near = F.col("least").isNull() | (F.struct("score", "a") >= F.struct("least", "least_a"))
    first = store.keep(best.join(last, "code", "left").where(near).drop("least", "least_a"))
    ids = first.select(F.explode(F.array("w1", "w2", "w3")).alias("h")).where("h IS NOT NULL")
    spelled = store.keep(spellings(docs, seed, send(ids)))
    for i in (1, 2, 3):
        first = first.join(spelled.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}")), f"w{i}", "left")
    named = first.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3")).join(sizes, "code")
    ranked = number_within(store.keep(named.select("lang", "phrase", "a", "l", "r", "n", "score")), ["lang"], ["-score", "-a", "phrase"], rn="rank", size=None)
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _hash_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(i).to_numpy().view(U) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(signed(pair_hash(a, b))), batch.column(2)], names=["h", "a"])


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))

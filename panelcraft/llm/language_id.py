"""Language identification by interpolated Kneser-Ney character models, one per language.

Method: a text is lower-cased and becomes its letters, with one blank for whatever stands between
them.  Per language an interpolated Kneser-Ney model of ``ORDER`` characters is estimated from the
counts of a training sample: the highest order from occurrences, lower ones from the number of
different left neighbours, each with its own absolute discount.  The models lie side by side in
sorted arrays of n-gram hashes with one column of log probabilities a language (a language that
has not seen an n-gram has its backed-off value there), and sorted arrays of context hashes with
back-off weights for n-grams that no language has seen.  The language of the lowest cross-entropy
a character is chosen.  A part of the sample is kept from the models and calibrates the scale of
the ``score`` (a softmax of the cross-entropies) and, per language, the cross-entropy up to which
a choice is ``accepted``.

What is learnt from is bounded by two documented parameters: about ``SAMPLE_CHARS`` characters a
language, and less where many languages would make the arrays exceed ``MODEL_CELLS`` numbers.  The
texts of smallest hash are the sample, over all rows that may be learnt from; equal texts count once.
Every text is scored whole, in one pass without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows with a null lang
are not learnt from, and a null id is never learnt from and counts as held out; where nothing can
be learnt from every text is ``und``; the sample may hold one text beyond its bound, so that every
language is learnt; of equal cross-entropies the language first in order is taken; repeated rows are
scored row by row; a very long text is a block of its own; extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, table
from .words import U, mix

ORDER, SAMPLE_CHARS, MODEL_CELLS, CALIBRATE = 5, 400_000, 1 << 25, 4
UNSEEN = 1.0 / (1 << 16)  # the uniform share of a character under the lowest order
BLOCK_CHARS, CELLS = 1 << 19, 1 << 22
STEP = U(0x9E3779B97F4A7C15)
ACCEPT_QUANTILE, ACCEPT_SLACK = 0.99, 1.1
UND = "und"


@cache
def letters() -> np.ndarray:
    """Per code point: 2 a letter, 1 a mark that stands with letters, 0 anything else."""
    out = np.zeros(0x110000, np.uint8)
    kinds = {"L": 2, "M": 1}
    for i in range(0x110000):
        out[i] = kinds.get(unicodedata.category(chr(i))[0], 0)
    return out


def symbols(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rows, bounds) of texts in lower case: letters as code points, one 0 for what stands
    between them, ``order - 1`` zeros before and one after every text; texts without a letter have
    none.  Rows ``rows[i]`` have the symbols ``bounds[i] .. bounds[i + 1]``."""
    coded = [t.lower().encode("utf-32-le", "replace") for t in texts]
    codes = np.frombuffer(b"".join(coded), np.uint32)
    ends = np.cumsum([len(c) // 4 for c in coded])
    kind = letters()[codes]
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    inside = kind > 0
    gap = ~inside
    gap[1:] &= inside[:-1] & (row[1:] == row[:-1])  # the first of a run between letters
    if len(gap):
        gap[0] = False
    last = np.zeros(len(texts), np.int64) - 1  # the last inside character of a row; a gap after it is the end
    at = np.flatnonzero(inside)
    last[row[at]] = at
    keep = inside | (gap & (np.arange(len(codes)) < last[row]))
    named = np.bincount(row[kind == 2], minlength=len(texts)) > 0
    keep &= named[row]
    values, where = np.where(inside, codes, 0)[keep], row[keep]
    rows = np.flatnonzero(named)
    sizes = np.bincount(where, minlength=len(texts))[rows]
    bounds = np.concatenate([[0], np.cumsum(sizes + order)])
    out = np.zeros(bounds[-1], np.int64)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(bounds[:-1], sizes) + order - 1 + place] = values
    return out, rows, bounds


def gram_hashes(s: np.ndarray, order: int) -> list[np.ndarray]:
    """Per n = 1 .. order, the hash of the n symbols that end at every place."""
    out = [s.astype(U) + U(1)]
    for n in range(1, order):
        h = out[-1] * STEP
        h[n:] += out[0][: len(s) - n]
        out.append(h)
    return [mix(h + U(n)) for n, h in enumerate(out)]


class Hashed:
    """A sorted array of 64-bit hashes with rows of numbers; found by their leading bits."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order]
        bits = max(1, int(len(hashes)).bit_length())
        self.shift = U(64 - bits)
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=U))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of every hash, -1 where it is not there."""
        out = np.full(len(h), -1)
        lead = (h >> self.shift).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            here = at[todo]
            same = self.hashes[here] == h[todo]
            out[todo[same]] = here[same]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


class Models:
    """The character models of all languages, and what was calibrated."""

    def __init__(self, langs: list[str], order: int, grams: list[Hashed], contexts: list[Hashed], base: np.ndarray) -> None:
        self.langs, self.order, self.grams, self.contexts, self.base = langs, order, grams, contexts, base
        self.scale, self.accept = 1.0, np.full(len(langs), np.inf)

    def _log_p(self, n: int, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """log P of the symbols at places ``at`` by n-grams, a column a language."""
        if n == 0:
            return np.repeat(self.base[None, :], len(at), axis=0)
        found = self.grams[n - 1].find(hashes[n - 1][at])
        out = self.grams[n - 1].rows[found]
        miss = np.flatnonzero(found < 0)
        if len(miss):
            out[miss] = self._log_p(n - 1, hashes, at[miss])
            if n > 1:
                context = self.contexts[n - 1].find(hashes[n - 2][at[miss] - 1])
                known = context >= 0
                out[miss[known]] += self.contexts[n - 1].rows[context[known]]
            else:
                out[miss] += self.contexts[0].rows[0]
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, bits a character by language, characters) of the texts that have a letter."""
        s, rows, bounds = symbols(texts, self.order)
        hashes = gram_hashes(s, self.order)
        total = np.zeros((len(rows), len(self.langs)))
        places = np.ones(len(s), bool)
        for k in range(self.order - 1):
            places[bounds[:-1] + k] = False
        at = np.flatnonzero(places)
        row = np.repeat(np.arange(len(rows)), np.diff(bounds) - self.order + 1)
        step = max(1, CELLS // max(1, len(self.langs)))
        for i in range(0, len(at), step):
            part = row[i : i + step]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            total[part[first]] += np.add.reduceat(self._log_p(self.order, hashes, at[i : i + step]), first, axis=0, dtype=np.float64)
        chars = np.diff(bounds) - self.order + 1
        return rows, -total / (np.log(2) * np.maximum(chars, 1)[:, None]), chars

    def posterior(self, bits: np.ndarray, chars: np.ndarray, scale: float | None = None) -> np.ndarray:
        x = -bits * np.sqrt(chars)[:, None] * (self.scale if scale is None else scale)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def calibrate(self, truth: np.ndarray, bits: np.ndarray, chars: np.ndarray) -> None:
        """Choose the scale of least log loss and the accepted cross-entropies; ``truth``: languages by number."""
        if not len(truth):
            return
        rows = np.arange(len(truth))
        loss = {s: -np.log(self.posterior(bits, chars, s)[rows, truth] + 1e-12).mean() for s in 2.0 ** np.arange(-6, 5)}
        self.scale = min(loss, key=lambda s: (loss[s], -s))
        for i in range(len(self.langs)):
            own = bits[truth == i, i]
            if len(own):
                self.accept[i] = ACCEPT_SLACK * np.quantile(own, ACCEPT_QUANTILE)


def _distinct(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, number of each row among them)."""
    rows, inverse = np.unique(m, axis=0, return_inverse=True)
    return rows, inverse.reshape(-1)


def fit_kneser_ney(langs: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Models:
    """Models from the distinct highest-order grams: language number, symbols (a row each), count."""
    order, width = grams.shape[1], len(langs)
    tables, weights = [], []
    base = np.log(np.full(width, UNSEEN, np.float32))
    # n-gram counts of every order: occurrences at the highest, different left neighbours below
    levels = []
    lang_n, gram_n, count_n = lang, grams, counts
    for n in range(order, 0, -1):
        levels.append((lang_n, gram_n, count_n))
        both, inverse = _distinct(np.column_stack([lang_n, gram_n[:, 1:]]))
        lang_n, gram_n, count_n = both[:, 0], both[:, 1:], np.bincount(inverse)
    p_lower = None  # probability of every distinct (n - 1)-gram of the level below, by language
    lower = None
    for n, (lang_n, gram_n, count_n) in enumerate(reversed(levels), start=1):
        once, twice = (np.bincount(lang_n[count_n == k], minlength=width) for k in (1, 2))
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        union, at = _distinct(gram_n)
        context, of = _distinct(gram_n[:, :-1]) if n > 1 else (np.zeros((1, 0), np.int64), np.zeros(len(gram_n), np.int64))
        seen, kinds = np.zeros((len(context), width)), np.zeros((len(context), width))
        np.add.at(seen, (of, lang_n), count_n)
        np.add.at(kinds, (of, lang_n), 1)
        back = np.where(seen > 0, discount * kinds / np.maximum(seen, 1), 1.0)
        own = np.zeros((len(union), width))
        own[at, lang_n] = np.maximum(count_n - discount[lang_n], 0) / np.maximum(seen[of, lang_n], 1)
        context_of = np.zeros(len(union), np.int64)
        context_of[at] = of
        if n == 1:
            below = np.full((len(union), width), UNSEEN)
        else:  # the shorter gram, without the first symbol, is in the level below
            below = p_lower[_places(lower, union[:, 1:])]
        p = own + back[context_of] * below
        tables.append(Hashed(_row_hashes(union), np.log(p).astype(np.float32)))
        weights.append(Hashed(_row_hashes(context) if n > 1 else np.zeros(1, U), np.log(back).astype(np.float32)))
        p_lower, lower = p, union
    return Models(langs, order, tables, weights, base)


def _places(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of ``wanted`` rows among the distinct, sorted ``rows`` that hold them all."""
    h = _row_hashes(rows)
    order = np.argsort(h)
    return order[np.searchsorted(h[order], _row_hashes(wanted))]


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """The hash of every row of symbols, as ``gram_hashes`` has it."""
    n = rows.shape[1]
    first = rows.astype(U) + U(1)
    h = first[:, -1].copy()
    for j in range(n - 2, -1, -1):
        h = h * STEP + first[:, j]
    return mix(h + U(n - 1))


def learnable(doc_id: Column) -> Column:
    """Whether a row may be learnt from: crc32 of its id as text, modulo 4, is not 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive texts of about ``BLOCK_CHARS`` characters."""
    every = [t or "" for t in texts.to_pylist()]
    i = 0
    while i < len(every):
        j, size = i, 0
        while j < len(every) and (j == i or size + len(every[j]) <= BLOCK_CHARS):
            size += len(every[j])
            j += 1
        yield i, every[i:j]
        i = j


def _count_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _blocks(batch.column(1)):
                s, rows, bounds = symbols(texts, order)
                windows = np.lib.stride_tricks.sliding_window_view(s, order) if len(s) else np.zeros((0, order), np.int64)
                starts = np.ones(len(windows), bool)
                for k in range(1, order):
                    starts[bounds[1:-1] - k] = False  # windows over the border of two texts
                at = np.flatnonzero(starts)
                row = rows[np.searchsorted(bounds, at, "right") - 1]
                grams, n = np.unique(np.column_stack([row, windows[at]]), axis=0, return_counts=True)
                langs = batch.column(0).take(pa.array(first + grams[:, 0]))
                offsets = pa.array(np.arange(len(grams) + 1) * order, pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(grams[:, 1:].reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([langs, lists, pa.array(n)], names=["lang", "gram", "n"])

    return run


def train(docs: DataFrame, order: int = ORDER, sample_chars: int = SAMPLE_CHARS) -> Models | None:
    """Models of the languages of documents (doc_id, lang, text); None if none can be learnt."""
    learn = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    draw = F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 40))
    found = learn.groupBy("lang").agg(F.sum(F.char_length("text")).alias("chars"), F.min(draw).alias("least")).toArrow().sort_by("lang").to_pylist()
    if not found:
        return None
    langs = [x["lang"] for x in found]
    chars = min(sample_chars, max(1000, MODEL_CELLS // len(langs) ** 2))
    limits = [(x["lang"], max(x["least"], int((1 << 40) * min(1.0, chars / x["chars"])))) for x in found]
    spark = docs.sparkSession
    bound = spark.createDataFrame(limits, "lang string, bound long")
    store = Scratch(spark, "language-id")
    sample = learn.withColumn("draw", draw).join(F.broadcast(bound), "lang").where("draw <= bound").dropDuplicates(["lang", "text"])
    sample = store.keep(sample.select("lang", "text", (F.pmod(F.xxhash64("text", "lang"), F.lit(CALIBRATE)) == 0).alias("aside")))
    # a language all of whose texts are set aside is learnt from them after all
    kept = sample.where("NOT aside").select("lang").distinct()
    fit = sample.where("NOT aside").unionByName(sample.where("aside").join(kept, "lang", "left_anti"))
    counted = fit.select("lang", "text").mapInArrow(_count_grams(order), "lang string, gram array<int>, n long")
    got = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    number = {x: i for i, x in enumerate(langs)}
    lists = got.column("gram").combine_chunks()
    grams = lists.flatten().to_numpy().reshape(-1, order).astype(np.int64)
    lang = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)
    by = np.lexsort([*grams.T, lang])  # sums in one order, whatever order the rows came in
    models = fit_kneser_ney(langs, lang[by], grams[by], got.column("n").to_numpy()[by])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _blocks(batch.column(1)):
                rows, bits, n = models.cross_entropy(texts)
                own = batch.column(0).take(pa.array(first + rows))
                yield pa.RecordBatch.from_arrays([own, pa.array(list(bits), pa.list_(pa.float64())), pa.array(n)], names=["lang", "bits", "chars"])

    told = sample.where("aside").select("lang", "text").mapInArrow(measure, "lang string, bits array<double>, chars long").toArrow().to_pylist()
    told.sort(key=lambda x: (x["lang"], x["chars"], x["bits"]))
    if told:
        models.calibrate(np.array([number[x["lang"]] for x in told]), np.array([x["bits"] for x in told]), np.array([x["chars"] for x in told]))
    store.drop()
    return models


def identify(docs: DataFrame, models: Models | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred, score, bits (a character) and accepted."""
    kept = [c for c in docs.columns if c != text_col]
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string, score double, bits double, accepted boolean"])
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = batch.num_rows
            pred, score, least = np.full(n, -1), np.zeros(n), np.full(n, np.nan)
            ok = np.zeros(n, bool)
            for first, texts in _blocks(batch.column(text_col)) if m is not None else ():
                rows, bits, chars = m.cross_entropy(texts)
                if not len(rows):
                    continue
                best = bits.argmin(axis=1)
                at, each = first + rows, np.arange(len(rows))
                pred[at], least[at] = best, bits[each, best]
                score[at] = m.posterior(bits, chars)[each, best]
                ok[at] = bits[each, best] <= m.accept[best]
            names = np.array([*(m.langs if m is not None else []), UND], object)
            cols = [pa.array(names[pred], pa.string()), pa.array(np.round(score, 9)), pa.array(np.round(least, 9), from_pandas=True), pa.array(ok)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *cols], names=[*kept, "lang_pred", "score", "bits", "accepted"])

    return docs.mapInArrow(run, fields)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it was held out of learning, its language, score, cross-entropy and
    whether that is one the language's own texts have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    told = identify(docs.select("doc_id", "text"), train(docs))
    return told.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "bits", "accepted")

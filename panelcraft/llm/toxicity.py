"""Toxicity scores by non-negative positive-unlabelled learning.

Method: confirmed toxic documents (positives) and a sample of all documents (unlabelled) train
a linear classifier in numpy on the risk

    prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)])

whose second part, the negatives' risk seen through the unlabelled ones, is kept from going
below zero (when it does, the step goes up its gradient instead).  ``prior`` is the share of
toxic rows among the labels that may be learnt from.  Features are presences of words and word
beginnings whose document frequency differs significantly between the two samples.

What is learnt from is bounded by documented parameters: at most ``POSITIVES`` positives and
``UNLABELLED`` other texts, those of smallest id hash over the whole tables (rows that repeat an id
with its text are one), and the ``MAX_FEATURES`` features that tell the samples apart most; rows
whose crc32(doc_id as text) mod 3 is 1 are never learnt from.  Every text is scored whole, in one
pass without a shuffle.

Defined cases: a null or empty text has no features and gets the score of the bias alone;
null labels are no labels; a null doc_id is never learnt from and counts as held out; without
any positive every score is 0; repeated rows are scored row by row and learnt from once; ids of
equal hash are taken by id, then by text; a very long text is a block of its own; a column of the
score's name keeps its values in ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import free_name, table
from .words import U, WordBlock, signed, word_blocks

POSITIVES, UNLABELLED = 1500, 4000
PREFIXES, MIN_Z, MIN_DOCS, MAX_FEATURES = (4, 5, 6), 5.0, 5, 4000
STEPS, RATE, DECAY, THRESHOLD = 300, 0.05, 1e-2, 0.7
FILTER_BITS = 20


def features_of(b: WordBlock) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words and word beginnings of a block, repeated as they occur."""
    row = b.word_row()
    rows, hashes = [row], [b.hashes]
    for n in PREFIXES:
        word, h = b.prefixes(n)
        rows.append(row[word])
        hashes.append(h)
    return np.concatenate(rows), np.concatenate(hashes)


class Classifier:
    """Weights of present features; scores texts block by block."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float) -> None:
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias

    def margins(self, b: WordBlock, maybe: np.ndarray) -> np.ndarray:
        """Bias plus the weights of the distinct known features of every row; ``maybe`` marks
        the low bits that any known feature has."""
        row, h = features_of(b)
        near = np.flatnonzero(maybe[(h & U((1 << FILTER_BITS) - 1)).astype(np.int64)])
        row, h = row[near], h[near]
        if not len(h) or not len(self.hashes):
            return np.full(b.rows, self.bias)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        pairs = np.unique(row[known] * len(self.hashes) + at[known])
        return self.bias + np.bincount(pairs // len(self.hashes), self.weights[pairs % len(self.hashes)], b.rows)

    def low_bits(self) -> np.ndarray:
        maybe = np.zeros(1 << FILTER_BITS, bool)
        maybe[(self.hashes & U((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        return maybe


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> Classifier:
    """Train on the distinct feature hashes of each document of the two samples."""
    docs = [*positive, *unlabelled]
    sizes = np.array([len(d) for d in docs])
    flat = np.concatenate(docs) if docs else np.zeros(0, U)
    hashes, index = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(docs)), sizes)
    n_p, n_u = len(positive), len(unlabelled)
    in_p = np.bincount(index[row < n_p], minlength=len(hashes))
    in_u = np.bincount(index[row >= n_p], minlength=len(hashes))
    share = (in_p + in_u) / (n_p + n_u)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    keep = np.flatnonzero((np.abs(z) >= MIN_Z) & (in_p + in_u >= MIN_DOCS))
    keep = np.sort(keep[np.argsort(-np.abs(z[keep]), kind="stable")[:MAX_FEATURES]])
    new = np.full(len(hashes), -1)
    new[keep] = np.arange(len(keep))
    used = new[index] >= 0
    row, index = row[used], new[index][used]
    is_p = np.arange(n_p + n_u) < n_p

    w, moment, square = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        f = w[-1] + np.bincount(row, w[index], n_p + n_u)
        s = sigmoid(f)  # derivatives of the logistic losses: of loss(f) it is s - 1, of loss(-f) s
        loss_neg = np.logaddexp(0, f)
        negative = loss_neg[~is_p].mean() - prior * loss_neg[is_p].mean()
        g_neg = np.where(is_p, -prior * s / n_p, s / n_u)
        g_doc = np.where(is_p, prior * (s - 1) / n_p, 0) + g_neg if negative >= 0 else -g_neg
        g = np.append(np.bincount(index, g_doc[row], len(keep)) + DECAY * w[:-1] / max(1, len(keep)), g_doc.sum())
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-10)
    return Classifier(hashes[keep], w[:-1], float(w[-1]))


def learnable(doc_id: Column) -> Column:
    """Whether a row may be learnt from: crc32 of its id as text, modulo 3, is not 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier | None:
    """The classifier of documents (doc_id, text) and labels (doc_id, toxic)."""
    learn = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    prior = learn.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not prior:
        return None
    confirmed = learn.where("toxic = 1").select("doc_id").distinct()
    # the different texts of an id: the limits count these, however often a row repeats
    texts = docs.where(learnable(F.col("doc_id"))).select("doc_id", F.xxhash64("text").alias("digest"), F.col("text"))
    each = texts.select("doc_id", "digest").distinct()
    # bounded by the two parameters, so the ids are broadcast
    ids = [
        each.join(confirmed, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(positives).withColumn("part", F.lit(1)),
        each.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "digest").limit(unlabelled).withColumn("part", F.lit(0)),
    ]
    picked = texts.join(F.broadcast(ids[0].unionByName(ids[1])), ["doc_id", "digest"])
    picked = picked.groupBy("part", "doc_id", "digest").agg(F.min("text").alias("text")).select("part", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for b in word_blocks(batch.column(1)):
                row, h = features_of(b)
                order = np.argsort(row, kind="stable")
                at = np.searchsorted(row[order], np.arange(b.rows + 1))
                lists += [signed(np.unique(h[order[at[i] : at[i + 1]]])) for i in range(b.rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["part", "features"])

    got = picked.mapInArrow(run, "part int, features array<long>").toArrow()
    part, lists = got.column("part").to_numpy(), got.column("features").combine_chunks()
    flat, ends = lists.flatten().to_numpy().view(U), lists.offsets.to_numpy()
    ends = ends - ends[0] if len(ends) else ends
    sets = [flat[ends[i] : ends[i + 1]] for i in range(len(part))]
    samples = [[s for s, p in zip(sets, part, strict=True) if p == y] for y in (1, 0)]
    if not samples[0] or not samples[1]:
        return None
    # each different text counts once, in an order of its own: sums depend on the order of rows
    samples = [[d for _, d in sorted({x.tobytes(): x for x in s}.items())] for s in samples]
    return fit_nnpu(*samples, min(float(prior), 0.99))


def with_scores(docs: DataFrame, model: Classifier | None, out: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the column ``out``: the probability of being toxic, by the whole text."""
    kept = [c for c in docs.columns if keep_text or c != text_col]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = model.low_bits()
        for batch in batches:
            margins = [model.margins(b, maybe) for b in word_blocks(batch.column(text_col))]
            scores = sigmoid(np.concatenate(margins)) if margins else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.round(scores, 9))], names=[*kept, out])

    return docs.mapInArrow(run, T.StructType([*docs.select(kept).schema.fields, T.StructField(out, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold."""
    out = free_name(docs, "toxicity")
    return with_scores(docs, train(docs, labels), out).where(F.col(out) < threshold).drop(out)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it was held out of learning, its score and the decision at 0.7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, train(docs, table(spark, sf_dir, "labels")), "score", keep_text=False)
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

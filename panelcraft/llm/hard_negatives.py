"""Hard negatives of anchor vectors by coordinate pruning in length buckets.

Method (LEMP): every task holds its vectors in buckets of one label and about one length, longest
first, and every bucket keeps, per coordinate, its normalised values in sorted order.  An anchor
that needs a score of ``T`` of a bucket whose longest vector has length ``l`` needs a cosine of
``T / (|q| l)``.  Above 1 the bucket is skipped.  Otherwise a vector at that cosine can have in
coordinate f only values ``cos(beta)`` with ``|alpha - beta| <= tau`` (``cos(alpha)``: the anchor's
own value, ``cos(tau)``: the cosine needed), which is one range of the sorted list.  The ranges of
the anchor's ``FOCUS`` largest coordinates are intersected, and what is left is verified by exact
integer products.  ``T`` rises while the buckets are searched.  An anchor whose ranges leave most
of a bucket standing is verified against the bucket whole, in one matrix product.

Two searches: the first positives of an anchor among the rows of its label, then for each positive
the first rows of other labels inside the window of scores that the positive opens.

Scale: the rows are shuffled once (repeats go), the anchors are the stated query set and are sent
to all rows in blocks of ``CHUNK``, a broadcast of fixed size; a task gives at most ``positives``
rows an anchor and ``negatives`` rows a positive, and these are what is shuffled.  Labels and hot
vectors do not decide where a row goes, so no label or vector fills a task.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take
no part; rows that repeat wholly count once, and rows of the anchor's own id are not other rows;
vectors of different lengths are filled up with zeros; ties are settled by the smaller id; a
positive with a negative score opens no window; scores beyond 64 bits raise an error; an empty
table, or one without anchors, gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Scratch, table

POSITIVES, NEGATIVES, LOW_PCT, HIGH_PCT = 5, 3, 50, 95
CHUNK, TASK_ROWS, LEAST_ROWS = 4096, 65_536, 2048
BUCKET, SHORTEST, FOCUS, MOST = 2048, 0.9, 5, 0.3
SLACK = 1e-9  # of cosines, for the rounding of floats; scores are exact
NEVER = np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(vec_id, label, v, n2) of the rows that take part, each once: components floor(256 x) and
    the squared length."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    picked = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform(vec_col, lambda x: F.floor(x.cast("double") * 256.0))
    picked = picked.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole.alias("v")).distinct()
    return picked.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers, short ones filled with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Anchors:
    """A block of anchors, sorted by id, as the tasks search with it."""

    def __init__(self, t: pa.Table, width: int, exact_floats: bool) -> None:
        order = np.argsort(t.column("vec_id").to_numpy(), kind="stable")
        t = t.take(pa.array(order)).combine_chunks()
        self.ids, self.labels = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
        lists = t.column("v")
        self.q = _matrix(lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int64())), width)
        self.width, self.kind = width, np.float64 if exact_floats else np.int64
        self.length = np.sqrt((self.q.astype(np.float64) ** 2).sum(axis=1))
        unit = self.q / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        self.angle = np.arccos(np.clip(np.take_along_axis(unit, self.focus, axis=1), -1, 1))


class Bucket:
    """Rows of one label and similar length with their sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, label: int, v: np.ndarray, n2: np.ndarray, kind: type) -> None:
        length = np.sqrt(n2)
        self.ids, self.label, self.v, self.longest = ids, label, v.astype(kind), float(length.max())
        self.unit = v / np.maximum(length, 1e-300)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.unit.T, self.order, axis=1)

    def candidates(self, a: Anchors, which: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Of the anchors ``which`` that need scores ``need``: those to be verified against the
        whole bucket, and (anchor, row numbers) of the others that have candidates."""
        reach = a.length[which] * self.longest
        cosine = np.where(need > 0, need / np.maximum(reach, 1e-300), -1.0)
        alive = cosine <= 1 + SLACK
        which, cosine = which[alive], np.clip(cosine[alive] - SLACK, -1, 1)
        tau = np.arccos(cosine)[:, None]
        angle, focus = a.angle[which], a.focus[which]
        low = np.cos(np.minimum(np.pi, angle + tau)) - SLACK
        high = np.cos(np.maximum(0, angle - tau)) + SLACK
        first, last = np.zeros(low.shape, np.int64), np.full(low.shape, len(self.ids))
        for f in np.unique(focus):
            at = np.nonzero(focus == f)
            first[at] = np.searchsorted(self.sorted[f], low[at], "left")
            last[at] = np.searchsorted(self.sorted[f], high[at], "right")
        size = last - first
        least = size.min(axis=1, initial=len(self.ids))
        some = []
        for i in np.flatnonzero(least <= MOST * len(self.ids)).tolist():
            j = int(size[i].argmin())
            rows = self.order[focus[i, j], first[i, j] : last[i, j]]
            for k in range(focus.shape[1]):
                if k != j and size[i, k] < len(self.ids):
                    x = self.unit[rows, focus[i, k]]
                    rows = rows[(x >= low[i, k]) & (x <= high[i, k])]
            if len(rows):
                some.append((int(which[i]), np.sort(rows)))
        return which[least > MOST * len(self.ids)], some


class Best:
    """The first ``k`` (score, id) of every slot so far, each within bounds of the score."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.k, self.low, self.high = k, low, high  # low rises once k rows are held
        self.slot = self.score = self.id = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        slot, score, row_id = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, row_id)))
        order = np.lexsort((row_id, -score, slot))
        slot, score, row_id = slot[order], score[order], row_id[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], row_id[keep]
        full = place[keep] == self.k - 1
        self.low[self.slot[full]] = self.score[full]

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores (slot, row) of some slots with rows ``ids``; ``own``: the id that a slot must not take."""
        inside = (scores >= self.low[slots][:, None]) & (scores <= self.high[slots][:, None]) & (ids != own[:, None])
        n = scores.shape[1]
        many = np.flatnonzero(inside.sum(axis=1) > 4 * self.k)
        if len(many) and n > self.k:  # only the first k and their ties
            least = np.iinfo(np.int64).min
            part = np.where(inside[many], scores[many], least)
            inside[many] &= scores[many] >= np.partition(part, n - self.k, axis=1)[:, n - self.k][:, None]
        at, row = np.nonzero(inside)
        if len(at):
            self.add(slots[at], scores[at, row], ids[row])


def buckets(batches: Iterator[pa.RecordBatch], width: int, kind: type) -> Iterator[Bucket]:
    """Runs of rows (vec_id, label, v, n2) of a label and of lengths down to ``SHORTEST`` of the first."""
    held = None
    for batch in batches:
        part = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), width), batch.column(3).to_numpy()]
        held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
        while len(held[0]) >= BUCKET:
            n = _run(held)
            yield Bucket(held[0][:n], int(held[1][0]), held[2][:n], held[3][:n], kind)
            held = [x[n:] for x in held]
    while held is not None and len(held[0]):
        n = _run(held)
        yield Bucket(held[0][:n], int(held[1][0]), held[2][:n], held[3][:n], kind)
        held = [x[n:] for x in held]


def _run(held: list[np.ndarray]) -> int:
    _, label, _, n2 = held
    ends = (label[:BUCKET] != label[0]) | (n2[:BUCKET] < SHORTEST**2 * n2[0]) | (n2[:BUCKET] > n2[0])
    return int(ends.argmax()) if ends.any() else min(BUCKET, len(label))


def search(points: DataFrame, anchors, low: np.ndarray, high: np.ndarray, k: int, same_label: bool) -> DataFrame:
    """(slot, vec_id, score): each task's first ``k`` rows of every slot.  Slots are columns of
    ``low`` and ``high`` (anchor x slots), bounds of the score; rows are of the anchor's label or of
    other ones."""
    per = low.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors.value
        best = Best(low.reshape(-1).copy(), high.reshape(-1), k)
        for b in buckets(batches, a.width, a.kind):
            which = np.flatnonzero((a.labels == b.label) == same_label)
            need = best.low.reshape(-1, per)[which].min(axis=1)
            which, need = which[need != NEVER], need[need != NEVER]
            whole, some = b.candidates(a, which, need)
            for i in range(0, len(whole), 512):
                part = whole[i : i + 512]
                scores = (a.q[part].astype(a.kind) @ b.v.T).astype(np.int64)
                for j in range(per):
                    best.offer(part * per + j, scores, b.ids, a.ids[part])
            for i, rows in some:
                scores = (a.q[i : i + 1].astype(a.kind) @ b.v[rows].T).astype(np.int64)
                for j in range(per):
                    best.offer(np.array([i * per + j]), scores, b.ids[rows], a.ids[i : i + 1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.slot, best.id, best.score)], names=["slot", "vec_id", "score"])

    found = points.mapInArrow(run, "slot long, vec_id long, score long")
    w = Window.partitionBy("slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low_pct: int = LOW_PCT, high_pct: int = HIGH_PCT,
) -> DataFrame:
    """Per anchor (rows where ``is_anchor``, a condition on ``vec_id``) and positive, the first
    ``negatives`` rows of other labels with ``low_pct * positive_score <= 100 * score <= high_pct *
    positive_score``: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    store = Scratch(spark, "hard-negatives")
    plain = whole_vectors(rows, id_col, label_col, vec_col)
    n = rows.count()
    tasks = max(1, -(-n // TASK_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    points = store.keep(plain.repartition(tasks, "vec_id").sortWithinPartitions("label", F.col("n2").desc()))
    facts = points.agg(F.max(F.size("v")).alias("width"), F.max("n2").alias("n2"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    if (facts.n2 or 0) >= 2.0**62:
        raise ValueError("scores of these vectors can exceed 64 bits")
    chunks = max(1, -(-facts.anchors // CHUNK))
    out = []
    for c in range(chunks):
        block = points.where(is_anchor & (F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c)).select("vec_id", "label", "v").toArrow()
        a = Anchors(block, facts.width or 0, (facts.n2 or 0) < 2.0**53)
        sent = spark.sparkContext.broadcast(a)
        least, most = np.full((len(a.ids), 1), np.iinfo(np.int64).min), np.full((len(a.ids), 1), NEVER)
        near = search(points, sent, least, most, positives, same_label=True).toArrow()  # at most CHUNK x positives rows
        slot, place = near.column("slot").to_numpy(), near.column("rank").to_numpy() - 1
        score, pos_id = near.column("score").to_numpy(), near.column("vec_id").to_numpy()
        low, high = np.full((len(a.ids), positives), NEVER), np.full((len(a.ids), positives), -1)
        from_score, to_score = _window(score, low_pct, high_pct)
        opens = from_score <= to_score
        low[slot[opens], place[opens]], high[slot[opens], place[opens]] = from_score[opens], to_score[opens]
        pairs = zip((slot * positives + place).tolist(), a.ids[slot].tolist(), pos_id.tolist(), score.tolist(), strict=True)
        named = spark.createDataFrame(list(pairs), "slot long, anchor_id long, positive_id long, positive_score long")
        hard = search(points, sent, low, high, negatives, same_label=False)
        hard = hard.join(F.broadcast(named), "slot").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        out.append(store.keep(hard))
    return reduce(DataFrame.unionByName, out)


def _window(score: np.ndarray, low_pct: int, high_pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole s with low_pct * score <= 100 s <= high_pct * score, in exact numbers."""
    low = [-((-low_pct * s) // 100) for s in score.tolist()]
    high = [(high_pct * s) // 100 for s in score.tolist()]
    return np.array(low, np.int64), np.array(high, np.int64)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: ids divisible by 50; labels of ids divisible by 7 move on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)

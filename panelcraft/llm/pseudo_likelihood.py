"""Document scores by masked pseudo-likelihood.

Method: a small window network predicts every word from the two words on either side of it
(the word itself is masked): hidden = tanh(sum of position-wise embeddings + bias), then a softmax
in two levels, over ``CLUSTERS`` clusters of the vocabulary and over the ``LEAVES`` classes of the
word's own cluster, which multiply to an exact, normalised probability.  A document's score is the
sum of its words' conditional log probabilities, and its mean per word.

The vocabulary is counted over the whole corpus: the ``TOP`` most frequent words are classes of
their own, by frequency in the first clusters, every other word is in one of ``RARE`` hashed
classes, the last cluster.  A word's probability is its class's times its share of the class's
occurrences in the corpus (every word keeps its count), so log probabilities are those of words.
As contexts, words of one class are alike.  Training is data parallel over the whole corpus: in
each of ``ROUNDS`` rounds every partition starts from the common weights, takes all positions of
every ``ROUNDS``-th text, other texts each round, so that all positions are learnt from, runs
Adam in numpy, and the weights are averaged by the number of targets, in a tree of groups of
``FAN_IN`` partitions.  A step takes ``BATCH`` targets; a partition that has fewer than ``STEPS``
such steps takes smaller ones, and its targets several times, until it has made ``STEPS``.

Scale: word counts are combined per batch before their shuffle; a weight vector is about
0.7 MB, so the driver only ever holds one of them; scoring is one pass over the texts, whose
distinct words outside the ``TOP`` meet their counts in a join (hash and number, no texts)
and are summed per document without being stored.

Defined cases: a null or empty text, or one without words, has 0 words, sum 0 and mean 0;
an empty corpus gives no rows; repeated rows are scored row by row, and count as often in
training; of words of equal frequency those of smaller hash have a class of their own; a very long
text is a block of its own; only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import freeze
from .tables import Scratch, id_text, table
from .words import U, WordBlock, mix, signed, word_blocks

CLUSTERS, LEAVES, WIDTH, DIM = 64, 32, 2, 16
SIZE = CLUSTERS * LEAVES
RARE = LEAVES  # the last cluster
TOP = SIZE - RARE
ROUNDS, BATCH, LEAST, STEPS, RATE, FAN_IN, CHUNK = 2, 8192, 64, 150, 0.01, 8, 16_384
PART_WORDS = 2_000_000
OFFSETS = [o for o in range(-WIDTH, WIDTH + 1) if o]
ALL_WORDS = 0  # the key under which the number of all words is counted


class Network:
    """Weights of the window network as views of one float32 vector."""

    SHAPES = [(len(OFFSETS), SIZE + 1, DIM), (DIM,), (DIM, CLUSTERS), (CLUSTERS,), (CLUSTERS, DIM, LEAVES), (CLUSTERS, LEAVES)]

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, self.parts, at = flat, [], 0
        for shape in self.SHAPES:
            n = int(np.prod(shape))
            self.parts.append(flat[at : at + n].reshape(shape))
            at += n
        self.embed, self.hidden_bias, self.out, self.out_bias, self.leaf, self.leaf_bias = self.parts

    @classmethod
    def start(cls, share: np.ndarray) -> Network:
        """Small random embeddings; the biases are the log shares of clusters and their classes."""
        n = sum(int(np.prod(s)) for s in cls.SHAPES)
        net = cls(np.random.default_rng(7).normal(0, 0.1, n).astype(np.float32))
        net.hidden_bias[:] = 0
        mass = share.reshape(CLUSTERS, LEAVES).sum(axis=1)
        net.out_bias[:] = np.log(mass)
        net.leaf_bias[:] = np.log(share.reshape(CLUSTERS, LEAVES) / mass[:, None])
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.hidden_bias + self.embed[0][context[0]]
        for j in range(1, len(OFFSETS)):
            h += self.embed[j][context[j]]
        return np.tanh(h)

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty(len(target), np.float32)
        for i in range(0, len(target), CHUNK):
            h, t = self.hidden(context[:, i : i + CHUNK]), target[i : i + CHUNK]
            cluster = t // LEAVES
            part = _log_softmax(h @ self.out + self.out_bias, cluster)
            order, runs = _by_cluster(cluster)
            part[order] += _log_softmax(self._leaf_logits(h[order], runs), t[order] % LEAVES)
            out[i : i + CHUNK] = part
        return out

    def _leaf_logits(self, h: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits of every row's own cluster's classes; the rows are in runs of a cluster."""
        out = np.empty((len(h), LEAVES), np.float32)
        for c, a, b in runs:
            np.matmul(h[a:b], self.leaf[c], out=out[a:b])
            out[a:b] += self.leaf_bias[c]
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Gradient of the mean negative log probability."""
        h, cluster = self.hidden(context), target // LEAVES
        p = _excess(h @ self.out + self.out_bias, cluster)
        back = p @ self.out.T
        leaf, leaf_bias = np.zeros(self.leaf.shape, np.float32), np.zeros(self.leaf_bias.shape, np.float32)
        order, runs = _by_cluster(cluster)
        near = h[order]
        q = _excess(self._leaf_logits(near, runs), target[order] % LEAVES)
        ends = np.empty_like(near)
        for c, a, b in runs:
            np.matmul(q[a:b], self.leaf[c].T, out=ends[a:b])
            leaf[c], leaf_bias[c] = near[a:b].T @ q[a:b], q[a:b].sum(axis=0)
        back[order] += ends
        back *= 1 - h * h
        at, weights = np.arange(DIM), back.reshape(-1).astype(np.float64)
        embed = [np.bincount((c[:, None] * DIM + at).reshape(-1), weights, (SIZE + 1) * DIM) for c in context]
        parts = [*embed, back.sum(axis=0), h.T @ p, p.sum(axis=0), leaf, leaf_bias]
        g = np.concatenate([x.reshape(-1) for x in parts], dtype=np.float32, casting="same_kind")
        g /= len(target)
        return g


def _by_cluster(cluster: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order by cluster, (cluster, first, after the last) of every run in it)."""
    order = np.argsort(cluster.astype(np.int16), kind="stable")  # two bytes: a radix sort
    ends = np.cumsum(np.bincount(cluster, minlength=CLUSTERS))
    return order, [(c, int(ends[c - 1]) if c else 0, int(ends[c])) for c in np.flatnonzero(np.diff(ends, prepend=0)).tolist()]


SAFE = 60.0  # a spread of logits at which exp neither overflows nor vanishes in float32


def _exp(logits: np.ndarray) -> np.ndarray | float:
    """exp of the logits in place, less a shift; returns the shift, of all or of every row."""
    shift = logits.max() if logits.size else np.float32(0)
    if logits.size and shift - logits.min() > SAFE:
        shift = logits.max(axis=1)[:, None]
    logits -= shift
    np.exp(logits, out=logits)
    return shift


def _log_softmax(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    mine = logits[np.arange(len(own)), own]
    shift = _exp(logits)
    return mine - np.log(logits @ np.ones(logits.shape[1], np.float32)) - (shift[:, 0] if np.ndim(shift) else shift)


def _excess(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """softmax - one at the own class."""
    _exp(logits)
    logits *= (1 / (logits @ np.ones(logits.shape[1], np.float32)))[:, None]
    logits[np.arange(len(own)), own] -= 1
    return logits


class Adam:
    def __init__(self, n: int) -> None:
        self.m, self.v, self.t = np.zeros(n, np.float32), np.zeros(n, np.float32), 0

    def step(self, flat: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        flat -= RATE * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def word_ids(h: np.ndarray, top: np.ndarray, top_ids: np.ndarray) -> np.ndarray:
    """Vocabulary ids of word hashes (``top`` sorted)."""
    ids = (TOP + h % U(RARE)).astype(np.int64)
    if len(top):
        at = np.minimum(np.searchsorted(top, h), len(top) - 1)
        known = top[at] == h
        ids[known] = top_ids[at[known]]
    return ids


def contexts(b: WordBlock, ids: np.ndarray) -> np.ndarray:
    """(offset, word) ids around every word; SIZE where the document ends."""
    row, n = b.word_row(), len(ids)
    out = np.full((len(OFFSETS), n), SIZE, np.int64)
    for j, o in enumerate(OFFSETS):
        a, z = max(0, -o), max(0, n - max(0, o))
        at = np.arange(a, z)
        same = row[at + o] == row[at]
        out[j, at[same]] = ids[at[same] + o]
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(hash, n) over the whole corpus, and the number of all words under ALL_WORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [b.hashes for b in word_blocks(batch.column(0), 4 << 20)]
            h, n = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, U), return_counts=True)
            h, n = np.append(signed(h), ALL_WORDS), np.append(n, n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["hash", "n"])

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def log_shares(counts: DataFrame, top: np.ndarray) -> DataFrame:
    """(hash, log_share): of every word that has no id of its own, the log of its share in its class."""
    known = [ALL_WORDS, *top.view(np.int64).tolist()]
    rare = counts.where(~F.col("hash").isin(known)).withColumn("class", F.col("hash").bitwiseAND(RARE - 1))
    classes = rare.groupBy("class").agg(F.sum("n").alias("total"))
    return rare.join(F.broadcast(classes), "class").select("hash", F.log(F.col("n") / F.col("total")).alias("log_share"))


def train(docs: DataFrame, counts: DataFrame) -> tuple[Network, np.ndarray, np.ndarray] | None:
    """The network of a corpus (doc_id, text) and its word counts, with the top words' hashes
    (sorted) and ids."""
    top = counts.orderBy(F.desc("n"), "hash").limit(TOP + 1).collect()
    total = sum(r["n"] for r in top if r["hash"] == ALL_WORDS)
    if not total:
        return None
    words = [r for r in top if r["hash"] != ALL_WORDS][:TOP]
    hashes = np.array([r["hash"] for r in words], np.int64).view(U)
    share = np.full(SIZE, (total - sum(r["n"] for r in words) + 1) / RARE / total)
    share[: len(words)] = [r["n"] / total for r in words]
    share[len(words) : TOP] = 1e-9
    order = np.argsort(hashes)
    hashes, ids = hashes[order], order.astype(np.int64)
    net = Network.start((share / share.sum()).astype(np.float32))
    # small partitions are read together, so that none of them has to repeat its few targets
    docs = docs.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // PART_WORDS)))
    for round_ in range(ROUNDS):
        mean = _average(_local(docs, net, hashes, ids, round_))
        net = net if mean is None else Network(mean)  # a round may have no text
    return net, hashes, ids


def _local(docs: DataFrame, net: Network, top: np.ndarray, top_ids: np.ndarray, round_: int) -> DataFrame:
    """One row per partition: part, targets learnt from, weights after them."""
    start = docs.sparkSession.sparkContext.broadcast(net.flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(start.value.copy())
        adam, n, kept = Adam(len(own.flat)), 0, []

        def learn(least: int) -> int:
            if not kept or sum(len(t) for _, t in kept) < least:
                return 0
            context, target = np.concatenate([c for c, _ in kept], axis=1), np.concatenate([t for _, t in kept])
            kept.clear()
            # neighbours in a text are alike: deal them to different steps
            steps = max(1, len(target) // BATCH, min(STEPS - adam.t, len(target) // LEAST))
            while True:
                for s in range(steps):
                    adam.step(own.flat, own.gradient(context[:, s::steps], target[s::steps]))
                if adam.t >= STEPS:
                    return len(target)

        seen = 0
        for batch in batches:
            mine = np.arange(seen, seen + batch.num_rows) % ROUNDS == round_
            seen += batch.num_rows
            for b in word_blocks(batch.column(0).filter(pa.array(mine))):
                ids = word_ids(b.hashes, top, top_ids)
                kept.append((contexts(b, ids), ids))
                n += learn(16 * BATCH)
        n += learn(1)
        if n:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([own.flat.tobytes()], pa.binary())], names=["part", "n", "weights"]
            )

    return freeze(docs.select("text").mapInArrow(run, "part long, n long, weights binary"))


def _average(rows: DataFrame) -> np.ndarray | None:
    """Mean weights by number of targets, over a tree of groups of FAN_IN rows; None without rows."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        n = group.column("n").to_numpy()
        weights = np.stack([np.frombuffer(w.as_py(), np.float32) for w in group.column("weights")])
        mean = (weights * (n / n.sum())[:, None]).sum(axis=0).astype(np.float32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([int(n.sum())]), "weights": pa.array([mean.tobytes()], pa.binary())})

    while True:
        last = rows.count() <= FAN_IN
        group = F.lit(0).cast("long") if last else F.floor(F.col("part") / FAN_IN).cast("long")
        rows = rows.groupBy(group.alias("group")).applyInArrow(run, "part long, n long, weights binary")
        if last:
            mean = rows.first()
            return None if mean is None else np.frombuffer(mean["weights"], np.float32).copy()
        rows = freeze(rows)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob (sum) and mean_log_prob of every text, by a network trained on
    all of them."""
    picked = id_text(docs, id_col, text_col)
    store = Scratch(docs.sparkSession, "pseudo-likelihood")
    counts = store.keep(count_words(picked))
    trained = train(picked, counts)
    if trained is None:
        return picked.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log_prob"), F.lit(0.0).alias("mean_log_prob"))
    net, top, top_ids = trained
    flat = docs.sparkSession.sparkContext.broadcast(net.flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(flat.value)
        for batch in batches:
            for b in word_blocks(batch.column(2)):
                ids, row = word_ids(b.hashes, top, top_ids), b.word_row()
                sums = np.bincount(row, own.log_probs(contexts(b, ids), ids), b.rows)
                doc = [batch.column(i).slice(b.first, b.rows) for i in (0, 1)]
                yield _rows(*doc, sums, b.counts(), *_rare_words(row[ids >= TOP], b.hashes[ids >= TOP]))

    # one row a document (times 0) and one for each of its distinct rare words
    numbered = picked.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    id_type = picked.schema["doc_id"].dataType.simpleString()
    told = numbered.mapInArrow(run, f"doc_id {id_type}, row long, n_words long, class_log_prob double, hash long, times int")
    met = told.join(log_shares(counts, top), "hash", "left")
    scored = met.groupBy("row").agg(
        F.max(F.struct("n_words", "doc_id")).alias("doc"), F.sum("class_log_prob").alias("class_log_prob"), F.sum(F.col("times") * F.col("log_share")).alias("within")
    )
    words = F.col("doc.n_words")
    total = F.col("class_log_prob") + F.coalesce("within", F.lit(0.0))
    mean = F.when(words > 0, total / words).otherwise(0.0)
    return scored.select("doc.doc_id", words.alias("n_words"), F.round(total, 4).alias("log_prob"), F.round(mean, 6).alias("mean_log_prob"))


def _rare_words(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, occurrences) of the distinct words of every row."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], h[first], np.diff(np.append(first, len(h)))


def _rows(doc_id: pa.Array, row: pa.Array, sums: np.ndarray, sizes: np.ndarray, at: np.ndarray, h: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """The documents, each under a hash that spreads them, and their rare words."""
    docs, words = len(sizes), len(at)
    numbers = row.to_numpy()
    spread = signed(mix(numbers.view(U) + U(1)))
    null = lambda kind: pa.nulls(words, kind)
    cols = [
        pa.concat_arrays([doc_id, null(doc_id.type)]),
        pa.array(np.concatenate([numbers, numbers[at]])),
        pa.concat_arrays([pa.array(sizes.astype(np.int64)), null(pa.int64())]),
        pa.concat_arrays([pa.array(sums.astype(np.float64)), null(pa.float64())]),
        pa.array(np.concatenate([spread, signed(h)])),
        pa.array(np.concatenate([np.zeros(docs, np.int64), times]).astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n_words", "class_log_prob", "hash", "times"])


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, summed and mean conditional log probability."""
    return score(table(spark, sf_dir, "documents"))

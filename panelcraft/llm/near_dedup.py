"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is the multiset of its five-word shingles (a text of fewer words is one shingle);
two texts are near duplicates when their weighted Jaccard similarity, with the counts as
weights, is at least 0.8.

Method (DartMinHash): every (element, weight strip) is a region of the weight x rank plane in
which darts fall as a Poisson process of density 1, seeded by the element, so equal regions of
two documents hold the same darts.  A document of total weight W keeps the darts below its
elements' weights and of rank under ``t / W`` (about ``t = k ln k + 2 k`` darts in all, however
many elements it has), each dart is hashed to one of ``k`` coordinates, and the earliest dart
of a coordinate is its signature value; if a coordinate stays empty, the rank bound is doubled
for that document.  Two signatures agree in a coordinate with probability = similarity.

Banded joining without all pairs: exact copies are collapsed first; texts that share a band
value are a bucket; every member of a bucket is compared (exactly, by its elements) with the
bucket's first ``leaders`` members, which covers all pairs of small buckets.  A larger bucket
whose members are in one component is done.  The members of all other large buckets are
finished by an exact prefix-filter join: two texts that reach the similarity share one of their
rarest elements, early enough in both texts' order from rare to common that what follows can
still reach it.  Only pairs between different components are emitted; they are compared a few
for each two components first, and what then lies in one component needs no comparing.
Classes are the connected components of the verified links.

With 20 bands of 5 rows a pair at similarity 0.8 shares a band with probability 0.9996 (more
above).  A pair that shares a band is always compared, or found to be in one class without.
Pairs between components are quadratic only for texts that share rare elements and lie in
different classes all the same.

Scale: texts are shuffled once (candidates only are shingled a second time); hot copies are
collapsed by partial aggregation; buckets meet their leaders, and rare elements their texts, in
skew-splittable joins;
components are found by label propagation in rounds stored in the shared checkpoint folder;
nothing is collected, and all but the classes are deleted there at the end.

Defined cases: a null text is an empty text; texts without words have no shingles and join
only exact copies of themselves; a class is named by its smallest doc_id (null last, ties by
the text's digest); repeated rows get the same class; extra columns pass through
``drop_near_duplicates`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Scratch, free_name, table
from .words import GRAM, U, WordBlock, mix, signed, word_blocks

WORDS, SIMILARITY, BANDS, ROWS, LEADERS = 5, 0.8, 20, 5, 4
TAKE_ALL = 1024  # above so many pairs of two components, all that are left are compared
STEP, PLACE, COORD, STRIP, COPY = (U(x) for x in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def shingles(b: WordBlock, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of a block, sorted by both; short texts give one."""
    start, h = b.grams(words)
    row = np.searchsorted(b.bounds, start, "right") - 1
    counts = b.counts()
    for k in range(1, words):  # texts of k < words words: all their words are one shingle
        short = np.flatnonzero(counts == k)
        if len(short):
            g = b.hashes[b.bounds[short]].copy()
            for j in range(1, k):
                g = g * GRAM + b.hashes[b.bounds[short] + j]
            row, h = np.concatenate([row, short]), np.concatenate([h, mix(g + U(k))])
    order = np.lexsort((h, row))
    return row[order], h[order]


def _runs(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """First index of every run of equal (row, hash)."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.flatnonzero(new)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """(rows, k) dart ids of weighted sets given as (row, element hash, integer weight >= 1).

    Rows without elements keep zeros.
    """
    total = np.bincount(row, weight, rows)
    out = np.zeros((rows, k), U)
    todo = total > 0
    t = k * math.log(k) + 2 * k
    while todo.any():
        pick = todo[row]
        bound = np.divide(t, total, out=np.zeros(rows), where=total > 0)
        at, rank, dart = _throw(row[pick], element[pick], weight[pick], bound, k)
        best = np.full(rows * k, np.inf)
        np.minimum.at(best, at, rank)
        first = rank == best[at]
        out.reshape(-1)[at[first]] = dart[first]
        todo &= np.isinf(best).reshape(rows, k).any(axis=1)
        t *= 2
    return out


def _throw(row, element, weight, bound, k):
    """(row * k + coordinate, rank, dart id) of the darts under the weights and rank bounds."""
    found = []
    strip, lo, width = 0, 0, 1  # strips [0, 1), [1, 2), [2, 4), [4, 8) ... of the weight axis
    while len(row):
        seed, w, r = mix(element + _times(STRIP, strip + 1)), weight, row
        limit, rank, n = bound[r] * width, np.zeros(len(r)), 0
        while len(r):
            dart = mix(seed + _times(STEP, n + 1))
            rank = rank - np.log1p(-_unit(dart))  # arrivals at rate ``width``: ranks are rank / width
            alive = np.flatnonzero(rank < limit)
            seed, w, r, rank, limit, dart = (x[alive] for x in (seed, w, r, rank, limit, dart))
            if strip:
                under = np.flatnonzero(lo + width * _unit(mix(dart ^ PLACE)) < w)
                got = r[under], rank[under], dart[under]
            else:
                got = r, rank, dart  # every weight is at least 1
            coord = (mix(got[2] ^ COORD) % U(k)).astype(np.int64)
            found.append((got[0] * k + coord, got[1] / width, got[2]))
            n += 1
        strip, lo, width = strip + 1, max(1, lo * 2), max(1, lo * 2)
        taller = weight > lo
        row, element, weight = row[taller], element[taller], weight[taller]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _times(c: np.uint64, n: int) -> np.uint64:
    return U(int(c) * n % (1 << 64))


def _sketch(bands: int, rows: int, words: int):
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = [], []
            for b in word_blocks(batch.column(2)):
                row, h = shingles(b, words)
                first = _runs(row, h)
                weight = np.diff(np.append(first, len(h)))
                sig = dart_signatures(row[first], h[first], weight, b.rows, k).reshape(b.rows, bands, rows)
                fold = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * STEP, (b.rows, bands)).copy()
                for j in range(rows):
                    fold = mix(fold * GRAM + sig[:, :, j])
                any_word = b.counts() > 0
                values.append(signed(fold[any_word].reshape(-1)))
                sizes.append(np.where(any_word, bands, 0))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else [0]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "key", "bands"])

    return run


def _elements(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list = []
            for b in word_blocks(batch.column(1)):
                row, h = shingles(b, words)
                first = _runs(row, h)
                copy = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
                element = (mix(h + COPY * copy.astype(U)) >> U(32)).astype(np.uint32).view(np.int32)
                at = np.searchsorted(row, np.arange(b.rows + 1))
                lists += [np.unique(element[at[i] : at[i + 1]]) for i in range(b.rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["rep", "elements"])

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    leaders: int = LEADERS,
) -> DataFrame:
    """One row per document: doc_id, key (digest of its text), class_id, class_key, kept.

    ``kept`` marks the class's smallest (doc_id, key).
    """
    scratch, result = Scratch(docs.sparkSession, "near-duplicates"), Scratch(docs.sparkSession, "near-duplicate-classes")
    keep = scratch.keep
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.md5(text).alias("key"), text.alias("text"))
    sketch = keep(base.mapInArrow(_sketch(bands, rows, words), f"doc_id {id_type}, key string, bands array<long>"))
    named = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("named")
    reps = sketch.groupBy("key").agg(named, F.first("bands").alias("bands"))
    reps = keep(reps.select(F.monotonically_increasing_id().alias("rep"), "key", F.col("named.doc_id").alias("doc_id"), "bands"))

    members = reps.select("rep", F.explode("bands").alias("bucket"))
    met = keep(members.join(keep(_heads(members, leaders)), "bucket"))
    wanted = met.select("rep").distinct().join(reps, "rep").select("rep", F.col("key").alias("k"), F.col("doc_id").alias("d"))
    texts = base.join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    elements = texts.select("rep", "text").mapInArrow(_elements(words), "rep long, elements array<int>")
    elements = keep(elements.groupBy("rep").agg(F.first("elements").alias("elements")))
    pairs = met.select(F.col("rep").alias("a"), F.explode("leaders").alias("b")).where("b < a").distinct()
    links = keep(_verify(pairs, elements, similarity))
    comps = components(links, keep)
    apart = keep(_apart(met, comps))
    if not apart.isEmpty():
        links = links.unionByName(_close(keep(_candidates(apart, elements, similarity, keep)), elements, similarity, leaders, keep))
        comps = components(links, keep)
    classes = result.keep(_classes(sketch, reps, comps))
    scratch.drop()
    return classes


def _heads(members: DataFrame, leaders: int) -> DataFrame:
    """The first members of every bucket of two or more; ``large`` marks buckets in which pairs
    of members other than with a leader remain."""
    w = Window.partitionBy("bucket").orderBy("rep")
    heads = members.select("bucket", "rep", F.row_number().over(w).alias("rn")).where(F.col("rn") <= leaders + 2)
    heads = heads.groupBy("bucket").agg(F.sort_array(F.collect_list("rep")).alias("first")).where(F.size("first") > 1)
    return heads.select("bucket", F.slice("first", 1, leaders).alias("leaders"), (F.size("first") > leaders + 1).alias("large"))


def _apart(met: DataFrame, comps: DataFrame) -> DataFrame:
    """(rep, comp) of all members of the large buckets that lie in more than one component."""
    large = met.where("large").select("rep", "bucket").join(comps.withColumnRenamed("v", "rep"), "rep", "left")
    large = large.withColumn("comp", F.coalesce("comp", "rep"))
    mixed = large.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
    return large.join(mixed, "bucket").select("rep", "comp").distinct()


def _candidates(apart: DataFrame, elements: DataFrame, similarity: float, keep) -> DataFrame:
    """(a, b, ca, cb, bound): the pairs between components that can reach the similarity.

    Elements are ordered by the number of texts that have them.  Texts that reach the similarity
    share at least ``similarity`` of the larger one's elements, so one of the first others; from
    the first shared one on (``left`` elements), enough must be left in both.
    """
    own = apart.join(elements, "rep")
    rows = own.select("rep", F.explode("elements").alias("element"))
    shared = rows.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    order = rows.join(shared, "element").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("order"))
    size, rest = F.size("elements"), F.size("order")  # elements of one text come first
    first = rest - F.ceil(size * similarity - 1e-9).cast("int") + 1
    cut = own.join(order, "rep").withColumn("first", F.slice("order", F.lit(1), F.greatest(first, F.lit(0))))
    early = cut.select("rep", "comp", size.alias("size"), rest.alias("rest"), F.posexplode("first").alias("at", "e"))
    early = keep(early.select("rep", "comp", "size", (F.col("rest") - F.col("at")).alias("left"), F.col("e.element").alias("element")))
    # of two texts in different components, one at least is not in the element's largest component
    held = early.groupBy("element", "comp").count().groupBy("element")
    held = held.agg(F.max_by("comp", F.struct("count", "comp")).alias("major"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    early = keep(early.join(held, "element"))
    x, y = early.where("comp <> major").alias("x"), early.alias("y")
    bound = F.least("x.left", "y.left") - (F.col("x.size") + F.col("y.size")) * (similarity / (1 + similarity))
    can = (F.col("x.element") == F.col("y.element")) & (F.col("x.comp") != F.col("y.comp"))
    can &= (F.col("y.comp") == F.col("y.major")) | (F.col("y.rep") < F.col("x.rep"))
    can &= (F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * similarity - 1e-6) & (bound >= -1e-6)
    ends = [F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")]
    between = [F.least("x.comp", "y.comp").alias("ca"), F.greatest("x.comp", "y.comp").alias("cb")]
    return x.join(y, can).select(*ends, *between, bound.alias("bound")).groupBy("a", "b", "ca", "cb").agg(F.max("bound").alias("bound"))


def _close(pairs: DataFrame, elements: DataFrame, similarity: float, take: int, keep) -> DataFrame:
    """The links among the pairs that are needed for their components.

    Of every two components the ``take`` likeliest pairs are compared, then more, then all that
    are left; pairs whose components have been united meanwhile are not compared.
    """
    found = None
    w = Window.partitionBy("ca", "cb").orderBy(F.desc("bound"), "a", "b")
    while True:
        last = take > TAKE_ALL
        now = pairs if last else keep(pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= take).drop("rn"))
        verified = keep(_verify(now.select("a", "b"), elements, similarity))
        found = verified if found is None else found.unionByName(verified)
        if last:
            return found
        united = verified.join(now, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        united = components(united, keep)
        pairs = pairs.join(now.select("a", "b"), ["a", "b"], "left_anti")
        for c in ("ca", "cb"):
            new = united.select(F.col("v").alias(c), F.col("comp").alias("new"))
            pairs = pairs.join(new, c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        between = [F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")]
        pairs = keep(pairs.where("ca <> cb").select("a", "b", *between, "bound"))
        if pairs.isEmpty():
            return found
        take *= 16


def _verify(pairs: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    a = elements.select(F.col("rep").alias("a"), F.col("elements").alias("ea"))
    b = elements.select(F.col("rep").alias("b"), F.col("elements").alias("eb"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("ea", "eb"))
    return both.where(common >= similarity * (F.size("ea") + F.size("eb") - common)).select("a", "b")


def components(links: DataFrame, keep) -> DataFrame:
    """(v, comp): the smallest vertex of every vertex's connected component.

    Rounds of least label among the neighbours followed by one pointer jump, each round
    stored by ``keep``; the number of rounds grows with the logarithm of the longest chain.
    """
    edges = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(edges.groupBy(F.col("a").alias("v")).agg(F.least("a", F.min("b")).alias("comp")))
    while True:
        near = edges.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "v").select("v", F.col("comp").alias("old"), F.least("comp", "near").alias("c"))
        jump = least.join(labels.select(F.col("v").alias("c"), F.col("comp").alias("up")), "c")
        new = keep(jump.select("v", F.least("c", "up").alias("comp"), (F.least("c", "up") < F.col("old")).alias("moved")))
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels


def _classes(sketch: DataFrame, reps: DataFrame, comps: DataFrame) -> DataFrame:
    placed = reps.drop("bands").join(comps.withColumnRenamed("v", "rep"), "rep", "left")
    placed = placed.select("key", "doc_id", F.coalesce("comp", "rep").alias("comp"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("head")
    heads = placed.groupBy("comp").agg(head)
    named = placed.drop("doc_id").join(heads, "comp").select("key", "head")
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("key") == F.col("head.key"))
    return sketch.drop("bands").join(named, "key").select(
        "doc_id", "key", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("class_key"), kept.alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without all but one of every class (its smallest doc_id)."""
    classes = near_duplicates(docs, id_col, text_col, **options)
    kept = classes.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    on = F.col(id_col).eqNullSafe(F.col("kept_id")) & (F.col(key) == F.col("kept_key"))
    out = keyed.join(kept, on, "left_semi")
    if not kept.groupBy("kept_id", "kept_key").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, key])  # rows that repeat both the id and the text
    return out.drop(key)


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its near-duplicate class (smallest doc_id) and whether it is the one kept."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")

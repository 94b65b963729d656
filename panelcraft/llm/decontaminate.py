"""Benchmark decontamination by a broadcast hash set of the test items' word n-grams.

Method: the benchmark's normalised n-grams (items of fewer words form one shorter window)
become a sorted array of 64-bit hashes with the windows' words; every document's windows are
rolled and looked up in it, each hash hit is verified word by word, and the words covered by
verified hits are removed as spans, or their documents dropped.

Scale: one pass over the documents, no shuffle of texts.  The benchmark's different windows are
counted first; while they exceed ``block_windows`` they are processed in blocks of that many
by hash range (one scan per block, hit ranges united per document), so what is broadcast has a
fixed bound whatever the benchmark's size and however many items share a window.  Which items a
window belongs to stays in Spark: where items are asked for, the windows found in a document meet
them in a join.

Defined cases: a null or empty text has no words and is never hit; a null or word-less item
has no window; repeated items count once per item_id (a null item_id is named ``null``);
repeated documents are reported once per row; items are listed in the order of their ids as
strings; a very long text is a block of its own; other columns, also of clashing names, pass through
untouched in ``remove_documents``/``remove_spans``; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import freeze
from .tables import free_name, table
from .words import U, word_blocks, words_hash

N = 10
BLOCK_WINDOWS = 200_000  # about 50 MB in a task: hashes and window texts
WINDOW_SCHEMA = "n int, hash long, check long, words binary, item_id string"
WINDOW_ID = ["n", "hash", "check"]  # the words' number and two hashes of them
RANGE_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
FOUND_TYPE = pa.list_(pa.struct([("n", pa.int32()), ("hash", pa.int64()), ("check", pa.int64())]))
SCAN_ARROW = pa.struct([("n_words", pa.int64()), ("hits", RANGE_TYPE), ("windows", FOUND_TYPE)])
SCAN_TYPE = "struct<n_words: long, hits: array<struct<start: int, stop: int>>, windows: array<struct<n: int, hash: long, check: long>>>"


def item_windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct (window, item): its length in words, hash and folded words."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: set[tuple] = set()
            for b in word_blocks(batch.column(1)):
                for r in range(b.rows):
                    lo, hi = int(b.bounds[r]), int(b.bounds[r + 1])
                    k = min(n, hi - lo)
                    words = [b.word(i) for i in range(lo, hi)]
                    for i in range(hi - lo - k + 1 if k else 0):
                        rows.add((k, b" ".join(words[i : i + k]), ids[b.first + r]))
            if rows:
                k, words, items = zip(*sorted(rows, key=str), strict=True)
                hashes, checks = [signed64(words_hash(w)) for w in words], [check_hash(w) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int32()), pa.array(hashes, pa.int64()), pa.array(checks, pa.int64()), pa.array(words, pa.binary()), pa.array(items, pa.string())],
                    names=["n", "hash", "check", "words", "item_id"],
                )

    picked = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")))
    return picked.mapInArrow(windows, WINDOW_SCHEMA).distinct()


def check_hash(words: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)


def signed64(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class _WindowSet:
    """Windows of one block, looked up by (length, hash) and verified by their words."""

    def __init__(self, rows: list[tuple[int, int, bytes]]) -> None:
        by_hash: dict[tuple[int, int], set[bytes]] = {}
        for n, h, words in rows:
            by_hash.setdefault((n, h % (1 << 64)), set()).add(words)
        self.by_hash = by_hash
        self.sorted = {k: np.sort(np.array([h for n, h in by_hash if n == k], U)) for k in {n for n, _ in by_hash}}

    def find(self, b, k: int) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """(start word, window id) of every verified window of k words in the block."""
        known = self.sorted[k]
        start, h = b.grams(k)
        at = np.searchsorted(known, h)
        for i in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h):
            w = int(start[i])
            words = b.words(w, w + k)
            if words in self.by_hash[k, int(h[i])]:
                yield w, (k, signed64(int(h[i])), check_hash(words))


def scan(docs: DataFrame, windows: DataFrame, out: str, text_col: str, keep_text: bool = True) -> DataFrame:
    """Add ``out`` (n_words, hits as merged word ranges, ids of the windows) for one block of windows."""
    rows = [(r["n"], r["hash"], bytes(r["words"])) for r in windows.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    kept = [c for c in docs.columns if keep_text or c != text_col]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _WindowSet(shared.value)
        for batch in batches:
            got: list[dict] = []
            for b in word_blocks(batch.column(text_col)):
                hits: list[dict[int, int]] = [{} for _ in range(b.rows)]
                seen: list[set] = [set() for _ in range(b.rows)]
                for k in index.sorted:
                    for w, found in index.find(b, k):
                        r = int(np.searchsorted(b.bounds, w, "right")) - 1
                        at = w - int(b.bounds[r])
                        hits[r][at] = max(hits[r].get(at, 0), at + k)
                        seen[r].add(found)
                for n_words, h, i in zip(b.counts().tolist(), hits, seen, strict=True):
                    windows = [dict(zip(WINDOW_ID, x, strict=True)) for x in sorted(i)]
                    got.append({"n_words": n_words, "hits": merge_ranges(sorted(h.items())), "windows": windows})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(got, SCAN_ARROW)], names=[*kept, out])

    schema = T.StructType([*docs.select(kept).schema.fields, T.StructField(out, T._parse_datatype_string(SCAN_TYPE))])
    return docs.mapInArrow(find, schema)


def merge_ranges(ranges: list[tuple[int, int]]) -> list[dict]:
    """Sorted half-open ranges united where they meet or overlap."""
    out: list[dict] = []
    for start, stop in ranges:
        if out and start <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], stop)
        else:
            out.append({"start": start, "stop": stop})
    return out


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    out: str,
    n: int = N,
    block_windows: int = BLOCK_WINDOWS,
    text_col: str = "text",
    keep_text: bool = True,
    items: bool = True,
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, hits (merged word ranges) and, unless they are
    not wanted, items."""
    windows = freeze(item_windows(benchmark, n))
    different = windows.select("n", "hash", "words").distinct()
    blocks = max(1, -(-different.count() // block_windows))
    # blocks by hash range: each block is collected, broadcast and scanned by itself
    names = [f"{out}{b}" for b in range(blocks)]
    for b, name in enumerate(names):
        block = different.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == b)
        docs = scan(docs, block, name, text_col, keep_text or b + 1 < blocks)
    if blocks == 1:
        found = docs.withColumnRenamed(names[0], out)
    else:
        united = F.sort_array(F.flatten(F.array(*[F.col(c)["hits"] for c in names])))
        merged = F.aggregate(united, F.expr("cast(array() as array<struct<start: int, stop: int>>)"), _join_range)
        each = F.flatten(F.array(*[F.col(c)["windows"] for c in names]))  # a window is in one block
        found = docs.withColumn(out, F.struct(F.col(names[0])["n_words"].alias("n_words"), merged.alias("hits"), each.alias("windows"))).drop(*names)
    return _with_items(found, windows, out) if items else found


def _with_items(found: DataFrame, windows: DataFrame, out: str) -> DataFrame:
    """The ids of the windows in ``out`` replaced by the distinct, sorted items that have them.

    A document goes along with one row of its own, whose key meets nothing, so it is read once."""
    cols = [c for c in found.columns if c != out]
    own = F.struct(F.lit(0).alias("n"), F.xxhash64("row").alias("hash"), F.lit(0).cast("long").alias("check"))
    told = found.select(F.monotonically_increasing_id().alias("row"), F.struct(*cols).alias("doc"), F.col(out).alias("scan"))
    each = told.select("row", "doc", "scan", F.posexplode(F.concat(F.array(own), "scan.windows")).alias("i", "w"))
    each = each.select("row", F.when(F.col("i") == 0, F.struct("doc", "scan")).alias("kept"), *[F.col(f"w.{c}") for c in WINDOW_ID])
    met = each.join(windows.select(*WINDOW_ID, "item_id"), WINDOW_ID, "left")
    rows = met.groupBy("row").agg(F.first("kept", ignorenulls=True).alias("kept"), F.array_sort(F.collect_set("item_id")).alias("items"))
    scan_ = F.struct(F.col("kept.scan.n_words").alias("n_words"), F.col("kept.scan.hits").alias("hits"), F.col("items"))
    return rows.select(*[F.col("kept.doc")[c].alias(c) for c in cols], scan_.alias(out))


def _join_range(acc, x):
    last = F.try_element_at(acc, F.lit(-1))
    joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
    return F.when(
        last["stop"] >= x["start"], F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))
    ).otherwise(F.concat(acc, F.array(x)))


def hit_words(out: str):
    return F.aggregate(F.col(out)["hits"], F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, max_hit_share: float = 0.0, text_col: str = "text") -> DataFrame:
    """Drop the documents of which more than ``max_hit_share`` of the words are hit."""
    out = free_name(docs, "benchmark_scan")
    found = find_benchmark(docs, benchmark, out, n, text_col=text_col, items=False)
    return found.where(hit_words(out) <= F.col(out)["n_words"] * F.lit(max_hit_share)).drop(out)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text") -> DataFrame:
    """Cut the hit words (with what stands between them) out of the texts."""
    out = free_name(docs, "benchmark_scan")
    found = find_benchmark(docs, benchmark, out, n, text_col=text_col, items=False)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(text_col), batch.column(out).field("hits").to_pylist()
            new: list = []
            for b in word_blocks(texts):
                for r in range(b.rows):
                    text = texts[b.first + r].as_py()
                    if spans[b.first + r]:
                        raw, first, zero = text.encode(), int(b.bounds[r]), int(b.offsets[r])
                        parts, last = [], 0
                        for s in spans[b.first + r]:
                            parts.append(raw[last : int(b.starts[first + s["start"]]) - zero])
                            last = int(b.ends[first + s["stop"] - 1]) - zero
                        text = (b"".join(parts) + raw[last:]).decode()
                    new.append(text)
            names = [c for c in batch.schema.names if c != out]
            columns = [pa.array(new, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(cut, docs.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, hit words and the benchmark items whose windows occur in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"), "scan", keep_text=False)
    return found.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        hit_words("scan").alias("n_hit"),
        F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("scan.items", ","), 256).alias("items_sha256"),
        (hit_words("scan") > 0).alias("contaminated"),
    )

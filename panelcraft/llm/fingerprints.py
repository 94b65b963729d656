"""Document fingerprints by content-defined chunking.

Method: a gear hash rolls over the UTF-8 bytes of a text (every byte adds a table value to the
hash shifted left by one, so the hash depends on the last 32 bytes); a chunk ends where the
hash has enough zero bits, more of them before the normal size and fewer after it (normalised
chunking), between a least and a largest size.  Boundaries depend on content, so an insertion
changes the chunks near it only.  The fingerprint is the sorted list ``digest:length[*count]``
of the different chunks; the likeness of one fingerprint to another is the share of its length
whose chunks the other contains.

Neighbours: ``with_next`` gives every text the next one in the order of doc_id (of any ordered type)
without a global sort in one task: ranges of doc_id from a sample of the ids, one shuffle of the
texts, and the first row of every range handed to the range before it.  An id that holds several
ranges' worth of rows is cut further, by the beginnings of its texts.

Scale: one shuffle of the texts, streamed within sorted partitions; what reaches the driver is
a bounded sample of ids (and of the ``PREFIX`` first characters of a hot id's texts) and the first
id of every range.

Defined cases: a null text is empty, an empty text has the empty fingerprint, which is like
another empty one only (1) and like no other (0); a null doc_id sorts first, rows of equal
doc_id by text (so of repeated rows each is the next of the one before); the only row of a table
is its own next; a very long text is held by one task; extra columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .tables import id_text, table
from .words import U, mix

LEAST, NORMAL, LARGEST = 16, 64, 256
STRICT_BITS, LOOSE_BITS = 7, 5
RANGES, SAMPLED, PREFIX = 4096, 8, 256
#: Gear table by rule: the upper half of the mixed byte value.
GEAR = (mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32)


def cut_points(data: np.ndarray) -> list[int]:
    """Chunk ends of a byte array (normalised gear-hash boundaries)."""
    n = len(data)
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):  # h over the last 2 * shift bytes from h over the last shift
        rolled = h.copy()
        rolled[shift:] += h[:-shift] << np.uint32(shift)
        h = rolled
    zeros = h >> np.uint32(32 - LOOSE_BITS) == 0
    loose = np.flatnonzero(zeros)
    strict = loose[h[loose] >> np.uint32(32 - STRICT_BITS) == 0]
    loose, strict = (loose + 1).tolist(), (strict + 1).tolist()
    ends, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        first, middle, last = at + LEAST, at + NORMAL, min(at + LARGEST, n)
        while j < len(strict) and strict[j] < first:
            j += 1
        if j < len(strict) and strict[j] <= middle and strict[j] <= last:
            at = strict[j]
        else:
            while i < len(loose) and loose[i] <= middle:
                i += 1
            at = loose[i] if i < len(loose) and loose[i] <= last else last
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(text: str) -> dict[str, tuple[int, int]]:
    """digest -> (length, count) of the chunks of a text."""
    raw = text.encode()
    out: dict[str, tuple[int, int]] = {}
    at = 0
    for end in cut_points(np.frombuffer(raw, np.uint8)):
        digest = xxhash.xxh32_hexdigest(raw[at:end])
        out[digest] = (end - at, out[digest][1] + 1 if digest in out else 1)
        at = end
    return out


def written(fp: dict[str, tuple[int, int]]) -> str:
    return ",".join(f"{d}:{n}" if c == 1 else f"{d}:{n}*{c}" for d, (n, c) in sorted(fp.items()))


def likeness(fp: dict[str, tuple[int, int]], other: dict[str, tuple[int, int]]) -> float:
    """The share of ``fp``'s length whose chunks are in ``other``."""
    total = sum(n * c for n, c in fp.values())
    if not total:
        return float(not other)
    return sum(n * min(c, other[d][1]) for d, (n, c) in fp.items() if d in other) / total


def edited_text(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much (or all) of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _bounds(base: DataFrame, ranges: int) -> list[tuple]:
    """Sorted first places (named, doc_id, beginning of the text) of all ranges but the first."""
    share = min(1.0, SAMPLED * ranges / max(1, base.count()))
    ids = sorted((x is not None, x) for x in base.select("doc_id").sample(share, seed=7).toArrow().column(0).to_pylist())
    picks = Counter(ids[len(ids) * i // ranges] for i in range(1, ranges) if ids)
    hot = [i[1] for i, n in picks.items() if n > 1]
    out = {(*i, "") for i in picks}
    if hot:
        mine = F.col("doc_id").isin([x for x in hot if x is not None])
        mine = mine | F.col("doc_id").isNull() if None in hot else mine
        got = base.where(mine).select("doc_id", F.left("text", F.lit(PREFIX)).alias("begins")).sample(share, seed=8).toArrow()
        texts = defaultdict(list)
        for x, begins in zip(*(c.to_pylist() for c in got.columns), strict=True):
            texts[x is not None, x].append(begins)
        for i, each in texts.items():
            each.sort()
            out |= {(*i, each[len(each) * k // picks[i]]) for k in range(1, picks[i])}
    return sorted(out)


def ranged(docs: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(bucket, guest, doc_id, text): the rows of every range of doc_id, and as ``guest`` the
    first row of the range after it (of the first range, after the last one)."""
    base = id_text(docs)
    bounds = _bounds(base, ranges)
    cut = [b[1] for b in bounds if b[2]]
    begins = F.when(F.col("doc_id").isNull() | F.col("doc_id").isin([x for x in cut if x is not None]), F.left("text", F.lit(PREFIX))).otherwise("")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            found = [bisect_right(bounds, (x is not None, x, b)) for x, b in keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], names=["doc_id", "text", "bucket"])

    rows = base.select("doc_id", "text", begins.alias("begins")).mapInArrow(place, f"doc_id {id_type}, text string, bucket int")
    order = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")
    firsts = sorted((r.bucket, r.doc_id) for r in rows.groupBy("bucket").agg(F.min(order).alias("o")).select("bucket", "o.doc_id").collect())
    # at most a few rows a range: the driver only pairs each range with the one before it
    guests = [(b, d, firsts[i - 1][0]) for i, (b, d) in enumerate(firsts)]
    named = docs.sparkSession.createDataFrame(guests, f"b int, d {id_type}, host int")
    same = (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d"))
    heads = rows.join(F.broadcast(named), same).groupBy("host", "doc_id").agg(F.min("text").alias("text"))
    hosted = heads.select("doc_id", "text", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    return rows.withColumn("guest", F.lit(False)).unionByName(hosted)


def with_next(docs: DataFrame, prepare, finish, schema: str) -> DataFrame:
    """``finish(own, next)`` of every row in ascending doc_id, of what ``prepare(doc_id, text)``
    makes of a row and of the one after it."""
    arranged = ranged(docs).repartition("bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            out = []
            columns = [batch.column(c) for c in ("guest", "doc_id", "text")]
            for guest, doc_id, text in zip(*columns, strict=True):
                now = prepare(doc_id.as_py(), text.as_py())
                if waiting is not None:
                    out.append(finish(waiting, now))
                waiting = None if guest.as_py() else now
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return arranged.select("guest", "doc_id", "text").mapInArrow(run, schema)


def _prepare(doc_id, text: str) -> tuple:
    return doc_id, text, chunks(text)


def _finish(row: tuple, following: tuple) -> dict:
    doc_id, text, fp = row
    edited = edited_text(text, following[1])
    efp = chunks(edited)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": written(fp),
        "edited_fingerprint": written(efp),
        "near_edited": likeness(fp, efp),
        "near_next": likeness(fp, following[2]),
    }


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every text."""
    picked = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [written(chunks(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likenesses."""
    docs = table(spark, sf_dir, "documents")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, _prepare, _finish, schema)

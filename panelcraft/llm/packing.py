"""Packing tokenized documents into sequences: bounded-space online best fit.

Method: every partition keeps a fixed number of open windows of 1024 tokens.  Whole windows of
a long document are sequences at once; a remainder goes into the open window that it fills
best, or opens one while fewer than ``open_windows`` are open; when none fits, the fullest
open window is topped up with a cut of the remainder and emitted without padding.  What the
partitions leave open is merged afterwards: rounds of ``FAN_IN`` partitions' leftovers are
packed again the same way, and the last round lays its rest end to end and ends with
power-of-two sequences, so nothing is padded.

Token ids are those of the named ``tokenizers`` file (byte-level BPE).  Its ranks drive the
``tiktoken`` encoder, which gives the same ids several times faster (compared over every code
point in the tests); a text that contains one of the file's special strings goes through
``tokenizers`` itself.

Scale: one pass over the texts and no shuffle of them; a leftover row holds at most
``open_windows`` windows, a merge task at most FAN_IN such rows.  Pieces carry their ids as
unsigned little-endian 32-bit binary.

Defined cases: a null or empty text is the single end id; repeated rows and ids are packed
row by row; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import freeze
from .tables import table

WINDOW, OPEN_WINDOWS, FAN_IN, END_ID = 1024, 16, 32, 0
#: The pattern that splits a text before the merges (fixed value of the tokenizer).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENCODE_BYTES = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def load_encoder(path: str):
    """text -> uint32 ids, as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, special = spec["model"]["vocab"], [t["content"] for t in spec["added_tokens"]]
    exact = Tokenizer.from_file(path)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(shifted)}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
    fast = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    return encode


class _Piece:
    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id, start, ids, doc_tokens):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), _Piece(
            self.doc_id, self.start + n, self.ids[n:], self.doc_tokens
        )


class Packer:
    """Open windows of one task; ``emit(list of pieces)`` receives every finished sequence."""

    def __init__(self, window: int, open_windows: int, emit) -> None:
        self.window, self.limit, self.emit = window, open_windows, emit
        self.windows: list[list[_Piece]] = []
        self.room: list[int] = []

    def add(self, piece: _Piece) -> None:
        while len(piece.ids) >= self.window:
            whole, piece = piece.cut(self.window)
            self.emit([whole])
        while len(piece.ids):
            n = len(piece.ids)
            fits = [(r, i) for i, r in enumerate(self.room) if r >= n]
            if fits:
                self._put(min(fits)[1], piece)
                return
            if len(self.windows) < self.limit:
                self.windows.append([piece])
                self.room.append(self.window - n)
                return
            room, i = min((r, i) for i, r in enumerate(self.room))
            head, piece = piece.cut(room)  # none fits: room < n
            self._put(i, head)

    def _put(self, i: int, piece: _Piece) -> None:
        self.windows[i].append(piece)
        self.room[i] -= len(piece.ids)
        if self.room[i] == 0:
            self.emit(self.windows.pop(i))
            self.room.pop(i)

    def flush(self) -> None:
        """Lay the open windows end to end; the rest becomes power-of-two sequences."""
        rest = [p for _, w in sorted(zip(self.room, range(len(self.room)), strict=True)) for p in self.windows[w]]
        left = sum(len(p.ids) for p in rest)
        while left:
            size = min(self.window, 1 << int(math.log2(left)))
            take, out = size, []
            while take:
                head, tail = rest[0].cut(take) if len(rest[0].ids) > take else (rest[0], None)
                out.append(head)
                take -= len(head.ids)
                rest[:1] = [tail] if tail else []
            self.emit(out)
            left -= size
        self.windows, self.room = [], []


def _piece_type(id_type: pa.DataType) -> list[tuple[str, pa.DataType]]:
    return [("doc_id", id_type), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]


def _schema(id_type: pa.DataType) -> pa.Schema:
    open_type = pa.list_(pa.struct([*_piece_type(id_type), ("slot", pa.int32())]))
    fields = [*_piece_type(id_type), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    return pa.schema([*fields, ("part", pa.int64()), ("open", open_type)])


def _sql(id_type: str) -> str:
    piece = f"doc_id: {id_type}, start: bigint, ids: binary, doc_tokens: bigint"
    return (
        f"doc_id {id_type}, start bigint, ids binary, doc_tokens bigint, length bigint, sequence_id bigint, "
        f"offset bigint, part bigint, open array<struct<{piece}, slot: int>>"
    )


class _Out:
    """Rows of finished sequences; sequence ids are (round, task, count) in 8, 24 and 31 bits."""

    def __init__(self, schema: pa.Schema, round_: int, part: int) -> None:
        self.schema, self.part, self.base, self.n = schema, part, (round_ << 55) | (part << 31), 0
        self.rows: list[dict] = []

    def emit(self, pieces: list[_Piece]) -> None:
        offset, sequence = 0, self.base | self.n
        for p in pieces:
            self.rows.append(
                {"doc_id": p.doc_id, "start": p.start, "ids": p.ids.tobytes(), "doc_tokens": p.doc_tokens, "length": len(p.ids)}
                | {"sequence_id": sequence, "offset": offset}
            )
            offset += len(p.ids)
        self.n += 1

    def leave_open(self, packer: Packer) -> None:
        left = [
            {"doc_id": p.doc_id, "start": p.start, "ids": p.ids.tobytes(), "doc_tokens": p.doc_tokens, "slot": i}
            for i, w in enumerate(packer.windows)
            for p in w
        ]
        if left:
            self.rows.append({"part": self.part, "open": left})

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist(rows, schema=self.schema)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of the packed documents: doc_id, start, ids (binary), doc_tokens, length,
    sequence_id and offset in the sequence (gapless from 0)."""
    path = tokenizer or default_tokenizer()
    id_type = docs.schema[id_col].dataType
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, packer = load_encoder(path), None, None
        for batch in batches:
            if out is None:
                out = _Out(_schema(batch.schema.field(0).type), 0, TaskContext.get().partitionId())
                packer = Packer(window, open_windows, out.emit)
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4", copy=False)
                packer.add(_Piece(doc_id, 0, ids, len(ids)))
                size += len(text)
                if size >= ENCODE_BYTES:
                    yield out.take()
                    size = 0
            yield out.take()
        if out is not None:
            out.leave_open(packer)
            yield out.take()

    sql = _sql(id_type.simpleString())
    packed = freeze(picked.mapInArrow(run, sql))
    done, left = [packed.where("open is null")], packed.where("open is not null").select("part", "open")
    parts, round_ = left.count(), 0
    while parts:
        round_, last = round_ + 1, parts <= FAN_IN
        merged = freeze(_merge(left, window, open_windows, round_, last, sql))
        done.append(merged.where("open is null"))
        left = merged.where("open is not null").select("part", "open")
        parts = 0 if last else left.count()
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.drop("part", "open")


def _merge(left: DataFrame, window: int, open_windows: int, round_: int, last: bool, sql: str) -> DataFrame:
    """Pack the leftovers of every FAN_IN neighbouring partitions again (all of them, if last)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        schema = _schema(rows.schema.field("open").type.value_type.field("doc_id").type)
        out = _Out(schema, round_, key[0].as_py())
        packer = Packer(window, open_windows, out.emit)
        slots: list[list[_Piece]] = []
        for opened in rows.column("open").to_pylist():
            own: dict[int, list[_Piece]] = {}
            for p in opened:
                ids = np.frombuffer(p["ids"], "<u4")
                own.setdefault(p["slot"], []).append(_Piece(p["doc_id"], p["start"], ids, p["doc_tokens"]))
            slots += own.values()
        for slot in sorted(slots, key=lambda s: -sum(len(p.ids) for p in s)):
            for piece in slot:
                packer.add(piece)
        if last:
            packer.flush()
        else:
            out.leave_open(packer)
        return pa.Table.from_batches([out.take()])

    group = F.lit(0).cast("bigint") if last else F.floor(F.col("part") / FAN_IN).cast("bigint")
    return left.groupBy(group.alias("group")).applyInArrow(run, sql)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: where it lies in its document and in its sequence, with a digest of its ids."""
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""Chat formatting as prefix trees of conversations.

Method: a conversation is a path of turns; conversations that share their first turns share
those nodes.  The tree is emitted depth first: every node's tokens once per shard, with its place
in the shard's stream, the position ids' start (the length of its ancestors) and the stream
intervals of its ancestors, which are all that it may attend to before itself.  All of these are
given in tokens (``ids``, ``token_start``, ``token_position``, ``token_ancestors``) and in code points of the
formatted text, which the read-back uses.

Template: ``### role: text</turn>\\n``.  Inside a role or text, every
``\\``, ``<``, ``#`` and ``:`` is preceded by a backslash, so no text can contain a mark, and
removing the backslashes restores it.  Loss is on the texts of ``assistant`` turns.  Every turn is
tokenized by itself: the marks are fixed borders, so equal turns have equal ids wherever they stand.

Distribution: a turn is a row throughout.  Turns are numbered within their conversation across
tasks; digests of the growing prefixes are running exclusive-ors of turn digests (two of 64 bits),
taken in blocks of ``BLOCK`` turns and joined from block to block.  A conversation's path, by which
conversations are range-partitioned and sorted, has the prefix digests of its first ``DEEP`` turns and
of the turns at the powers of two, so it is short however long the conversation.  Each partition
is a shard that is streamed and emitted by itself: no conversation is held in memory, though all
turns of one pass through one task, which sorts them on disk (its digest of all turns asks for that).
A popular first turn or conversation is split between shards by conv_id and emitted once in each, so
no task holds a whole tree; turns shared beyond the first ``DEEP`` may be emitted once more.

Defined cases: turns in order of turn (null first), ties by role and text; a null text or role
is empty; a null conv_id is a conversation of its own; repeated rows are repeated turns; a very
long text is one turn of one task; extra columns are not read; an empty table gives no node.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.numbering import number_within
from .packing import default_tokenizer, load_encoder
from .tables import table

LOSS_ROLE = "assistant"
ESCAPED = re.compile(r"([\\<#:])")
TURN = re.compile(r"### ((?:[^\\<#:]|\\.)*+): ((?:[^\\<#:]|\\.)*+)</turn>\n", re.DOTALL)
SPANS = "array<struct<start: long, stop: long>>"
NODE = (
    f"shard long, seq long, depth int, text string, stream_start long, position_start long, ancestors {SPANS}, loss_start int, loss_stop int, "
    f"ids array<int>, token_start long, token_position long, token_ancestors {SPANS}"
)
ROWS_A_BATCH, BLOCK, DEEP = 500, 65_536, 64


def escape(s: str) -> str:
    return ESCAPED.sub(r"\\\1", s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and stop of its text)."""
    head = f"### {escape(role)}: "
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text, p1, p2): the numbered turns with the digests of the prefixes that
    end with them."""
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = number_within(plain, ["conv_id"], ["turn", "role", "text"], rn="depth", size=None)
    depth = F.col("depth") - 1
    told = numbered.select(
        "conv_id", depth.alias("depth"), "role", "text", F.floor(depth / BLOCK).alias("block"),
        F.xxhash64(depth, "role", "text").alias("d1"), F.xxhash64("text", F.lit(1), "role", depth).alias("d2"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = told.withColumns({"p1": F.bit_xor("d1").over(inside), "p2": F.bit_xor("d2").over(inside)})
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = told.groupBy("conv_id", "block").agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.bit_xor("d1").over(earlier).alias("b1"), F.bit_xor("d2").over(earlier).alias("b2"))
    met = running.join(blocks.where("b > 0"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    both = [F.col(p).bitwiseXOR(F.coalesce(q, F.lit(0))).alias(p) for p, q in (("p1", "b1"), ("p2", "b2"))]
    return met.select("conv_id", "depth", "role", "text", *both)


def paths_of(turns: DataFrame) -> DataFrame:
    """(c, path): per conversation the prefix digests of its first turns and of those at powers of two."""
    chosen = turns.where((F.col("depth") < DEEP) | (F.col("depth").bitwiseAND(F.col("depth") - 1) == 0))
    return chosen.groupBy(F.col("conv_id").alias("c")).agg(F.sort_array(F.collect_list(F.struct("depth", "p1", "p2"))).alias("path"))


class _Stream:
    """Places in one stream of the open path's nodes, in one unit."""

    def __init__(self) -> None:
        self.end = 0
        self.nodes: list[tuple[int, int, int]] = []  # (stop in the stream, length of the path, runs of the path)
        self.runs: list[list[int]] = []  # intervals of the path, united where they meet

    def cut(self, depth: int) -> None:
        if depth < len(self.nodes):
            del self.nodes[depth:]
            del self.runs[self.nodes[-1][2] if self.nodes else 0 :]
            if self.nodes:
                self.runs[-1][1] = self.nodes[-1][0]

    def push(self, size: int) -> tuple[int, int, list[dict]]:
        """(start in the stream, length before, ancestors' intervals) of a node that is appended."""
        ancestors = [{"start": a, "stop": b} for a, b in self.runs]
        start, before = self.end, self.nodes[-1][1] if self.nodes else 0
        self.end += size
        if self.runs and self.runs[-1][1] == start:
            self.runs[-1][1] = self.end
        else:
            self.runs.append([start, self.end])
        self.nodes.append((self.end, before + size, len(self.runs)))
        return start, before, ancestors


def prefix_tree(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Nodes in depth-first order per shard, each followed by one row per conversation that
    ends there (``conv_id`` set, text null).  Order: shard, seq.  ``tokenizer``: a ``tokenizers`` file."""
    id_type = rows.schema["conv_id"].dataType
    path = tokenizer or default_tokenizer()
    turns = turns_of(rows)
    arranged = turns.join(paths_of(turns), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    arranged = arranged.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id", "depth")
    schema = T.StructType([*T._parse_datatype_string(NODE).fields, T.StructField("ended", T.BooleanType()), T.StructField("conv_id", id_type)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(path)
        shard, seq = TaskContext.get().partitionId(), 0
        chars, tokens = _Stream(), _Stream()
        open_: list[tuple[int, int]] = []  # prefix digests of the open path
        held: list = []  # conv_id of the conversation that is being read
        shared, out = True, []

        def end(depth: int) -> None:
            nonlocal seq
            for stream in (chars, tokens):
                stream.cut(depth)
            del open_[depth:]
            out.append({"shard": shard, "seq": seq, "depth": depth - 1, "ended": True, "conv_id": held.pop()})
            seq += 1

        length = 0
        for batch in batches:
            for conv_id, depth, role, said, *digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = tuple(digest)
                if depth == 0:
                    if held:
                        end(length)
                    held, shared = [conv_id], True
                length = depth + 1
                if shared and depth < len(open_) and open_[depth] == digest:
                    continue
                if shared:
                    shared = False
                    del open_[depth:]
                    for stream in (chars, tokens):
                        stream.cut(depth)
                text, start, stop = format_turn(role, said)
                ids = encode(text).tolist()
                stream_start, before, ancestors = chars.push(len(text))
                token_start, token_before, token_ancestors = tokens.push(len(ids))
                open_.append(digest)
                out.append(
                    {"shard": shard, "seq": seq, "depth": depth, "text": text, "stream_start": stream_start, "position_start": before}
                    | {"ancestors": ancestors, "ids": ids, "token_start": token_start, "token_position": token_before, "token_ancestors": token_ancestors}
                    | {"ended": False}
                    | ({"loss_start": start, "loss_stop": stop} if role == LOSS_ROLE else {})
                )
                seq += 1
                if len(out) >= ROWS_A_BATCH:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out.clear()
        if held:
            end(length)
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return arranged.select("conv_id", "depth", "role", "text", "p1", "p2").mapInArrow(run, schema)


def read_back(nodes: DataFrame) -> DataFrame:
    """The conversations of a prefix tree, parsed from its formatted texts: digests of the turns
    and of all text under the loss mask, and the formatted length."""
    id_type = nodes.schema["conv_id"].dataType
    fields = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = T.StructType([T.StructField("conv_id", id_type), *T._parse_datatype_string(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per open node: running digests of the path's turns and loss text, loss and formatted length
        path: list[tuple] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["depth"] == 0 and not row["ended"]:
                    path = []
                if row["ended"]:
                    turns, loss, n, size = path[row["depth"]] if path and row["depth"] >= 0 else (hashlib.sha256(), hashlib.sha256(), 0, 0)
                    out.append(
                        {"conv_id": row["conv_id"], "n_turns": row["depth"] + 1, "turns_sha256": turns.hexdigest(), "loss_chars": n}
                        | {"loss_sha256": loss.hexdigest(), "formatted_chars": size}
                    )
                    continue
                del path[row["depth"] :]
                turns, loss, n, size = path[-1] if path else (hashlib.sha256(), hashlib.sha256(), 0, 0)
                turns, loss, text = turns.copy(), loss.copy(), row["text"]
                role, body = TURN.fullmatch(text).groups()
                turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                if row["loss_start"] is not None:
                    learnt = unescape(text[row["loss_start"] : row["loss_stop"]])
                    loss.update(learnt.encode())
                    n += len(learnt)
                path.append((turns, loss, n, size + len(text)))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    ordered = nodes.repartition("shard").sortWithinPartitions("shard", "seq")
    return ordered.select("shard", "seq", "depth", "text", "loss_start", "loss_stop", "ended", "conv_id").mapInArrow(run, schema)


def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted as prefix trees and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(prefix_tree(rows.unionByName(extra)))

"""License and rights notices found by diagonal voting.

Method: every rolling word 2-gram hash of a document is joined (in Spark) to the positions at
which it stands in the templates; a hit votes for the diagonal ``document position - template
position``, and the votes are gathered per diagonal.  A span is a set of neighbouring diagonals, all
within ``DRIFT`` words of the first (so words may be added or left out by that much in the whole
span, not in each step).  It is verified by its best chain of hits: rising in the document and in
the template, each template position once, across a bounded length of the document; the chain's
share of the template must reach ``COVERAGE``.  A hit is an equal 64-bit hash of two words.  Of
overlapping spans of one template the best is reported.  A base phrase is a diagonal with all its
votes, word for word.

Scale: one pass over the texts and no shuffle of them; the template side has a fixed size (the
lists below) and is broadcast; only hits and one row per document are shuffled, once; the spans of
a document are read off its sorted diagonals with a window of ``DRIFT`` of them in memory.

Defined cases: a null or empty text has no words and no labels (score 0); a document is a row,
so repeated rows and ids are reported row by row; spans of equal coverage: the first; a very long
text is a block of its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import id_text, table
from .words import signed, word_blocks

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices (label, text) that the method adds.
TEMPLATES = [
    ("agpl-3.0", "GNU Affero General Public License, version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("gpl", "Released under the GPL"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]
K, DRIFT, COVERAGE = 2, 3, 0.75
HERE = 0  # joins to the pseudo template -1, which keeps every document and its word count


def template_grams(templates: list[tuple[str, str]], base: dict[str, str], k: int = K) -> list[tuple]:
    """(hash, template, label, is_base, size in k-grams, position) of every template k-gram."""
    out = [(HERE, -1, "", False, 1, 0)]
    every = [(label, text, True) for text, label in base.items()] + [(label, text, False) for label, text in templates]
    for i, (label, text, is_base) in enumerate(every):
        block = next(word_blocks(pa.array([text])))
        grams = signed(block.grams(k)[1]).tolist()
        out += [(h, i, label, is_base, len(grams), p) for p, h in enumerate(grams)]
    return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word count and all k-gram hashes of every text, led by the mark HERE."""
    for batch in batches:
        counts, lists, sizes = [], [], []
        for b in word_blocks(batch.column(2)):
            start, h = b.grams(K)
            at = np.searchsorted(start, b.bounds)
            lists.append(np.insert(signed(h), at[:-1], HERE))
            sizes.append(np.diff(at) + 1)
            counts.append(b.counts())
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        grams = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
        words = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, grams], names=["row", "doc_id", "n_words", "grams"])


def scan_spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """Verified spans: row, doc_id, n_words, label, is_base, start (word), cover (0 to 1); every
    document also has one row without a label."""
    spark = docs.sparkSession
    rows = template_grams(TEMPLATES if templates is None else templates, BASE if base is None else base)
    grams = spark.createDataFrame(rows, "h long, template int, label string, is_base boolean, size int, at int")
    picked = id_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    hashed = picked.mapInArrow(_grams, f"row long, doc_id {id_type}, n_words long, grams array<long>")
    each = hashed.select("row", "doc_id", "n_words", F.posexplode("grams").alias("pos", "h"))
    hits = each.join(F.broadcast(grams), "h")
    doc = ["row", "doc_id", "n_words"]
    template = ["template", "label", "is_base", "size"]
    hits = hits.select(*doc, *template, "at", (F.col("pos") - 1 - F.col("at")).alias("diagonal")).repartition("row")
    votes = hits.groupBy(*doc, *template, "diagonal").agg(F.collect_list("at").alias("at"))  # at most a template's positions
    found = votes.sortWithinPartitions("row", "template", "diagonal").mapInArrow(
        _spans, f"row long, doc_id {id_type}, n_words long, label string, is_base boolean, start int, cover double"
    )
    return found


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified spans of diagonals sorted by document and template; a document's own row (template
    -1) gets no label."""
    left = None
    for batch in batches:
        held = pa.Table.from_batches([batch])
        if left is not None:
            held = pa.concat_tables([left, held]).combine_chunks()
        row, template = held.column("row").to_numpy(), held.column("template").to_numpy()
        open_ = (row == row[-1]) & (template == template[-1]) if len(row) else np.zeros(0, bool)
        cut = len(row) - int(open_.sum())  # the last template's diagonals may go on in the next batch
        yield from _verified(held.slice(0, cut))
        left = held.slice(cut)
    if left is not None:
        yield from _verified(left)


def _verified(held: pa.Table) -> Iterator[pa.RecordBatch]:
    if not held.num_rows:
        return
    held = held.combine_chunks()
    row, template, size, diagonal = (held.column(c).to_numpy() for c in ("row", "template", "size", "diagonal"))
    is_base = held.column("is_base").to_numpy(zero_copy_only=False)
    lists = held.column("at").chunk(0)
    offsets, at = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    offsets = offsets - offsets[0]
    votes = np.diff(offsets)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (template[1:] != template[:-1])
    run = np.cumsum(new) - 1
    # diagonals i .. last[i] - 1 lie within the drift; only where they have the votes can a span begin
    low = diagonal.min()
    step = int(diagonal.max() - low) + DRIFT + 2
    last = np.searchsorted(run * step + (diagonal - low), run * step + (diagonal - low) + DRIFT, "right")
    total = np.concatenate([[0], np.cumsum(votes)])
    spots, starts, covers = [], [], []
    for i in np.flatnonzero((template < 0) | (is_base & (votes == size))).tolist():
        spots.append(i)
        starts.append(int(diagonal[i]))
        covers.append(1.0)
    best = None
    for i in np.flatnonzero(~is_base & (template >= 0) & (total[last] - total[:-1] >= COVERAGE * size)).tolist():
        points = [(p, p + int(diagonal[j])) for j in range(i, last[i]) for p in at[offsets[j] : offsets[j + 1]].tolist()]
        n, first, end = best_chain(points)
        if n < COVERAGE * size[i]:
            continue
        if best is not None and (run[best[0]] != run[i] or first > best[3]):
            spots.append(best[0]), starts.append(best[2]), covers.append(best[1])
            best = None
        if best is None or n / size[i] > best[1]:
            best = (i, n / int(size[i]), first, end)
    if best is not None:
        spots.append(best[0]), starts.append(best[2]), covers.append(best[1])
    pick = pa.array(spots, pa.int64())
    kept = held.select(["row", "doc_id", "n_words"]).take(pick).combine_chunks()
    at_home = pa.array(template[spots] < 0) if spots else pa.array([], pa.bool_())
    label = pc.if_else(at_home, pa.scalar(None, pa.string()), held.column("label").take(pick).combine_chunks())
    cols = [_one(kept.column(c)) for c in kept.column_names]
    cols += [_one(label), _one(held.column("is_base").take(pick).combine_chunks()), pa.array(starts, pa.int32()), pa.array(covers, pa.float64())]
    yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n_words", "label", "is_base", "start", "cover"])


def _one(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(col, pa.Array):
        return col
    return pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)


def best_chain(points: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(hits, first word, last word) of the longest chain of (template position, document position)
    that rises in both; of equally long ones that of the earliest beginning."""
    ends: list[tuple[int, int, int, int]] = []  # hits, - first word, template position, document position
    for p, d in sorted(points):
        n, first = max(((m, f) for m, f, q, e in ends if q < p and e < d), default=(0, -d))
        ends.append((n + 1, first, p, d))
    n, first, _, d = max(ends, key=lambda x: (x[0], x[1], -x[3]))
    return n, -first, d + K - 1


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: places of the base phrases, labels of notices and the best coverage."""
    spans = scan_spans(table(spark, sf_dir, "documents"))
    base = F.col("is_base")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.sum(base.cast("long")).alias("n_base"),
            F.min(F.when(base, F.col("start").cast("long"))).alias("first_word"),
            F.max(F.when(base, F.col("start").cast("long"))).alias("last_word"),
            listed(F.when(base, F.col("label"))).alias("base_labels"),
            listed(F.col("label")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("cover"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )

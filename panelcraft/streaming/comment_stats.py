"""Streaming per-item comment statistics over an append-only folder of comment files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.wide import comment_image_stats
from ..session import ensure_checkpoint_dir
from ..sources.schemas import COMMENT


def comment_stats_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of ``comment_image_stats`` over the comment files under ``path``.

    The aggregation is the batch operator itself: Spark keeps one state row per item
    (partial aggregation per micro-batch, merged into the state store by item).
    """
    reader = spark.readStream.schema(COMMENT).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return comment_image_stats(reader.load(path))


def start_comment_stats(
    spark: SparkSession,
    path: str,
    sink: str,
    query_name: str = "comment_stats",
    checkpoint: str | None = None,
    fmt: str = "parquet",
    output_mode: str = "update",
    trigger_once: bool = False,
) -> StreamingQuery:
    """Start the stream; ``sink`` is a format (``memory``, ``console``) or a ``foreachBatch`` callable.

    The streaming checkpoint goes under the session's shared checkpoint folder unless given.
    """
    stats = comment_stats_stream(spark, path, fmt)
    if checkpoint is None:
        ensure_checkpoint_dir(spark)
        checkpoint = os.path.join(spark.sparkContext.getCheckpointDir(), "streams", query_name)
    w = stats.writeStream.queryName(query_name).outputMode(output_mode).option("checkpointLocation", checkpoint)
    w = w.foreachBatch(sink) if callable(sink) else w.format(sink)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()

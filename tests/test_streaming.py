from pyspark.sql import functions as F

from panelcraft.plans.wide import comment_image_stats
from panelcraft.sources import fixture_sources
from panelcraft.sources.schemas import COMMENT
from panelcraft.streaming import start_comment_stats

SF = "/root/testdata/sf0.001"


def test_streaming_stats_equal_batch(spark, scratch):
    comments = fixture_sources(spark, SF).comments.select(*COMMENT.fieldNames())
    log = f"{scratch}/comments"
    # two appends to the log: old orders first, then the rest
    comments.where(F.col("comment_id") % 2 == 0).write.parquet(log, mode="append")
    comments.where(F.col("comment_id") % 2 == 1).write.parquet(log, mode="append")
    q = start_comment_stats(spark, log, "memory", query_name="cstats_test", checkpoint=f"{scratch}/ckpt", output_mode="complete")
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("cstats_test").collect()), key=repr)  # an item_id may be null
    finally:
        q.stop()
    want = sorted(map(tuple, comment_image_stats(comments).collect()), key=repr)
    assert got == want and len(got) > 0


def test_streaming_available_now_with_foreach_batch(spark, scratch):
    comments = fixture_sources(spark, SF).comments.select(*COMMENT.fieldNames())
    log = f"{scratch}/comments"
    comments.write.parquet(log)
    seen = []

    def sink(batch, epoch_id):
        seen.append(batch.count())

    q = start_comment_stats(spark, log, sink, query_name="cstats_fb", checkpoint=f"{scratch}/ckpt", trigger_once=True)
    q.awaitTermination(120)
    assert sum(seen) == comment_image_stats(comments).count()

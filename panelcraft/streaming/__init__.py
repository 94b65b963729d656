"""Incremental maintenance of the per-item comment statistics.

The original workflow is batch only.  Its comment table is an append-only log, so the per-item
statistics every wide table starts from (picture reviews, other reviews, first picture-review
time - ``plans.wide.comment_image_stats``) can also be kept current with Structured
Streaming: new comment files are folded into the per-item state instead of rescanning the log.
The state is keyed and partitioned by item, one row per item.
"""

from .comment_stats import comment_stats_stream, start_comment_stats

__all__ = ["comment_stats_stream", "start_comment_stats"]

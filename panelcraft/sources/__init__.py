"""Sources and sinks."""

from .fixtures import Sources, fixture_sources, view_sql
from .readers import (
    latest_partition,
    latest_partition_value,
    lookup,
    partition_range,
    read_comments,
    read_daily,
    read_items,
    read_shops,
    read_sources,
)
from .sinks import (
    append_into,
    cast_to,
    create_by_run,
    create_table,
    materialize,
    overwrite_into,
    overwrite_partitions,
    record_run,
    typed_schema,
    write_bucketed,
    write_partitioned,
)

__all__ = [
    "Sources",
    "append_into",
    "cast_to",
    "create_table",
    "fixture_sources",
    "latest_partition",
    "latest_partition_value",
    "lookup",
    "materialize",
    "overwrite_into",
    "partition_range",
    "create_by_run",
    "overwrite_partitions",
    "record_run",
    "read_comments",
    "read_daily",
    "read_items",
    "read_shops",
    "read_sources",
    "typed_schema",
    "view_sql",
    "write_bucketed",
    "write_partitioned",
]

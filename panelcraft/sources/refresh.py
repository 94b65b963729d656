"""Incremental refresh of a stored table from a source that is partitioned by day.

A manifest beside the stored table (``<name>__manifest``) keeps, per source partition, a digest of
its files (names, sizes, modification times).  A refresh lists the source again and rebuilds only the
partitions whose digest is new or different: their rows replace the stored partitions of the same
value (dynamic partition overwrite), partitions that are gone or have no rows left are dropped,
and the manifest is written last, so a refresh that is killed half way is simply repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import NO_VALUE
from .sinks import overwrite_partitions


def manifest(spark: SparkSession, root: str, col: str = "pt") -> dict[str, str]:
    """Partition value -> digest of its files, for the ``col=value`` directories under ``root``
    (``NO_VALUE`` for rows without a value)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for d in fs.listStatus(path):
        name = d.getPath().getName()
        if not d.isDirectory() or not name.startswith(f"{col}="):
            continue
        files = [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(d.getPath())]
        files = sorted(f for f in files if not f[0].startswith(("_", ".")))
        if files:
            out[unquote(name[len(col) + 1 :])] = hashlib.sha256(repr(files).encode()).hexdigest()
    return out


def _drop_partitions(spark: SparkSession, name: str, col: str, values: list[str]) -> None:
    if not spark.catalog.tableExists(name):
        return
    there = {r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    for v in values:
        if f"{col}={v}" in {unquote(t) for t in there}:
            spec = "null" if v == NO_VALUE else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({col}={spec})")


def _overwrite_partitions(df: DataFrame, name: str, col: str) -> None:
    """Replace the partitions that ``df`` has rows of; the table is created by its first rows."""
    if not df.sparkSession.catalog.tableExists(name):
        df.limit(0).write.format("parquet").partitionBy(col).saveAsTable(name)
    overwrite_partitions(df.select(*[c for c in df.columns if c != col], col).hint("rebalance", F.col(col)), name)


def refresh(source: DataFrame, root: str, name: str, build: Callable[[DataFrame], DataFrame], col: str = "pt", root_col: str | None = None) -> list[str]:
    """Bring table ``name`` up to date with ``source``, stored under ``root`` by ``col`` (in the folders
    named by ``root_col``, if that is another name); returns the partition values that were rebuilt
    or dropped.

    ``build`` maps rows of the source to rows of the table, partition by partition: it must keep
    ``col`` and never combine rows of different partitions, so that rebuilding some of them equals
    rebuilding all.  Partition values are text.
    """
    spark = source.sparkSession
    stored = f"{name}__manifest"
    now = manifest(spark, root, root_col or col)
    known = {r["value"]: r["digest"] for r in spark.table(stored).collect()} if spark.catalog.tableExists(stored) else {}
    changed = sorted(v for v, digest in now.items() if known.get(v) != digest)
    gone = sorted(v for v in known if v not in now)
    if not changed and not gone:
        return []
    texts = [v for v in changed if v != NO_VALUE]
    wanted = F.col(col).isin(texts) if texts else F.lit(False)
    if NO_VALUE in changed:
        wanted = wanted | F.col(col).isNull()
    rows = build(source.where(wanted))
    _overwrite_partitions(rows, name, col)
    filled = {NO_VALUE if r[0] is None else r[0] for r in rows.select(F.col(col).cast("string")).distinct().collect()}
    _drop_partitions(spark, name, col, [v for v in [*changed, *gone] if v not in filled])
    written = spark.createDataFrame([(now[v], v) for v in changed], "digest string, value string")
    _overwrite_partitions(written, stored, "value")
    _drop_partitions(spark, stored, "value", gone)
    spark.catalog.refreshTable(name)
    return sorted([*changed, *gone])

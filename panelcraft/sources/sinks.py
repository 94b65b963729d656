"""Table sinks: create-if-absent, typed create, overwrite/append loads, bucketed and partitioned layouts."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def materialize(
    df: DataFrame, name: str, mode: str = "ignore", fmt: str = "parquet", buckets: int | None = None, key: str | None = None
) -> DataFrame:
    """``CREATE TABLE IF NOT EXISTS name AS <df>`` (``mode='ignore'``), or ``'overwrite'``.

    With ``ignore`` an existing table keeps its old rows (the original behaviour: a second
    run never refreshes).  Returns the table as a DataFrame so later steps read the stored
    result instead of recomputing the lineage.  ``buckets``/``key`` store it hash-clustered
    on ``key``: tables bucketed alike join and aggregate on ``key`` without a shuffle.
    """
    if buckets:
        df = df.repartition(buckets, F.col(key))  # one file a bucket
    w = df.write.mode(mode).format(fmt)
    if buckets:
        w = w.bucketBy(buckets, key).sortBy(key)
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def create_table(spark: SparkSession, name: str, schema: T.StructType, comment: str | None = None, fmt: str = "parquet") -> None:
    """Typed ``CREATE TABLE IF NOT EXISTS`` with column comments taken from field metadata."""
    cols = []
    for f in schema.fields:
        c = f.metadata.get("comment") if f.metadata else None
        cols.append(f"`{f.name}` {f.dataType.simpleString()}" + (f" COMMENT '{c}'" if c else ""))
    ddl = f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(cols)}) USING {fmt}"
    if comment:
        ddl += f" COMMENT '{comment}'"
    spark.sql(ddl)


def cast_to(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the named columns to the declared types of a typed sink."""
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "timestamp": T.TimestampType()}


def typed_schema(df: DataFrame, types: dict[str, str], comments: dict[str, str] | None = None) -> T.StructType:
    """Schema of ``df`` with the declared types of a typed sink (e.g. ids STRING, money DOUBLE)."""
    comments = comments or {}
    fields = []
    for f in df.schema.fields:
        dtype = _TYPES[types[f.name]] if f.name in types else f.dataType
        meta = {"comment": comments[f.name]} if f.name in comments else {}
        fields.append(T.StructField(f.name, dtype, True, meta))
    return T.StructType(fields)


def overwrite_into(df: DataFrame, name: str) -> None:
    """``INSERT OVERWRITE TABLE name SELECT ...``: positional, with store-assignment casts."""
    df.write.insertInto(name, overwrite=True)


def append_into(df: DataFrame, name: str) -> None:
    """``INSERT INTO name SELECT ...``."""
    df.write.mode("append").insertInto(name)


_MODE = "spark.sql.sources.partitionOverwriteMode"
_mode_lock = threading.Lock()


def overwrite_partitions(df: DataFrame, name: str) -> None:
    """Replace the partitions of table ``name`` that ``df`` has rows of, when the write commits;
    other partitions stay.  (An insert takes the mode from the session, so it is set for the
    length of the write, one such write at a time.)"""
    conf = df.sparkSession.conf
    with _mode_lock:
        before = conf.get(_MODE)
        conf.set(_MODE, "dynamic")
        try:
            df.write.mode("overwrite").insertInto(name)
        finally:
            conf.set(_MODE, before)


def record_run(ids: DataFrame, name: str, run: str, column: str = "run") -> None:
    """Write the ids of one run to its own partition of a ledger table, created if it is absent.

    Ids that other runs hold are left out, so an id stands in the ledger once.  The partition is
    replaced as a whole when the write commits (dynamic partition overwrite): a repeated, killed
    or restarted run adds nothing twice, and runs that write at the same time touch different
    partitions.
    """
    spark = ids.sparkSession
    create_by_run(ids, name, column)
    others = spark.table(name).where(F.col(column) != run).select(*ids.columns)
    overwrite_partitions(ids.join(others, ids.columns, "left_anti").withColumn(column, F.lit(run)), name)


def create_by_run(rows: DataFrame, name: str, column: str = "run") -> None:
    """Create a table of ``rows``' columns, partitioned by run, if it is absent."""
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{column}` STRING"]
    rows.sparkSession.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(fields)}) USING parquet PARTITIONED BY ({column}) COMMENT 'by run'")


def write_bucketed(df: DataFrame, name: str, n: int = 1024, key: str = "shop_id", fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Hash-clustered, sorted layout so joins and aggregations on ``key`` skip the shuffle; one
    file a bucket, as the rows are first dealt to the buckets' tasks."""
    df.repartition(n, F.col(key)).write.mode(mode).format(fmt).bucketBy(n, key).sortBy(key).saveAsTable(name)


def write_partitioned(df: DataFrame, path_or_name: str, col: str = "pt", fmt: str = "parquet", mode: str = "overwrite", table: bool = False) -> None:
    """Directory-partitioned layout on a ``yyyymmdd`` text column (static pruning on read).

    Rows are rebalanced by ``col``: small days share a task, and a day of more than the advisory
    partition size is split over several, so no day is one task's work or one file.
    """
    w = df.hint("rebalance", F.col(col)).write.mode(mode).format(fmt).partitionBy(col)
    if table:
        w.saveAsTable(path_or_name)
    else:
        w.save(path_or_name)

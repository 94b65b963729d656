"""Readers for the production layout (ORC or Parquet, daily table partitioned by ``pt``)."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .fixtures import Sources


def _read(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(fmt).load(path)


def read_items(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Item master, the columns the library uses (31 for the wide table + 3 for the study)."""
    return _read(spark, path, fmt, schemas.ITEM).select(*schemas.ITEM.fieldNames())


def read_daily(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Item daily facts; ``pt`` is the partition column, so filters on it prune directories."""
    return _read(spark, path, fmt, schemas.DAILY).select(*schemas.DAILY.fieldNames())


def read_shops(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, schemas.SHOP).select(*schemas.SHOP.fieldNames())


def read_comments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, schemas.COMMENT).select(*schemas.COMMENT.fieldNames())


def read_sources(spark: SparkSession, items: str, daily: str, comments: str, shops: str, fmt: str = "parquet") -> Sources:
    return Sources(
        items=read_items(spark, items, fmt),
        daily=read_daily(spark, daily, fmt),
        comments=read_comments(spark, comments, fmt),
        shops=read_shops(spark, shops, fmt),
    )


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the directory of rows without a partition value


def partition_values(spark: SparkSession, root: str, col: str = "pt") -> list[str]:
    """Values of ``col`` in the ``col=value`` directories right under ``root`` (one directory
    level, not its files); rows without a value have none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found if f.isDirectory()]
    values = [unquote(n[len(col) + 1 :]) for n in names if n.startswith(f"{col}=")]
    return sorted(v for v in values if v and v != NO_VALUE)


def latest_partition_value(df: DataFrame, col: str = "pt", root: str | None = None) -> str | None:
    """Largest value of the partition column; rows without one do not count.

    With the table's ``root`` folder it is read from the directory names, as ``MAX_PT`` reads
    partition metadata; otherwise from an aggregate of that one column.  The literal is then a
    static filter, so the scan prunes to one directory.
    """
    if root is not None:
        values = partition_values(df.sparkSession, root, col)
        return values[-1] if values else None
    row = df.agg(F.max(col).alias("m")).first()
    return row["m"] if row else None


def latest_partition(df: DataFrame, col: str = "pt", root: str | None = None) -> DataFrame:
    """Rows of the newest partition (``pt = MAX_PT(table)``)."""
    value = latest_partition_value(df, col, root)
    return df.where(F.col(col) == F.lit(value)) if value is not None else df.limit(0)


def partition_range(df: DataFrame, lo: str, hi: str, col: str = "pt") -> DataFrame:
    """``pt BETWEEN lo AND hi`` on ``yyyymmdd`` text (lexicographic = chronological)."""
    return df.where(F.col(col).between(F.lit(lo), F.lit(hi)))


def lookup(df: DataFrame, **eq) -> DataFrame:
    """Point lookup by equality on one or more columns (pushed to the file scan)."""
    cond = None
    for k, v in eq.items():
        c = F.col(k) == F.lit(v)
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df

"""Files clustered along a space-filling curve, with zone maps for point lookups.

``write_clustered`` cuts every clustering column into ``2**BITS`` ranges of about equal size (bounds
from a sample), interleaves the range numbers bit by bit (a Z-order curve) and range-partitions the
rows by that number, so every file covers a small box of all columns at once; a writer's Bloom
filter of the leading column lets readers skip row groups.  ``zone_map`` lists every file with the
least and greatest value of each column, and ``lookup`` reads only the files whose box can hold what
is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import SortKey, literal, precedes, sorted_rows

BITS, SAMPLE = 5, 8192


def _range_number(df: DataFrame, col: str) -> Column:
    """Number of the value's range, 0 to 2**BITS - 1; nulls first."""
    key = SortKey(col)
    rows = df.select(col).orderBy(F.xxhash64(col), col).limit(SAMPLE).collect()
    values = sorted_rows(list({(r[0],) for r in rows if r[0] is not None}), [key])
    n = 1 << BITS
    bounds = list(dict.fromkeys(values[len(values) * i // n] for i in range(1, n))) if values else []
    kind = df.schema[col].dataType

    def tree(bounds: list[tuple], first: int) -> Column:
        if not bounds:
            return F.lit(first)
        mid = len(bounds) // 2
        return F.when(precedes([key], [literal(bounds[mid][0], kind)]), tree(bounds[:mid], first)).otherwise(tree(bounds[mid + 1 :], first + mid + 1))

    return tree(bounds, 0)


def curve(df: DataFrame, cols: list[str]) -> Column:
    """Position on the Z-order curve of the columns' range numbers."""
    z = F.lit(0)
    for i, c in enumerate(cols):
        number = _range_number(df, c)
        for bit in range(BITS):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(number, bit).bitwiseAND(1), bit * len(cols) + i))
    return z


def write_clustered(df: DataFrame, path: str, cols: list[str], files: int, bloom: str | None = None) -> None:
    """Write ``files`` Parquet files (about) clustered by ``cols``; ``bloom``: the column with a Bloom
    filter in every row group (default: the first)."""
    z = "_curve"
    rows = df.withColumn(z, curve(df, cols)).repartitionByRange(files, F.col(z), *cols).sortWithinPartitions(z, *cols).drop(z)
    rows.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{bloom or cols[0]}", "true").parquet(path)


def zone_map(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """(file, lo_<col>, hi_<col> ...) of every file; to be stored beside the data."""
    bounds = [x for c in cols for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    return spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(*bounds)


def files_for(zones: DataFrame, **eq) -> list[str]:
    """The files that can hold rows with these values."""
    for c, v in eq.items():
        zones = zones.where((F.col(f"lo_{c}") <= F.lit(v)) & (F.col(f"hi_{c}") >= F.lit(v)))
    return sorted(r["file"] for r in zones.select("file").collect())


def lookup_clustered(spark: SparkSession, path: str, zones: DataFrame, **eq) -> DataFrame:
    """Rows with these values, from the files that can hold them only."""
    files = files_for(zones, **eq)
    schema = spark.read.parquet(path).schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    for c, v in eq.items():
        rows = rows.where(F.col(c) == F.lit(v))
    return rows

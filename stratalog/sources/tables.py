"""Sorted tables: Parquet sorted by key, with keys delta-encoded against their predecessors and a Bloom filter on them. A small
table is one file; a large one is a folder of files with key ranges that don't overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import STORED, VALUES, Params
from ..operators.compaction import Table, prune

#: Entries and bytes of keys and values of one file; more are split by key range (values: by offset).
FILE_ENTRIES, FILE_BYTES = 1 << 20, 256 << 20


def parts_of(count: int, size: int) -> int:
    """How many files, and tasks that sort them, so many entries and bytes take."""
    return max(1, -(-count // FILE_ENTRIES), -(-size // FILE_BYTES))


def tasks_of(spark: SparkSession, count: int, size: int) -> int:
    """Over how many tasks entries go if none is to sort many more than a file takes, or than a quarter of its bytes; 0: what one
    task takes is left to Spark, which fits the tasks to its cores. Its own partitions grow with the input: splits of files
    up to 128 MB, and shuffled ones of 64 MB, compressed, which hold millions of short rows."""
    parts = parts_of(count, 4 * size)
    return 0 if parts == 1 else max(parts, spark.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, count: int, size: int, *columns: str) -> DataFrame:
    """The rows dealt by the columns over the tasks that so many entries take."""
    n = tasks_of(rows.sparkSession, count, size)
    return rows.repartition(n, *columns) if n else rows


def in_order(rows: DataFrame, count: int, size: int, reverse: bool = False) -> DataFrame:
    """The rows in the order of keys, sorted in the tasks that so many take."""
    order, n = F.col("key").desc() if reverse else F.col("key").asc(), tasks_of(rows.sparkSession, count, size)
    return (rows.repartitionByRange(n, order) if n else rows).orderBy(order)


def _sorted(entries: DataFrame, files: int) -> DataFrame:
    parts = entries.coalesce(1) if files == 1 else entries.repartitionByRange(files, "key")
    return parts.sortWithinPartitions("key", "seq")


def write_table(entries: DataFrame, path: str, table_id: int, level: int, params: Params, count: int, size: int = 0) -> Table | None:
    """Writes entries (the STORED schema) as one sorted table; None if there are none. count, size: about how many there are, and their bytes."""
    spark = entries.sparkSession
    writer = _sorted(entries, parts_of(count, size)).write.mode("overwrite").option("compression", params.compression).option("parquet.page.row.count.limit", params.max_key_block_size)
    # version 2 writes keys as lengths of common prefixes and suffixes, if no dictionary is tried first
    writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#key", "false")
    if params.bloom_filters:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", max(count, 1))
    writer.parquet(path)
    stored = spark.read.schema(STORED).parquet(path)
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    low, high, n, size = stored.agg(F.min("key"), F.max("key"), F.count("*"), F.sum(size)).first()
    return Table(table_id, level, bytes(low), bytes(high), n, size, path) if n else None


def read_tables(spark: SparkSession, tables: list[Table], low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """Entries of the tables that may hold keys of the closed range; the others' files are not opened."""
    paths = [t.path for t in prune(tables, low, high)]
    return spark.read.schema(STORED).parquet(*paths) if paths else spark.createDataFrame([], STORED)


def write_values(values: DataFrame, folder: str, batch_id: int, params: Params, count: int, size: int = 0) -> None:
    """One value batch, sorted by offset; count, size: about how many values there are, and their bytes."""
    rows, files = values.select("offset", "key", "value"), parts_of(count, size)
    parts = rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, "offset")
    parts.sortWithinPartitions("offset").write.mode("overwrite").option("compression", params.compression).parquet(f"{folder}/batch_id={batch_id}")


def read_values(spark: SparkSession, folder: str, batches: tuple[int, ...]) -> DataFrame:
    """The named value batches; batch_id comes from the folder's name, so a filter on it prunes folders."""
    if not batches:
        return spark.createDataFrame([], VALUES)
    paths = [f"{folder}/batch_id={b}" for b in batches]
    return spark.read.schema(VALUES).option("basePath", folder).parquet(*paths).select("batch_id", "offset", "key", "value")

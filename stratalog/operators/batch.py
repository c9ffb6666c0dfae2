"""Ordered batches of operations as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ENTRY, WriteBatch


def frame_of(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    """Entries (key, seq, op, value) of the driver as a DataFrame; they go over as Arrow columns."""
    import pyarrow as pa

    kinds = (pa.binary(), pa.int64(), pa.int8(), pa.binary())
    columns = list(zip(*entries)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=ENTRY.names), ENTRY)


def batch_frame(spark: SparkSession, batch: WriteBatch) -> DataFrame:
    """ord, key, op, value of a batch, ord from 0."""
    rows = [(i, bytearray(k), o, None if v is None else bytearray(v)) for i, (o, k, v) in enumerate(batch.operations)]
    return spark.createDataFrame(rows, "ord long, key binary, op byte, value binary")


def assign_sequence(operations: DataFrame, base: int) -> DataFrame:
    """Entries of operations with a column ``ord`` (0, 1, ...): each consumes the sequence number base + ord.

    The order of rows in a DataFrame means nothing; ord is what makes a later operation on a key win."""
    value = F.when(F.col("op") == F.lit(1), F.col("value"))
    return operations.select("key", (F.lit(base).cast("long") + F.col("ord")).alias("seq"), F.col("op").cast("byte").alias("op"), value.alias("value"))

"""Key/value separation: references, liveness and garbage.

A value is dead if no newest version of a key refers to it. That is derived from the entries whenever it is asked for, by
an anti-join, instead of being kept up to date by every write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PUT
from .resolve import latest

#: A batch with a smaller share of live values is rewritten.
SPARSE = 0.25
PLACE = ["batch_id", "offset"]


def _as_is(rows: DataFrame, *_: str) -> DataFrame:
    return rows


def references(entries: DataFrame) -> DataFrame:
    """batch_id, offset, key of what live keys refer to."""
    return latest(entries).filter((F.col("op") == PUT) & F.col("batch_id").isNotNull()).select("batch_id", "offset", "key")


def dereference(rows: DataFrame, values: DataFrame, deal: Callable[..., DataFrame] = _as_is) -> DataFrame:
    """The rows with their values: inline ones stay, others are looked up by (batch_id, offset). deal: partitions what is joined by columns."""
    stored = values.select("batch_id", "offset", F.col("value").alias("_stored"))
    joined = deal(rows, *PLACE).join(deal(stored, *PLACE), PLACE, "left")
    return joined.withColumn("value", F.coalesce("value", "_stored")).drop("_stored", "batch_id", "offset")


def value_at(values: DataFrame, offset: int) -> DataFrame:
    """The value at one place of a batch; the equality reaches the scan."""
    return values.filter(F.col("offset") == F.lit(offset)).select("value")


def dead_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """batch_id, offset, key of values that no live key refers to."""
    return values.select("batch_id", "offset", "key").join(references(entries), ["batch_id", "offset"], "left_anti")


def batch_liveness(values: DataFrame, entries: DataFrame, deal: Callable[..., DataFrame] = _as_is) -> DataFrame:
    """batch_id, total, live for each value batch. deal: partitions what is joined by columns."""
    marked = deal(values.select(*PLACE), *PLACE).join(deal(references(entries).withColumn("live", F.lit(1)), *PLACE), PLACE, "left")
    return marked.groupBy("batch_id").agg(F.count("*").alias("total"), F.count("live").alias("live"))


def garbage(liveness: DataFrame, sparse: float = SPARSE) -> DataFrame:
    """batch_id, action: ``drop`` for batches without a live value, ``rewrite`` for sparse ones."""
    action = F.when(F.col("live") == 0, "drop").when(F.col("live") < sparse * F.col("total"), "rewrite")
    return liveness.select("batch_id", action.alias("action")).filter("action is not null")

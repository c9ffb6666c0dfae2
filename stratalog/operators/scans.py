"""Lookups and scans over entries. Keys compare as unsigned bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import InvalidParams
from .resolve import live

#: Lookup keys up to this many are broadcast (some 10 MB); more are shuffled with the entries.
MOST_BROADCAST = 100_000


def check_bounds(low: bytes, high: bytes) -> None:
    if low >= high:
        raise InvalidParams("the lower bound must be below the upper bound")


def get(entries: DataFrame, key: bytes) -> DataFrame:
    """The key's row, if it is live; the equality reaches the scan."""
    return live(entries.filter(F.col("key") == F.lit(key)))


def multi_get(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """key, value, found for each distinct key of ``keys`` (column key), live or not."""
    asked = keys.select("key").filter(F.col("key").isNotNull()).distinct()
    side = F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked
    found = live(entries.join(side, "key", "left_semi")).withColumn("found", F.lit(True))
    return asked.join(found, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def scan(entries: DataFrame) -> DataFrame:
    """All live rows, ascending."""
    return live(entries).orderBy("key")


def reverse_scan(entries: DataFrame) -> DataFrame:
    """All live rows, descending."""
    return live(entries).orderBy(F.col("key").desc())


def range_scan(entries: DataFrame, low: bytes, high: bytes) -> DataFrame:
    """Live rows with low <= key < high, ascending."""
    check_bounds(low, high)
    return live(entries.filter((F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high)))).orderBy("key")


def reverse_range_scan(entries: DataFrame, high: bytes, low: bytes) -> DataFrame:
    """Live rows with low < key <= high, descending. The upper bound comes first."""
    check_bounds(low, high)
    return live(entries.filter((F.col("key") > F.lit(low)) & (F.col("key") <= F.lit(high)))).orderBy(F.col("key").desc())


def first_n(rows: DataFrame, n: int, reverse: bool = False) -> DataFrame:
    """The n smallest (largest) keys; plans as a top-n without a full sort."""
    return rows.orderBy(F.col("key").desc() if reverse else F.col("key")).limit(n)

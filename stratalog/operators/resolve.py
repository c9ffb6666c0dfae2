"""Version resolution: of each key the entry with the highest sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import PUT


def latest(entries: DataFrame) -> DataFrame:
    """The newest entry of each key, deletions included.

    Filters on the key pass below this; filters on op or value must stay above it, or deleted versions come back. The rank
    limit is applied before the shuffle, so each task sends one version of a key at most, however hot the key is."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc()))
    return entries.withColumn("_nth", newest).filter("_nth = 1").drop("_nth")


def live(entries: DataFrame) -> DataFrame:
    """key and value of keys that are not deleted (with the entries' other columns, but seq and op)."""
    return latest(entries).filter(F.col("op") == PUT).drop("seq", "op")

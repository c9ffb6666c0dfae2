"""Change streams: the newest version of each key, kept by the state store, and ingestion into a store.

Order is by sequence number, which stays with an entry in the store, so entries that arrive late with a lower one lose by
themselves and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..database import Database


def latest_stream(entries: DataFrame) -> DataFrame:
    """Of a stream of entries, key, seq, op, value of the newest version of each key so far; write it in update mode.

    A null value (a deletion) must win over an older value, so the whole struct is the aggregate's value."""
    newest = F.max_by(F.struct("seq", "op", "value"), "seq").alias("e")
    return entries.groupBy("key").agg(newest).select("key", "e.seq", "e.op", "e.value")


def ingest(entries: DataFrame, database: Database, checkpoint: str) -> StreamingQuery:
    """Writes a stream of changes (key, seq, op, value) to a store, with the sequence numbers that they bring (see ``Database.write_entries``).

    A late change loses to a newer one whatever the order of micro-batches, and a micro-batch that is delivered again adds
    the same entries with the same numbers, which changes nothing: neither what came after it nor what was written since."""

    def write(batch: DataFrame, _: int) -> None:
        database.write_entries(batch.select("key", "seq", "op", "value"))

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

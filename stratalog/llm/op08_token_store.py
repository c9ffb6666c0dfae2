"""Operator 8: token ids in ORC.

Documents are range-partitioned and sorted by doc_id, tokenised, and written as ORC: ids go through ORC's integer
run-length encoding, every file has stripes, a row index and a Bloom filter on doc_id. Stripes are read in parallel, and
a lookup by doc_id reads only the stripes and row groups whose statistics and filter admit it.

Edge cases: null or empty text is a document of the end id alone; a null doc_id sorts first; rows with equal doc_id are
all kept, ordered by text; an empty table gives an empty store; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_batches, documents, give_back
from .tokens import default_path, encoder, forget, texts

STORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


def _tokenise(path: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, start, encode = TaskContext.get().partitionId(), 0, encoder(path)
        for batch, rows in texts(batches):
            ids = [encode(x) for x in rows]
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(lengths)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(start + ends - lengths), pa.array(lengths), column], names=STORED.names)
            start += int(ends[-1])
        forget()

    return run


def write_token_store(docs: DataFrame, path: str, tokenizer: str | None = None, stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Writes ids of every document to ORC files at ``path``, which ascend by doc_id within and across files.

    ``part`` numbers the sorted partitions; ``part_start`` is the count of ids before the document in its part, so that a
    document's place in the whole store is its part's offset (see ``part_offsets``) plus ``part_start``.
    """
    spark = docs.sparkSession
    # an id that very many rows share is parted by how their texts begin, in the order in which they are sorted
    ordered = documents(docs).repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    with arrow_batches(spark):
        (
            ordered.mapInArrow(_tokenise(tokenizer or default_path()), STORED)
            .write.mode("overwrite")
            .option("compression", "zstd")
            .option("orc.stripe.size", stripe_bytes)
            .option("orc.row.index.stride", index_rows)
            .option("orc.bloom.filter.columns", "doc_id")
            .option("orc.bloom.filter.fpp", "0.01")
            .orc(path)
        )


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of the named documents; the predicate reaches ORC's statistics and Bloom filters."""
    return read_token_store(spark, path).filter(F.col("doc_id").isin(doc_ids))


def part_offsets(store: DataFrame) -> DataFrame:
    """(part, part_offset): ids in all parts before; one row for each written partition, from the small columns alone."""
    sums = store.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_offset"))


def _checksum(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            ids = batch.column(3)
            at, values = np.asarray(ids.offsets).tolist(), np.asarray(ids.values).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at, at[1:])]
            lengths = np.diff(np.asarray(ids.offsets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])
    give_back()


def summarise(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what the files hold. The broadcast side has one row for each written partition."""
    with arrow_batches(store.sparkSession):
        rows = store.select("doc_id", "part", "part_start", "ids").mapInArrow(_checksum, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
        rows = Scratch(store.sparkSession, "store").save(rows, "sums")
    return rows.join(F.broadcast(part_offsets(store)), "part").select("doc_id", (F.col("part_offset") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op8")
    write_token_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.path("orc"))
    return summarise(read_token_store(spark, scratch.path("orc")))

"""Shared plumbing: scratch tables in the cluster's shared folder, word rules, Arrow batch bounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Fixed value: what separates the words of operators 3, 5 and 10 (words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all executors share")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="stratalog-")
    return f"file://{_local}"


_local: str | None = None
_open: list[Scratch] = []


class Scratch:
    """Intermediate Parquet tables of one call. They cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/stratalog/{name}-{uuid.uuid4().hex[:12]}"
        _open.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and gives the table read back; the stored schema is used, so an empty table works too."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Removes one table, or all of them; only what no later read needs."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    for scratch in _open:
        try:
            scratch.drop()
        except Exception:  # the session may be gone; the cluster's own cleaning takes what is left
            continue


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000, mb: int = 8) -> Iterator[None]:
    """Bounds what a Python worker gets at once while tables are written inside this block (a plan takes the bounds of when it runs)."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(mb << 20)}
    before = {k: spark.conf.get(k, None) for k in bounds}
    for k, v in bounds.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ending(run):
    """The same function over batches, which returns the worker's memory to the system when its task ends."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


_U32 = (1 << 32) - 1


def _turn(x, bits: int):
    import numpy as np

    return (x << np.uint64(bits) | x >> np.uint64(32 - bits)) & np.uint64(_U32)


def _times(x, factor: int):
    import numpy as np

    return x * np.uint64(factor) & np.uint64(_U32)


def number_of(label):
    """The hash by which Spark deals out integers (32-bit Murmur3 with seed 42), as unsigned numbers."""
    import numpy as np

    x = np.asarray(label, np.int64).astype(np.uint64) & np.uint64(_U32)
    x = _times(_turn(_times(x, 0xCC9E2D51), 15), 0x1B873593) ^ np.uint64(42)
    x = (_times(_turn(x, 13), 5) + np.uint64(0xE6546B64) & np.uint64(_U32)) ^ np.uint64(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = _times(x ^ x >> np.uint64(shift), factor)
    return x ^ x >> np.uint64(16)


def label_of(number):
    """The integer whose hash is the number (below 2^31): buckets named so are dealt out evenly, n over n partitions one to each."""
    import numpy as np

    undo = lambda factor: pow(factor, -1, 1 << 32)
    x = np.asarray(number, np.int64).astype(np.uint64)
    x = x ^ x >> np.uint64(16)
    x = _times(x, undo(0xC2B2AE35))
    x = x ^ x >> np.uint64(13) ^ x >> np.uint64(26)
    x = _times(x, undo(0x85EBCA6B))
    x = (x ^ x >> np.uint64(16)) ^ np.uint64(4)
    x = _turn(_times(x + np.uint64((1 << 32) - 0xE6546B64) & np.uint64(_U32), undo(5)), 19) ^ np.uint64(42)
    x = _times(_turn(_times(x, undo(0x1B873593)), 17), undo(0xCC9E2D51))
    return x.astype(np.uint32).view(np.int32)


def partitions_for(df: DataFrame) -> int:
    """How many partitions a scan of as many bytes would have, by the plan's statistics; the shuffle's number where these say nothing."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, -(-size // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())) if size < 1 << 60 else shuffle_partitions(spark)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would touch other scripts)."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of operators 3, 5 and 10 as an array; null or empty text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns alone, so that no other column can clash with what an operator adds."""
    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; a plain reference inside a lambda would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column, block: int = 512) -> Column:
    """Running sums of an integer array, block by block, so that long arrays don't cost the square of their size."""
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    add_up = lambda a: F.aggregate(a, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(last(acc) + x)))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: add_up(F.slice(lengths, b * block + 1, block)))
    shifted = lambda inner: let(add_up(F.transform(inner, last)), lambda sums: F.flatten(F.transform(inner, lambda p, i: F.transform(p, lambda x: x + F.coalesce(F.get(sums, i - 1), F.lit(0))))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(parts, shifted))


def match_spans(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<start:int,end:int,value:string>>, in code points, end exclusive."""
    step = lambda gap, hit: F.length(gap) + F.length(hit)
    place = lambda hits: lambda gaps: let(
        running(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, step)),
        lambda ends: F.zip_with(hits, ends, lambda hit, end: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("value"))),
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(found, lambda hits: F.when(F.size(hits) == 0, none).otherwise(let(F.split(text, pattern), place(hits))))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the DataFrame doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns what a Python worker has freed to the system, so that idle workers hold little."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others return memory by themselves
    if trim:
        trim(0)

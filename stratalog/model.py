"""Entry model: what a key-value log is as DataFrame columns, and the errors of the engine.

An entry is one version of a key. Keys and values are opaque bytes; Spark compares BINARY as unsigned bytes, which is the
order of every scan. ``seq`` orders versions; it is a signed 64-bit integer, so a log holds at most 2^63 - 1 operations.
A deletion is an entry without value; an empty value is a value.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

#: Codes of operations.
PUT, DELETE = 1, 2

ENTRY = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
#: An entry whose value may stand in a value batch instead: ``batch_id`` and ``offset`` are null where it stands inline.
STORED = T.StructType([*ENTRY.fields, T.StructField("batch_id", T.LongType(), True), T.StructField("offset", T.LongType(), True)])
VALUES = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
TABLES = T.StructType(
    [
        T.StructField("table_id", T.LongType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("min_key", T.BinaryType()),
        T.StructField("max_key", T.BinaryType()),
        T.StructField("num_entries", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("path", T.StringType()),
    ]
)


class StoreError(Exception):
    """Base of the engine's errors."""


class StorageError(StoreError):
    """A file can't be read or written."""


class InvalidParams(StoreError, ValueError):
    """A parameter, bound or path makes no sense."""


class CorruptData(StoreError):
    """A stored file doesn't hold what it should."""


class StartMode(Enum):
    CREATE_OR_OPEN = "create_or_open"
    OPEN = "open"
    CREATE_OR_OVERRIDE = "create_or_override"


@dataclass(frozen=True)
class Params:
    """Settings of a store.

    ``path`` must be reachable by driver and executors. ``max_open_files`` and ``block_restart_interval`` are accepted and
    have no effect: Parquet and the operating system's page cache do their work. ``compaction_concurrency`` bounds nothing
    here, because one merge is one Spark job whose tasks run in parallel. ``background``: a thread of the store flushes full
    memtables and compacts, so that writers go on meanwhile. The defaults of sizes and counts are fixed values.
    """

    path: str = "./storage.strata"
    max_memtable_size: int = 5 << 20
    num_levels: int = 5
    max_open_files: int = 1_000_000
    max_key_block_size: int = 512
    block_restart_interval: int = 16
    log_level_stats: str | None = None
    compaction_concurrency: int = 4
    seek_based_compaction: int | None = 10
    separate_values: bool = False
    compression: str = "snappy"
    bloom_filters: bool = True
    background: bool = False

    def check(self) -> None:
        if not str(self.path).strip():
            raise InvalidParams("the path must not be empty")
        if self.num_levels < 1:
            raise InvalidParams("a store needs one level at least")
        if self.max_memtable_size < 1 or self.compaction_concurrency < 1:
            raise InvalidParams("sizes and counts must be positive")


@dataclass(frozen=True)
class WriteOptions:
    """sync: the write returns only when the log is on disk."""

    sync: bool = True


class WriteBatch:
    """Operations in order; nothing happens before the batch is written."""

    def __init__(self) -> None:
        self.operations: list[tuple[int, bytes, bytes | None]] = []

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.operations.append((PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.operations.append((DELETE, bytes(key), None))
        return self

    def __len__(self) -> int:
        return len(self.operations)

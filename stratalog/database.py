"""A durable, ordered key-value store on Spark: write-ahead log, memtable, levels of sorted tables, one manifest.

One process writes a store, in as many threads as it likes. Small writes go to the log and to the memtable on the driver;
``write_df`` takes a DataFrame of any size straight to a sorted table. Reads bind one manifest version and a copy of the
memtables, so a scan is a snapshot. Flush order is table, then manifest, then log: a crash at any point loses nothing and
leaves no half batch.

A full memtable is frozen and a new one takes its place. By default the writer then flushes and compacts itself; with
``Params.background`` a thread of the store does, and a writer waits only if the memtable is full again before that is done.
"""

from __future__ import annotations

import csv
import threading
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import DELETE, PUT, STORED, InvalidParams, Params, StartMode, StorageError, WriteBatch, WriteOptions
from .operators import scans as ops
from .operators import values as sep
from .operators.batch import assign_sequence, frame_of
from .operators.compaction import Plan, merge, moved, pick, prune
from .operators.resolve import latest, live
from .sources import log as wal
from .sources.files import Files
from .sources.manifest import Manifest, commit, load
from .sources.tables import dealt, in_order, parts_of, read_tables, read_values, tasks_of, write_table, write_values

#: Batches of a wide segment that stay in log and memtable at most.
MOST_KEPT = 1000


class Memtable:
    """The newest version of each recently written key, with the sizes of keys and values."""

    def __init__(self) -> None:
        self.entries: dict[bytes, tuple[int, int, bytes | None]] = {}
        self.size = 0

    def apply(self, seq: int, op: int, key: bytes, value: bytes | None) -> None:
        old = self.entries.get(key)
        if old is not None:
            self.size -= len(key) + len(old[2] or b"")
        self.entries[key] = (seq, op, value)
        self.size += len(key) + len(value or b"")

    def rows(self, low: bytes | None = None, high: bytes | None = None) -> list[tuple]:
        """(key, seq, op, value) in key order, of the closed range."""
        return [(k, *self.entries[k]) for k in sorted(self.entries) if (low is None or k >= low) and (high is None or k <= high)]


def _bytes():
    """Bytes of keys and values."""
    return F.sum((F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long"))


def _sizes(tables: list) -> tuple[int, int]:
    """Entries and bytes of tables."""
    return sum(t.num_entries for t in tables), sum(t.size_bytes for t in tables)


class Database:
    def __init__(self, spark: SparkSession, mode: StartMode = StartMode.CREATE_OR_OPEN, params: Params | None = None):
        self.spark, self.params = spark, params or Params()
        self.params.check()
        self.files = Files(spark, str(self.params.path))
        if self.files.is_file():
            raise InvalidParams("the path is a file, not a folder")
        if mode is StartMode.CREATE_OR_OVERRIDE and self.files.exists():
            self.files.delete()
        found = load(self.files)
        if found is None and mode is StartMode.OPEN:
            raise StorageError("there is no store at this path")
        # _lock guards memtables and the manifest's reference and is held briefly; _work is held by who changes tables
        self._lock, self._work, self._closed, self._started = threading.RLock(), threading.RLock(), False, time.time()
        self.memtable, self._budget = Memtable(), {}
        self.frozen: Memtable | None = None
        self._thread, self._flushing = None, None
        if found is None:
            for folder in ("manifest", "log", "tables", "values"):
                self.files.make(folder)
            self.manifest = commit(self.files, Manifest(num_levels=self.params.num_levels, separate_values=self.params.separate_values))
            self.next_seq, segment = 1, 1
        else:
            if found.num_levels != self.params.num_levels or found.separate_values != self.params.separate_values:
                raise InvalidParams("the store was made with other levels or another value layout")
            self.manifest, self.next_seq, segment, wide = found, found.next_seq, max(found.log_floor, 1), []
            for number, seq, operations in wal.replay(self.files, found.log_floor):
                segment = number + 1
                if seq is None:
                    wide.append(number)
                else:
                    self._apply(seq, operations)
                    self.next_seq = max(self.next_seq, seq + len(operations))
            for name in self.files.names(wal.FOLDER):  # a segment whose only frame was torn
                if name.isdigit() and int(name) >= segment:
                    self.files.delete(f"{wal.FOLDER}/{name}")
        self.log = wal.Log(self.files, segment, self._apply)
        if found is not None and wide:  # a crash came before these were flushed; what the memtable holds is newer
            for number in wide:
                self._flush_wide(wal.read_wide(spark, self.files, number))
            self._freeze()
            self._flush_frozen()
            self.compact()

    def _apply(self, first_seq: int, operations: list) -> None:
        with self._lock:
            for i, (op, key, value) in enumerate(operations):
                self.memtable.apply(first_seq + i, op, key, value)

    # -- life cycle

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.stop()

    def stop(self) -> None:
        """Brings the log to disk and ends the background's work. The memtable is replayed from the log at the next opening."""
        if not self._closed:
            try:
                self._await_flush()
            finally:
                self._closed = True
                if self._thread is not None:
                    self._thread.shutdown()
                self.log.roll()

    close = stop

    def _open(self) -> None:
        if self._closed:
            raise StorageError("the store is closed")

    # -- writes

    def put(self, key: bytes, value: bytes, options: WriteOptions = WriteOptions()) -> None:
        self.write(WriteBatch().put(key, value), options)

    put_opts = put

    def delete(self, key: bytes, options: WriteOptions = WriteOptions()) -> None:
        """Writes a deletion, whether the key is there or not."""
        self.write(WriteBatch().delete(key), options)

    delete_opts = delete

    def write(self, batch: WriteBatch, options: WriteOptions = WriteOptions()) -> None:
        """Applies the batch in order; a reader sees all of it or nothing."""
        with self._lock:
            self._open()
            if not len(batch):
                return
            entry = self.log.enqueue(self.next_seq, batch.operations, options.sync)
            self.next_seq += len(batch)
        self.log.commit(entry)
        if self.memtable.size >= self.params.max_memtable_size:
            self._rotate()

    write_opts = write

    def _rotate(self) -> None:
        """The memtable is full: it is flushed, and what is due is compacted."""
        if not self.params.background:
            with self._work:
                if self.memtable.size >= self.params.max_memtable_size:
                    self._flush_now()
                    self.compact()
            return
        self._await_flush()
        with self._lock:
            if self._flushing is None and self.memtable.size >= self.params.max_memtable_size:
                if self._thread is None:
                    self._thread = ThreadPoolExecutor(1, "stratalog-flush")
                frozen = threading.Event()
                self._flushing = self._thread.submit(self._in_background, frozen)
            else:
                return
        frozen.wait()

    def _in_background(self, frozen: threading.Event) -> None:
        try:
            with self._work:
                if self.frozen is not None:  # what a flush that failed has left
                    self._flush_frozen()
                self._freeze()
                frozen.set()
                self._flush_frozen()
                self.compact()
        finally:
            frozen.set()

    def _await_flush(self) -> None:
        """Waits for the background; its failure is the caller's."""
        if (running := self._flushing) is not None:
            try:
                running.result()
            finally:
                with self._lock:
                    if self._flushing is running:
                        self._flushing = None

    def write_df(self, operations: DataFrame) -> None:
        """Applies a DataFrame of operations (ord from 0, key, op, value) as one batch: one sorted level-0 table, no log."""
        self._await_flush()
        with self._work:
            self._flush_now()
            self._bulk(operations)

    def _bulk(self, operations: DataFrame) -> None:
        top, count, size = operations.agg(F.max("ord"), F.count("*"), _bytes()).first()
        if count:
            with self._lock:
                base, self.next_seq = self.next_seq, self.next_seq + top + 1
            self._add_table(latest(assign_sequence(operations, base)), count, size)
            self.compact()

    def write_batches(self, operations: DataFrame, size: int) -> None:
        """Applies a DataFrame of operations (ord, key, op, value), ``size`` to a batch in the order of ord, through the log.

        Executors write the frames of all batches, which then appear in the log as one wide segment: from there on a crash
        loses none of them. What the memtable can't hold is flushed from it to a table and the log is cut; the last
        batches, up to a memtable's size, stay in log and memtable. A batch is seen whole or not at all, and only after those before it."""
        if size < 1:
            raise InvalidParams("a batch has one operation at least")
        self._await_flush()
        with self._work:
            self._flush_now()
            count, n_bytes = operations.agg(F.count("*"), _bytes()).first()
            if not count:
                return
            with self._lock:
                base, self.next_seq = self.next_seq, self.next_seq + count
            parts = parts_of(count, n_bytes)
            rows = wal.numbered(operations, self._folder("log/.numbered"), parts)
            wal.write_wide(rows, self._folder("log/.wide"), base, size, parts)
            self.files.delete("log/.numbered")
            frames = wal.read_wide(self.spark, self.files, self.log.adopt("log/.wide"))
            start, kept = base + count, 0
            for r in frames.select("first", "size").orderBy(F.col("first").desc()).limit(MOST_KEPT).collect():
                kept += r["size"]
                if kept > self.params.max_memtable_size:
                    break
                start = r["first"]
            last = [wal.decode(bytes(r["frame"])) for r in frames.filter(F.col("first") >= start).select("first", "frame").orderBy("first").collect()]
            self._flush_wide(frames.filter(F.col("first") < start))
            self._freeze()
            with self._lock:
                alone = self.next_seq == base + count
                entries = [self.log.enqueue(seq, batch, True) for seq, batch in last] if alone else []
            for entry in entries:
                self.log.commit(entry)
            if not alone:  # others wrote meanwhile; the memtable holds nothing that is older than a table
                self._flush_wide(frames.filter(F.col("first") >= start))
            self._flush_frozen()
            self.compact()

    def _flush_wide(self, frames: DataFrame) -> None:
        """Batches of a wide segment to a level-0 table; the log is not cut yet."""
        count, size, top = frames.agg(F.sum("n"), F.sum("size"), F.max(F.col("first") + F.col("n"))).first()
        if count:
            with self._lock:
                self.next_seq = max(self.next_seq, top)
            self._add_table(latest(wal.wide_entries(frames)), count, size)

    def write_entries(self, entries: DataFrame) -> None:
        """Adds entries (key, seq, op, value) that bring their own sequence numbers, from 0, in whatever order they arrive.

        Numbers count from the store's own at the first call, so that entries lose to and win over each other by them alone
        and win over all that was written before; what is written later by other ways wins over all entries so far. Such a
        store keeps its deletions: one that is gone couldn't hide an older version that arrives late. Entries that are
        added again change nothing."""
        self._await_flush()
        with self._work:
            self._flush_now()
            top, count, size = entries.agg(F.max("seq"), F.count("*"), _bytes()).first()
            if not count:
                return
            with self._lock:
                base = self.manifest.source_base if self.manifest.source_base is not None else self.next_seq
                self.manifest = replace(self.manifest, source_base=base)  # committed with the table
                self.next_seq = max(self.next_seq, base + top + 1)
            value = F.when(F.col("op") == PUT, F.col("value"))
            numbered = entries.select("key", (F.col("seq").cast("long") + F.lit(base).cast("long")).alias("seq"), F.col("op").cast("byte").alias("op"), value.alias("value"))
            self._add_table(latest(numbered), count, size)
            self.compact()

    def synchronize(self) -> None:
        """Brings earlier writes that did not wait to disk."""
        self.log.sync()

    # -- reads

    def entries(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Snapshot of all stored versions (STORED schema) of the closed key range; tables outside it are left out."""
        with self._lock:
            self._open()
            recent, tables = self.memtable.rows(low, high), list(self.manifest.tables)
            if self.frozen is not None:
                recent = self.frozen.rows(low, high) + recent
        stored = read_tables(self.spark, tables, low, high)
        if not recent:
            return stored
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in STORED.fields[4:]]
        return stored.unionByName(frame_of(self.spark, recent).select("*", *none))

    def _deal(self, batches: tuple[int, ...]):
        """Deals what is joined with these value batches."""
        sizes = [self.manifest.batch_sizes.get(b, (0, 0)) for b in batches]
        count, size = sum(n for n, _ in sizes), sum(s for _, s in sizes)
        return lambda rows, *columns: dealt(rows, count, size, *columns)

    def _scan(self, live_rows, reverse: bool = False, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """key and value of the live rows of entries, in the order of keys; low, high: the closed range that they lie in.

        Entries are dealt by key before they are ranked: a table holds a key once, so ranking before the shuffle, as elsewhere,
        would only sort whole splits of its files."""
        entries, m = self.entries(low, high), self.manifest
        tables = prune(m.tables, low, high)
        count, size = _sizes(tables)
        if low is not None and tasks_of(self.spark, count, size):  # of large tables a range may be very little
            n = read_tables(self.spark, tables).filter((F.col("key") >= F.lit(low)) & (F.col("key") <= F.lit(high))).count()
            count, size = n, size * n // count
        rows = live_rows(dealt(entries, count, size, "key"))
        if m.separate_values:
            rows = sep.dereference(rows, read_values(self.spark, self._folder("values"), m.batches), self._deal(m.batches)).select("key", "value")
            total, value_size = map(sum, zip((0, 0), *(m.batch_sizes.get(b, (0, 0)) for b in m.batches)))
            size += value_size * count // max(total, count, 1)
        else:
            rows = rows.drop("batch_id", "offset")
        return in_order(rows, count, size, reverse)

    def get(self, key: bytes) -> bytes | None:
        """The key's value. The memtables answer without a job, newest first; else one job reads the tables whose range holds
        the key (Parquet's statistics and Bloom filters leave out most of their rows), and a second one, by batch and offset,
        a value that is stored apart."""
        with self._lock:
            self._open()
            for table in (self.memtable, self.frozen):
                if table is not None and (hit := table.entries.get(bytes(key))) is not None:
                    return hit[2] if hit[1] == PUT else None
            probed = prune(self.manifest.tables, key, key)
        if not probed:
            return None
        rows = read_tables(self.spark, probed).filter(F.col("key") == F.lit(key))
        found = latest(rows.withColumn("_file", F.input_file_name())).first()
        self._sought([t for t in probed if found is None or f"/tables/{t.path.rpartition('/')[2]}/" not in found["_file"]])
        if found is None or found["op"] != PUT:
            return None
        if found["batch_id"] is not None:
            found = sep.value_at(read_values(self.spark, self._folder("values"), (found["batch_id"],)), found["offset"]).first()
        return bytes(found["value"])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """key, value, found for each distinct key asked for; tables outside the keys' range are left out."""
        low, high = keys.agg(F.min("key"), F.max("key")).first()
        bounds = (None, None) if low is None else (bytes(low), bytes(high))
        found = ops.multi_get(self.entries(*bounds), keys)
        return sep.dereference(found, read_values(self.spark, self._folder("values"), self.manifest.batches)) if self.params.separate_values else found.drop("batch_id", "offset")

    def scan(self) -> DataFrame:
        return self._scan(live)

    def reverse_scan(self) -> DataFrame:
        return self._scan(live, True)

    def range_scan(self, low: bytes, high: bytes) -> DataFrame:
        """low <= key < high, ascending."""
        ops.check_bounds(low, high)
        return self._scan(lambda entries: ops.range_scan(entries, low, high), False, low, high)

    def reverse_range_scan(self, high: bytes, low: bytes) -> DataFrame:
        """low < key <= high, descending."""
        ops.check_bounds(low, high)
        return self._scan(lambda entries: ops.reverse_range_scan(entries, high, low), True, low, high)

    @staticmethod
    def _pairs(rows: DataFrame) -> Iterator[tuple[bytes, bytes]]:
        for row in rows.toLocalIterator(prefetchPartitions=True):
            yield bytes(row["key"]), bytes(row["value"])

    def iter(self) -> Iterator[tuple[bytes, bytes]]:
        return self._pairs(self.scan())

    def reverse_iter(self) -> Iterator[tuple[bytes, bytes]]:
        return self._pairs(self.reverse_scan())

    def range_iter(self, low: bytes, high: bytes) -> Iterator[tuple[bytes, bytes]]:
        return self._pairs(self.range_scan(low, high))

    def reverse_range_iter(self, high: bytes, low: bytes) -> Iterator[tuple[bytes, bytes]]:
        return self._pairs(self.reverse_range_scan(high, low))

    # -- maintenance

    def _folder(self, name: str) -> str:
        return f"{self.files.root}/{name}"

    def _commit(self, change) -> None:
        """Publishes what change makes of the manifest."""
        with self._lock:
            self.manifest = commit(self.files, change(self.manifest))

    def _add_table(self, entries: DataFrame, count: int, size: int, floor: int | None = None) -> None:
        """One level-0 table (and value batch) of resolved entries, and the commit that makes it visible. floor: the log below it is in tables."""
        m = self.manifest
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in STORED.fields[4:]]
        apart = self.params.separate_values
        if apart:
            numbered = entries.withColumn("offset", F.monotonically_increasing_id())  # a place, not an order
            path = self._folder(f"values/.staged-{m.next_batch}")
            numbered.write.mode("overwrite").parquet(path)
            numbered = self.spark.read.parquet(path)
            write_values(numbered.filter(F.col("op") == PUT), self._folder("values"), m.next_batch, self.params, count, size)
            put = F.col("op") == PUT
            entries = numbered.select("key", "seq", "op", F.lit(None).cast("binary").alias("value"), F.when(put, F.lit(m.next_batch)).cast("long").alias("batch_id"), F.when(put, F.col("offset")).alias("offset"))
        else:
            entries = entries.select("key", "seq", "op", "value", *none)
        table = write_table(entries, self._folder(f"tables/{m.next_table}"), m.next_table, 0, self.params, count, size)
        self.files.delete(f"values/.staged-{m.next_batch}")
        if table is not None:
            floor = m.log_floor if floor is None else floor
            batches = (*m.batches, m.next_batch) if apart else m.batches
            sizes = m.batch_sizes | {m.next_batch: (count, size)} if apart else m.batch_sizes
            self._commit(lambda now: replace(now.with_tables(add=[table]), next_table=m.next_table + 1, next_batch=m.next_batch + apart, batches=batches, batch_sizes=sizes, next_seq=self.next_seq, log_floor=floor))
            self._log_levels()

    def _freeze(self) -> None:
        """The memtable becomes the frozen one; the log goes on in a new segment, so that older ones hold the frozen one alone."""

        def swap(next_segment: int) -> None:
            with self._lock:
                self._floor, self.frozen, self.memtable = next_segment, self.memtable, Memtable()

        self.log.roll(swap)

    def _flush_frozen(self) -> None:
        rows = self.frozen.rows()
        if rows:
            self._add_table(frame_of(self.spark, rows), len(rows), self.frozen.size, self._floor)
        elif self.manifest.log_floor < self._floor:
            self._commit(lambda now: replace(now, next_seq=self.next_seq, log_floor=self._floor))
        self.log.truncate(self.manifest.log_floor)
        with self._lock:
            self.frozen = None

    def flush(self) -> bool:
        """Memtable to a level-0 table; then the log is cut."""
        self._await_flush()
        with self._work:
            return self._flush_now()

    def _flush_now(self) -> bool:
        self._open()
        if self.frozen is not None:  # what a flush that failed has left
            self._flush_frozen()
        if not self.memtable.entries:
            return False
        self._freeze()
        self._flush_frozen()
        return True

    def compact_once(self) -> Plan | None:
        """One step: a move, which edits the manifest alone, or a merge into one table of the next level."""
        with self._work:
            self._open()
            m = self.manifest
            plan = pick(list(m.tables), m.num_levels, m.cursor, {t for t, left in self._budget.items() if left <= 0})
            if plan is None:
                return None
            cursor = m.cursor | {plan.level: max(t.table_id for t in plan.parents)}
            for t in plan.parents:
                self._budget.pop(t.table_id, None)
            if plan.moves:
                self._commit(lambda now: replace(now.with_tables([moved(plan)], [*plan.parents]), cursor=cursor))
            else:
                old = [*plan.parents, *plan.children]
                ids, low, high = {t.table_id for t in old}, min(t.min_key for t in old), max(t.max_key for t in old)
                below = any(t.level > plan.level + 1 and t.overlaps(low, high) for t in m.tables)
                above = any(t.table_id not in ids and t.level <= plan.level + 1 and t.overlaps(low, high) for t in m.tables)
                # A deletion may go only if no other table could hold an older version of its key.
                count, size = _sizes(old)
                merged = merge(dealt(read_tables(self.spark, old), count, size, "key"), drop_deletions=not below and not above and m.source_base is None)
                table = write_table(merged, self._folder(f"tables/{m.next_table}"), m.next_table, plan.level + 1, self.params, count, size)
                self._commit(lambda now: replace(now.with_tables([table] if table else [], old), next_table=m.next_table + 1, cursor=cursor))
            self._log_levels()
            return plan

    def compact(self) -> int:
        """Steps until no level has work; gives their number."""
        steps = 0
        while self.compact_once() is not None:
            steps += 1
        return steps

    def vacuum(self) -> list[str]:
        """Deletes table and value folders that the current manifest doesn't name. Scans that bound an older one must be over."""
        with self._work:
            named = {t.path.rpartition("/")[2] for t in self.manifest.tables}
            gone = [f"tables/{n}" for n in self.files.names("tables") if n not in named]
            gone += [f"values/{n}" for n in self.files.names("values") if n not in {f"batch_id={b}" for b in self.manifest.batches}]
            for name in gone:
                self.files.delete(name)
            return gone

    def collect_garbage(self) -> dict[int, str]:
        """Drops value batches without live values and rewrites sparse ones through the normal write path."""
        self._await_flush()
        with self._work:
            self._open()
            if not self.params.separate_values:
                return {}
            self._flush_now()
            values, entries = read_values(self.spark, self._folder("values"), self.manifest.batches), dealt(self.entries(), *_sizes(self.manifest.tables), "key")
            actions = {r["batch_id"]: r["action"] for r in sep.garbage(sep.batch_liveness(values, entries, self._deal(self.manifest.batches))).collect()}  # a row for each batch
            sparse = [b for b, a in actions.items() if a == "rewrite"]
            if sparse:
                deal, wanted = self._deal(tuple(sparse)), F.col("batch_id").isin(sparse)
                kept = deal(sep.references(entries).filter(wanted), *sep.PLACE).join(deal(values.filter(wanted).drop("key"), *sep.PLACE), sep.PLACE)
                path = self._folder("values/.rewrite")
                kept.select("key", "value").write.mode("overwrite").parquet(path)
                again = self.spark.read.parquet(path)
                # the keys differ, so one sequence number serves them all
                self._bulk(again.select(F.lit(0).cast("long").alias("ord"), "key", F.lit(PUT).cast("byte").alias("op"), "value"))
                self.files.delete("values/.rewrite")
            if actions:
                left = tuple(b for b in self.manifest.batches if b not in actions)
                self._commit(lambda now: replace(now, batches=left, batch_sizes={b: n for b, n in now.batch_sizes.items() if b in left}))
            return actions

    def _sought(self, in_vain) -> None:
        """Tables that lookups read in vain too often are compacted: each has a budget by its size."""
        if self.params.seek_based_compaction is None:
            return
        with self._lock:
            for t in in_vain:
                left = self._budget.get(t.table_id, max(t.size_bytes // 1024, 1) * self.params.seek_based_compaction)
                self._budget[t.table_id] = left - 1
            spent = any(self._budget[t.table_id] <= 0 for t in in_vain)
        if spent:
            self.compact_once()

    def _log_levels(self) -> None:
        if self.params.log_level_stats:
            with open(self.params.log_level_stats, "a", newline="") as out:
                if not out.tell():
                    csv.writer(out).writerow(["time", *[f"level{i}" for i in range(self.manifest.num_levels)]])
                csv.writer(out).writerow([f"{time.time() - self._started:.3f}", *self.manifest.level_counts()])


__all__ = ["DELETE", "PUT", "Database", "Params", "StartMode", "WriteBatch", "WriteOptions"]

"""The store end to end: durability, maintenance and value separation."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from stratalog.database import Database
from stratalog.model import CorruptData, InvalidParams, Params, StartMode, StorageError, WriteBatch, WriteOptions
from stratalog.sources import log as wal
from stratalog.sources.manifest import load
from stratalog.streaming import ingest, latest_stream

NEW = StartMode.CREATE_OR_OVERRIDE


def params(tmp_path, **more):
    return Params(path=f"file://{tmp_path}/store", **more)


def batch(spark, n, value, delete_every=0):
    df = spark.range(n).select(F.col("id").alias("ord"), F.encode(F.format_string("key_%05d", "id"), "UTF-8").alias("key"), F.lit(1).cast("byte").alias("op"), F.encode(F.concat(F.lit(value), F.col("id").cast("string")), "UTF-8").alias("value"))
    return df.withColumn("op", F.when(F.col("ord") % delete_every == 0, 2).otherwise(1).cast("byte")) if delete_every else df


def test_put_get_delete_reopen(spark, tmp_path):
    db = Database(spark, NEW, params(tmp_path))
    assert db.get(b"Foo") is None
    db.put(b"Foo", b"Bar")
    db.put(b"Foo", b"Baz", WriteOptions(sync=False))
    db.put(b"empty", b"")
    db.delete(b"absent")
    db.synchronize()
    assert db.get(b"Foo") == b"Baz" and db.get(b"empty") == b"" and db.get(b"absent") is None
    seq = db.next_seq
    db.stop()
    with pytest.raises(StorageError):
        db.put(b"x", b"y")
    again = Database(spark, StartMode.OPEN, db.params)
    assert again.next_seq == seq == 5 and again.get(b"Foo") == b"Baz"
    again.put(b"Foo", b"a much longer value than before")
    again.delete(b"empty")
    again.stop()
    third = Database(spark, StartMode.OPEN, db.params)
    assert list(third.iter()) == [(b"Foo", b"a much longer value than before")]


def test_start_modes_and_params(spark, tmp_path):
    with pytest.raises(StorageError):
        Database(spark, StartMode.OPEN, params(tmp_path))
    with pytest.raises(InvalidParams):
        Database(spark, NEW, Params(path=" "))
    with pytest.raises(InvalidParams):
        Database(spark, NEW, params(tmp_path, num_levels=0))
    (tmp_path / "file").write_text("x")
    with pytest.raises(InvalidParams):
        Database(spark, NEW, Params(path=f"file://{tmp_path}/file"))
    with Database(spark, StartMode.CREATE_OR_OPEN, params(tmp_path)) as db:
        db.put(b"a", b"1")
    with Database(spark, StartMode.CREATE_OR_OPEN, params(tmp_path)) as db:
        assert db.get(b"a") == b"1"
    with pytest.raises(InvalidParams):
        Database(spark, StartMode.OPEN, params(tmp_path, num_levels=3))
    with Database(spark, NEW, params(tmp_path)) as db:
        assert db.get(b"a") is None


def test_torn_log_tail_is_left_out(spark, tmp_path):
    db = Database(spark, NEW, params(tmp_path))
    db.put(b"a", b"1")
    db.write(WriteBatch().put(b"b", b"2").delete(b"a"))
    db.stop()
    last = sorted((tmp_path / "store" / "log").glob("0*"))[-1]
    crc = last.with_name(f".{last.name}.crc")
    last.write_bytes(last.read_bytes()[:-3])
    crc.unlink(missing_ok=True)
    again = Database(spark, StartMode.OPEN, db.params)
    assert list(again.iter()) == [(b"a", b"1")]  # the torn batch is gone as a whole
    again.put(b"c", b"3")
    again.stop()
    assert list(Database(spark, StartMode.OPEN, db.params).iter()) == [(b"a", b"1"), (b"c", b"3")]


def test_log_segments():
    ops = [(1, b"\x01\x02", b"\x02\x03"), (2, b"k", None), (1, b"", b"")]
    assert wal.decode(wal.encode(7, ops)) == (7, ops)
    with pytest.raises(CorruptData):
        wal.decode(wal.encode(7, ops)[:-1])


def test_scans_see_memtable_and_tables(spark, tmp_path):
    db = Database(spark, NEW, params(tmp_path))
    db.write_df(batch(spark, 100, "v"))
    db.write(WriteBatch().delete(b"key_00005").put(b"key_00007", b"new").put(b"zzz", b"last"))
    assert db.get(b"key_00005") is None and db.get(b"key_00006") == b"v6" and db.get(b"key_00007") == b"new"
    held = db.scan()  # a snapshot
    db.delete(b"key_00006")
    assert held.count() == 100
    found = list(db.range_iter(b"key_00004", b"key_00009"))
    assert found == [(b"key_00004", b"v4"), (b"key_00007", b"new"), (b"key_00008", b"v8")]
    assert list(db.reverse_range_iter(b"key_00008", b"key_00004")) == found[:0:-1]
    assert next(db.reverse_iter()) == (b"zzz", b"last")
    with pytest.raises(InvalidParams):
        db.range_scan(b"b", b"a")
    asked = spark.createDataFrame([(bytearray(b"key_00005"),), (bytearray(b"zzz"),)], "key binary")
    assert {(bytes(r.key), r.found) for r in db.multi_get(asked).collect()} == {(b"key_00005", False), (b"zzz", True)}


def test_flush_compaction_and_reads_after(spark, tmp_path):
    p = params(tmp_path, max_memtable_size=200, log_level_stats=str(tmp_path / "levels.csv"))
    db = Database(spark, NEW, p)
    for i in range(6):  # every batch flushes
        db.write(WriteBatch().put(b"a%d" % i, b"x" * 200).put(b"same", b"%d" % i))
    assert not db.memtable.entries and sum(db.manifest.level_counts()) < 6
    assert db.get(b"same") == b"5" and len(list(db.iter())) == 7
    assert not [n for n in os.listdir(tmp_path / "store" / "log") if n.isdigit()]
    db.vacuum()
    assert len(list(db.iter())) == 7
    db.stop()
    assert len(list(Database(spark, StartMode.OPEN, p).iter())) == 7
    assert (tmp_path / "levels.csv").read_text().startswith("time,level0,level1")
    assert load(db.files).version == db.manifest.version


def test_deletions_survive_compaction(spark, tmp_path):
    db = Database(spark, NEW, params(tmp_path))
    db.write_df(batch(spark, 50, "old"))
    while db.compact_once():
        pass
    for _ in range(5):
        db.write_df(batch(spark, 50, "new", delete_every=10))
    assert db.manifest.level_counts()[1] >= 1
    assert [k for k, _ in db.iter()] == [b"key_%05d" % i for i in range(50) if i % 10]


def test_value_separation_and_garbage(spark, tmp_path):
    p = params(tmp_path, separate_values=True)
    db = Database(spark, NEW, p)
    db.write_df(batch(spark, 40, "one"))
    db.write_df(batch(spark, 38, "two"))  # 2 of 40 values of the first batch live on
    db.put(b"key_00003", b"three")
    assert db.get(b"key_00003") == b"three" and db.get(b"key_00004") == b"two4" and db.get(b"key_00039") == b"one39"
    want = {k: v for k, v in db.iter()}
    assert db.collect_garbage() == {1: "rewrite"}
    assert {k: v for k, v in db.iter()} == want and len(want) == 40
    db.write_df(batch(spark, 40, "x"))
    assert set(db.collect_garbage().values()) == {"drop"} and db.get(b"key_00039") == b"x39"
    db.vacuum()
    db.stop()
    assert len(list(Database(spark, StartMode.OPEN, p).iter())) == 40


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    rows = [(bytearray(b"a"), 1, 1, bytearray(b"1")), (bytearray(b"b"), 2, 1, bytearray(b"2")), (bytearray(b"a"), 3, 2, None)]
    schema = "key binary, seq long, op byte, value binary"
    spark.createDataFrame(rows, schema).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    query = latest_stream(stream).writeStream.outputMode("update").format("memory").queryName("newest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(120)
    assert {(bytes(r.key), r.seq, r.op) for r in spark.table("newest").collect()} == {(b"a", 3, 2), (b"b", 2, 1)}
    db = Database(spark, NEW, params(tmp_path))
    ingest(stream, db, str(tmp_path / "c2")).awaitTermination(120)
    assert list(db.iter()) == [(b"b", b"2")]


def test_many_unsynced_puts_hold_one_file(spark, tmp_path):
    db = Database(spark, NEW, params(tmp_path))
    jvm = spark._jvm.java.lang.management.ManagementFactory.getOperatingSystemMXBean()
    db.put(b"0", b"first", WriteOptions(sync=True))
    before = jvm.getOpenFileDescriptorCount()
    for i in range(20_000):
        db.put(b"%d" % i, b"some_string_%d" % i, WriteOptions(sync=False))
    assert jvm.getOpenFileDescriptorCount() - before < 20
    assert all(db.get(b"%d" % i) == b"some_string_%d" % i for i in range(0, 20_000, 97))
    db.synchronize()
    assert len([n for n in os.listdir(tmp_path / "store" / "log") if n.isdigit()]) == 1
    again = Database(spark, StartMode.OPEN, db.params)  # what was synchronised is there without a stop
    assert again.next_seq == 20_002 and again.get(b"19999") == b"some_string_19999"
    db.stop()


def test_segments_roll_and_replay_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wal, "SEGMENT_BYTES", 200)
    db = Database(spark, NEW, params(tmp_path))
    for i in range(50):
        db.put(b"k%d" % (i % 7), b"v%d" % i)
    db.stop()
    names = sorted(n for n in os.listdir(tmp_path / "store" / "log") if n.isdigit())
    assert len(names) > 5
    assert Database(spark, StartMode.OPEN, db.params).memtable.entries[b"k0"][2] == b"v49"
    (tmp_path / "store" / "log" / names[3]).unlink()  # what follows a gap never happened
    assert Database(spark, StartMode.OPEN, db.params).next_seq < 50
    assert sorted(n for n in os.listdir(tmp_path / "store" / "log") if n.isdigit()) == names[:3]


def test_threads_commit_in_groups(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    db = Database(spark, NEW, params(tmp_path))
    syncs, flush = [], db.log._flush
    db.log._flush = lambda sync: (syncs.append(sync), time.sleep(0.005), flush(sync))
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda i: db.write(WriteBatch().put(b"t%03d" % i, b"%d" % i).put(b"last", b"%d" % i)), range(200)))
    assert len(syncs) < 150
    again = Database(spark, StartMode.OPEN, db.params)
    assert again.memtable.entries == db.memtable.entries and len(db.memtable.entries) == 201 and db.next_seq == 401
    db.stop()


@pytest.mark.parametrize("background", [False, True])
def test_random_operations_against_a_dictionary(spark, tmp_path, background):
    rnd = random.Random(6)
    p, want = params(tmp_path, max_memtable_size=20_000, background=background), {}
    db = Database(spark, NEW, p)
    for k in range(700):
        key = b"key%d" % rnd.randrange(300)
        if rnd.random() < 0.2:
            db.delete(key, WriteOptions(sync=False))
            want.pop(key, None)
        else:
            want[key] = rnd.randbytes(rnd.choice([0, 1, 100, 100, 5_000 if k % 50 == 0 else 10]))
            db.put(key, want[key], WriteOptions(sync=k % 10 == 0))
        if k % 100 == 99:
            db.synchronize()
            some = rnd.choice(sorted(want))
            assert db.get(some) == want[some]
    assert list(db.iter()) == sorted(want.items()) and list(db.reverse_iter()) == sorted(want.items(), reverse=True)
    assert sum(db.manifest.level_counts()) > 0
    asked = spark.createDataFrame([(bytearray(b"key%d" % i),) for i in range(300)], "key binary")
    assert {bytes(r.key): bytes(r.value) for r in db.multi_get(asked).collect() if r.found} == want
    db.stop()
    assert list(Database(spark, StartMode.OPEN, p).iter()) == sorted(want.items())


def test_large_and_variable_entries(spark, tmp_path):
    db = Database(spark, NEW, params(tmp_path))
    big = random.Random(1).randbytes(6 << 20)  # larger than a memtable
    db.put(b"big", big)
    assert not db.memtable.entries and db.get(b"big") == big
    for i in range(40):
        db.put(b"v%d" % i, b"x" * i * 100, WriteOptions(sync=False))
    assert [len(v) for _, v in db.range_iter(b"v0", b"w")] == [i * 100 for i in sorted(range(40), key=lambda i: b"v%d" % i)]
    db.stop()


def change(spark, *rows):
    return spark.createDataFrame([(bytearray(k), s, o, None if v is None else bytearray(v)) for k, s, o, v in rows], "key binary, seq long, op byte, value binary")


def test_late_and_repeated_changes_lose(spark, tmp_path):
    db = Database(spark, NEW, params(tmp_path))
    db.put(b"z", b"before the stream")
    first = change(spark, (b"a", 10, 1, b"new"), (b"b", 11, 2, None), (b"c", 1, 1, b"c1"), (b"z", 0, 1, b"of the stream"))
    db.write_entries(first)
    db.write_entries(change(spark, (b"a", 5, 1, b"OLD"), (b"b", 6, 1, b"OLD"), (b"c", 12, 1, b"c12")))
    want = [(b"a", b"new"), (b"c", b"c12"), (b"z", b"of the stream")]
    assert list(db.iter()) == want
    db.put(b"a", b"written since")
    db.write_entries(first)  # delivered again
    want[0] = (b"a", b"written since")
    assert list(db.iter()) == want
    for i in range(5):  # compaction must not forget that b was deleted
        db.write_entries(change(spark, (b"d", 20 + i, 1, b"d"), (b"b", 2 + i, 1, b"OLD")))
    while db.compact_once():
        pass
    db.stop()
    again = Database(spark, StartMode.OPEN, db.params)
    again.write_entries(change(spark, (b"b", 7, 1, b"OLD"), (b"c", 2, 1, b"OLD")))
    assert list(again.iter()) == [*want[:2], (b"d", b"d"), want[2]]


def test_stream_with_late_micro_batches(spark, tmp_path):
    schema, src = "key binary, seq long, op byte, value binary", tmp_path / "src"
    db = Database(spark, NEW, params(tmp_path))
    for rows in ([(b"a", 10, 1, b"new"), (b"b", 3, 1, b"b")], [(b"a", 5, 1, b"OLD"), (b"b", 4, 2, None)]):
        change(spark, *rows).write.mode("append").parquet(str(src))
        ingest(spark.readStream.schema(schema).parquet(str(src)), db, str(tmp_path / "cp")).awaitTermination(120)
    ingest(spark.readStream.schema(schema).parquet(str(src)), db, str(tmp_path / "cp2")).awaitTermination(120)  # all of it again
    assert list(db.iter()) == [(b"a", b"new")]


def footer(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"file://{next(folder.rglob('*.parquet'))}")
    file = spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, spark._jsc.hadoopConfiguration())
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        return {c.getPath().toDotString(): (c.getEncodings().toString(), c.getBloomFilterOffset()) for c in reader.getFooter().getBlocks()[0].getColumns()}
    finally:
        reader.close()


def test_tables_have_prefixes_and_bloom_filters(spark, tmp_path):
    db = Database(spark, NEW, params(tmp_path))
    db.write_df(batch(spark, 5000, "v"))
    encodings, bloom = footer(spark, tmp_path / "store" / "tables")["key"]
    assert "DELTA_BYTE_ARRAY" in encodings and bloom > 0
    off = Database(spark, NEW, params(tmp_path, bloom_filters=False))
    off.write_df(batch(spark, 100, "v"))
    assert footer(spark, tmp_path / "store" / "tables")["key"][1] <= 0 and off.get(b"key_00042") == b"v42"


def test_values_are_looked_up_by_place(spark, tmp_path, monkeypatch):
    from stratalog.operators import values
    from stratalog.sources import tables

    monkeypatch.setattr(tables, "FILE_BYTES", 10_000)
    db = Database(spark, NEW, params(tmp_path, separate_values=True))
    db.write_df(batch(spark, 3000, "some value "))
    assert len(list((tmp_path / "store" / "values").rglob("*.parquet"))) > 3  # a large batch is several files
    assert db.get(b"key_01234") == b"some value 1234" and db.get(b"nothing") is None
    plan = values.value_at(tables.read_values(spark, db._folder("values"), db.manifest.batches), 7)._jdf.queryExecution().toString()
    assert "EqualTo(offset,7)" in plan and "Join" not in plan


def test_tables_sought_in_vain_are_compacted(spark, tmp_path):
    db = Database(spark, NEW, params(tmp_path, seek_based_compaction=2))
    for value, keys in (("one", range(0, 10)), ("two", range(0, 10, 2))):
        db.write_df(batch(spark, 10, value).filter(F.col("ord").isin(*keys)))
    assert db.manifest.level_counts()[:2] == [2, 0]
    for _ in range(3):
        assert db.get(b"key_00004") == b"two4"  # the older table is read in vain: the newer one has the newest version
    assert db.manifest.level_counts()[:2] == [0, 1] and db.get(b"key_00005") == b"one5" and db.get(b"key_00004") == b"two4"
    never = Database(spark, NEW, params(tmp_path, seek_based_compaction=None))
    never.write_df(batch(spark, 10, "v"))
    assert [never.get(b"key_00001x") for _ in range(5)] == [None] * 5 and never.manifest.level_counts()[0] == 1


def test_a_failed_write_is_nobody_s_success(spark, tmp_path):
    """If writing a group fails, every writer of it hears of it, and the store takes no more until it is opened again."""
    from concurrent.futures import ThreadPoolExecutor

    db = Database(spark, NEW, params(tmp_path))
    db.put(b"a", b"1")
    flush = db.log._flush

    def broken(sync):
        time.sleep(0.02)
        raise OSError("no space left")

    db.log._flush = broken
    with ThreadPoolExecutor(8) as pool:
        ended = [f.exception() for f in [pool.submit(db.put, b"k%d" % i, b"v") for i in range(30)]]
    assert all(isinstance(e, (OSError, StorageError)) for e in ended)
    db.log._flush = flush
    with pytest.raises(StorageError):
        db.put(b"b", b"2")
    assert db.get(b"k1") is None and list(Database(spark, StartMode.OPEN, db.params).iter()) == [(b"a", b"1")]


def ordered(spark, n, dead=lambda i: i % 7 == 0, start=0):
    """n operations on n / 2 keys; their places are far apart, and the rows come in no order."""
    rows = [(start + 10 * i, bytearray(b"key_%05d" % (i % (n // 2))), 2 if dead(i) else 1, None if dead(i) else bytearray(b"value %d" % i)) for i in range(n)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "ord long, key binary, op byte, value binary")


def applied(n, dead=lambda i: i % 7 == 0):
    model = {}
    for i in range(n):
        model[b"key_%05d" % (i % (n // 2))] = None if dead(i) else b"value %d" % i
    return {k: v for k, v in model.items() if v is not None}


def test_many_batches_go_through_the_log_side_by_side(spark, tmp_path, monkeypatch):
    from stratalog.sources import tables

    monkeypatch.setattr(tables, "FILE_ENTRIES", 700)  # several parts, whose borders are not those of batches
    db = Database(spark, StartMode.CREATE_OR_OVERRIDE, Params(path=f"file://{tmp_path}/s", max_memtable_size=4000))
    db.put(b"before", b"x")
    first, held = db.next_seq, []
    monkeypatch.setattr(db.log, "adopt", lambda folder, adopt=db.log.adopt: held.append(wal.read_wide(spark, db.files, n := adopt(folder)).orderBy("first").collect()) or n)
    db.write_batches(ordered(spark, 3000), 50)
    frames = [wal.decode(bytes(r["frame"])) for r in held[0]]
    assert [(seq, len(batch)) for seq, batch in frames] == [(first + 50 * i, 50) for i in range(60)]
    assert [key for _, batch in frames for _, key, _ in batch] == [b"key_%05d" % (i % 1500) for i in range(3000)]
    want = applied(3000) | {b"before": b"x"}
    assert dict(db.iter()) == want and 0 < db.memtable.size <= 4000  # the last batches are in the memtable,
    assert all(db.files.is_file(f"log/{n}") for n in db.files.names("log"))  # the wide segment is cut
    db.put(b"key_00001", b"after")
    db.stop()
    again = Database(spark, StartMode.OPEN, db.params)
    assert again.memtable.size > 0 and dict(again.iter()) == want | {b"key_00001": b"after"} and again.next_seq == first + 3001
    again.write_batches(ordered(spark, 0), 50)
    with pytest.raises(InvalidParams):
        again.write_batches(ordered(spark, 10), 0)


@pytest.mark.parametrize("where", ["_flush_wide", "_freeze", "_flush_frozen"])
def test_a_crash_after_the_wide_segment_loses_nothing(spark, tmp_path, monkeypatch, where):
    db = Database(spark, StartMode.CREATE_OR_OVERRIDE, Params(path=f"file://{tmp_path}/s", max_memtable_size=2000))

    def crash(*_):
        raise RuntimeError("crash")

    monkeypatch.setattr(db, where, crash)
    with pytest.raises(RuntimeError):
        db.write_batches(ordered(spark, 400), 20)
    for _ in range(2):
        db = Database(spark, StartMode.OPEN, db.params)
        assert dict(db.iter()) == applied(400) and db.next_seq == 401
        assert all(db.files.is_file(f"log/{n}") for n in db.files.names("log"))


def test_writes_meanwhile_win_over_many_batches(spark, tmp_path, monkeypatch):
    db = Database(spark, StartMode.CREATE_OR_OVERRIDE, Params(path=f"file://{tmp_path}/s"))
    monkeypatch.setattr(wal, "write_wide", lambda *a, write=wal.write_wide: (write(*a), db.put(b"key_00010", b"newer")))
    db.write_batches(ordered(spark, 400), 20)
    want = applied(400) | {b"key_00010": b"newer"}
    assert db.get(b"key_00010") == b"newer" and dict(db.iter()) == want
    db.stop()
    assert dict(Database(spark, StartMode.OPEN, db.params).iter()) == want


def test_short_values_are_sorted_in_several_tasks(spark, tmp_path, monkeypatch):
    from stratalog.sources import tables

    monkeypatch.setattr(tables, "FILE_ENTRIES", 1000)
    db = Database(spark, NEW, params(tmp_path, separate_values=True))
    db.write_df(batch(spark, 4000, "v"))  # far fewer bytes than a file may hold
    files = list((tmp_path / "store" / "values" / "batch_id=1").glob("*.parquet"))
    assert len(files) == 4 and max(spark.read.parquet(f"file://{f}").count() for f in files) < 1500
    assert db.get(b"key_00017") == b"v17" and dict(db.iter()) == {b"key_%05d" % i: b"v%d" % i for i in range(4000)}


def test_rewritten_short_values_are_sorted_in_several_tasks(spark, tmp_path, monkeypatch):
    from stratalog.sources import tables

    monkeypatch.setattr(tables, "FILE_ENTRIES", 500)
    db = Database(spark, NEW, params(tmp_path, separate_values=True))
    db.write_df(batch(spark, 6000, "v"))
    db.write_df(batch(spark, 4600, "w"))  # of the first batch 1400 values stay live: it is sparse
    assert db.collect_garbage() == {1: "rewrite"}
    rewritten = list((tmp_path / "store" / "values" / "batch_id=3").glob("*.parquet"))
    assert len(rewritten) == 3 and max(spark.read.parquet(f"file://{f}").count() for f in rewritten) < 800
    want = {b"key_%05d" % i: b"%s%d" % (b"w" if i < 4600 else b"v", i) for i in range(6000)}
    assert dict(db.reverse_iter()) == want


def test_scans_garbage_and_merges_of_large_tables_are_dealt(spark, tmp_path, monkeypatch):
    from stratalog import database
    from stratalog.sources import tables

    seen = {}

    def most(rows):  # rows of the task that gets most
        return max(r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect())

    def watched(module, name, at):
        plain = getattr(module, name)

        def run(*args, **more):
            seen[name] = most(args[at])
            return plain(*args, **more)

        monkeypatch.setattr(module, name, run)

    monkeypatch.setattr(tables, "FILE_ENTRIES", 500)
    watched(database.sep, "batch_liveness", 1)
    watched(database, "merge", 0)
    db = Database(spark, NEW, params(tmp_path, separate_values=True))
    for i in range(5):  # the fifth table makes level 0 too full
        db.write_df(batch(spark, 3000, "abcde"[i]))
    db.write_df(batch(spark, 10, "z"))
    assert seen["merge"] < 800  # of 15000
    assert set(db.collect_garbage().values()) == {"drop"} and seen["batch_liveness"] < 800
    want = {b"key_%05d" % i: b"%s%d" % (b"z" if i < 10 else b"e", i) for i in range(3000)}
    db.stop()
    db = Database(spark, StartMode.OPEN, db.params)
    assert set(db.manifest.batch_sizes) == set(db.manifest.batches)
    for rows, ways in ((db.scan(), 1), (db.reverse_scan(), -1)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "row_number(), 1, Partial" not in plan and "SinglePartition" not in plan
        dealt = [int(n) for n in re.findall(r"partitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan)]
        assert len(dealt) >= 4 and min(dealt) >= 6  # by key, both sides by place, by range of keys
        assert most(rows) < 800
        assert [(bytes(r["key"]), bytes(r["value"])) for r in rows.collect()] == sorted(want.items())[::ways]
    few = db.range_scan(b"key_00005", b"key_00015")
    assert [bytes(r["value"]) for r in few.collect()] == [want[b"key_%05d" % i] for i in range(5, 15)]
    assert few.rdd.getNumPartitions() < 6
    wide = db.reverse_range_scan(b"key_02500", b"key_00500")
    assert most(wide) < 800 and [bytes(r["key"]) for r in wide.collect()] == [b"key_%05d" % i for i in range(2500, 500, -1)]


def test_manifests_without_sizes_of_batches_are_read(spark, tmp_path):
    import json

    from stratalog.sources.manifest import Manifest

    now = Manifest(batches=(1, 2), batch_sizes={1: (5, 60), 2: (7, 80)})
    assert Manifest.decode(now.encode()) == now
    raw = json.loads(now.encode())
    del raw["batch_sizes"]
    assert Manifest.decode(json.dumps(raw).encode()) == Manifest(batches=(1, 2))

"""Resolution, scans, codecs and batches on small logs."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import bigint_key, composite_key, decode_bigint, double_key, padded_key, text_key
from stratalog.model import DELETE, PUT, InvalidParams, WriteBatch
from stratalog.operators import assign_sequence, batch_frame, first_n, frame_of, get, latest, live, multi_get, range_scan, reverse_range_scan, scan
from stratalog.operators.compaction import Table, capacity, closure, merge, pick, prune


def log(spark, n=25, step=1):
    return frame_of(spark, [(b"key_%05d" % i, i + 1, PUT, b"some_string_%d" % i) for i in range(0, n * step, step)])


def keys(rows):
    return [bytes(r["key"]) for r in rows.collect()]


def test_newest_version_wins_and_deletions_hide(spark):
    e = frame_of(spark, [(b"a", 1, PUT, b"1"), (b"a", 3, PUT, b"3"), (b"a", 2, PUT, b"2"), (b"b", 1, PUT, b"1"), (b"b", 2, DELETE, None), (b"c", 1, DELETE, None), (b"c", 2, PUT, b"")])
    assert {(bytes(r.key), r.seq) for r in latest(e).collect()} == {(b"a", 3), (b"b", 2), (b"c", 2)}
    assert {(bytes(r.key), bytes(r.value)) for r in live(e).collect()} == {(b"a", b"3"), (b"c", b"")}  # an empty value is a value


def test_random_log_against_a_dict(spark):
    rnd, state, entries = random.Random(7), {}, []
    for seq in range(1, 600):
        key = bytes([rnd.randrange(256)]) * rnd.randrange(1, 3)
        if rnd.random() < 0.3:
            entries.append((key, seq, DELETE, None))
            state.pop(key, None)
        else:
            entries.append((key, seq, PUT, b"%d" % seq))
            state[key] = b"%d" % seq
    rnd.shuffle(entries)
    assert [(bytes(r.key), bytes(r.value)) for r in scan(frame_of(spark, entries)).collect()] == sorted(state.items())


def test_range_bounds(spark):
    e = log(spark)
    low, high = b"key_00003", b"key_00010"
    assert keys(range_scan(e, low, high)) == [b"key_%05d" % i for i in range(3, 10)]
    assert keys(reverse_range_scan(e, high, low)) == [b"key_%05d" % i for i in range(10, 3, -1)]
    assert keys(range_scan(e, b"key_05300", b"key_10150")) == []
    for bad in ((low, low), (high, low)):
        with pytest.raises(InvalidParams):
            range_scan(e, *bad)
    assert keys(range_scan(log(spark, 10, 2500), b"key_00000", b"key_20000")) == [b"key_%05d" % i for i in range(0, 20000, 2500)]


def test_get_and_first_n(spark):
    e = log(spark)
    assert keys(get(e, b"key_00004")) == [b"key_00004"] and keys(get(e, b"nope")) == []
    assert keys(first_n(live(e), 2)) == [b"key_00000", b"key_00001"] and keys(first_n(live(e), 1, reverse=True)) == [b"key_00024"]
    asked = spark.createDataFrame([(bytearray(b"key_00001"),), (bytearray(b"x"),), (bytearray(b"x"),), (None,)], "key binary")
    assert {(bytes(r.key), r.found) for r in multi_get(e, asked).collect()} == {(b"key_00001", True), (b"x", False)}


def test_key_filter_reaches_the_scan(spark, tmp_path):
    log(spark).write.parquet(str(tmp_path / "t"))
    plan = range_scan(spark.read.parquet(str(tmp_path / "t")), b"key_00003", b"key_00010")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(key), GreaterThanOrEqual(key," in plan


def test_last_operation_of_a_batch_wins(spark):
    b = WriteBatch().put(b"k", b"1").delete(b"k").put(b"k", b"2").put(b"l", b"1").delete(b"l")
    e = assign_sequence(batch_frame(spark, b), 10)
    assert sorted(r.seq for r in e.collect()) == [10, 11, 12, 13, 14]
    assert [(bytes(r.key), bytes(r.value)) for r in live(e).collect()] == [(b"k", b"2")]


def test_codecs_keep_order(spark):
    numbers = [-(1 << 63), -5, -1, 0, 1, 255, 256, 1 << 40, (1 << 63) - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    out = df.select("n", bigint_key("n").alias("k"), decode_bigint(bigint_key("n")).alias("back")).orderBy("k").collect()
    assert [r.n for r in out] == numbers == [r.back for r in out] and all(len(r.k) == 8 for r in out)
    assert bytes(df.select(padded_key("key_", F.lit(7), 5).alias("k")).first().k) == b"key_00007"
    d = spark.createDataFrame([(-1.5,), (-0.25,), (0.0,), (2.75,)], "x double")
    assert [r.x for r in d.orderBy(double_key("x")).collect()] == [-1.5, -0.25, 0.0, 2.75]
    pair = spark.createDataFrame([(1, "b"), (1, "a"), (-1, "z")], "n long, t string")
    assert [(r.n, r.t) for r in pair.orderBy(composite_key(bigint_key("n"), text_key("t"))).collect()] == [(-1, "z"), (1, "a"), (1, "b")]


def table(i, low, high, level=0, size=100):
    return Table(i, level, low, high, 1, size, f"t{i}")


def test_compaction_planning():
    apart = [table(i, b"%04d" % (i * 100), b"%04d" % (i * 100 + 100 - 1)) for i in range(10)]
    plan = pick(apart, 5)
    assert plan.moves and plan.parents == (apart[0],)
    assert pick(apart[:4], 5) is None
    many = [table(i, b"000", b"100") for i in range(5)] + [table(9, b"050", b"150", level=1)]
    plan = pick(many, 5)
    assert len(plan.parents) == 5 and plan.children == (many[5],) and not plan.moves
    chain = [table(1, b"a", b"c"), table(2, b"b", b"e"), table(3, b"d", b"g"), table(4, b"x", b"z")]
    assert [t.table_id for t in closure(chain[0], chain)] == [1, 2, 3]
    assert [t.table_id for t in prune(chain, b"e", b"w")] == [2, 3] and len(prune(chain)) == 4
    full = [table(1, b"a", b"b", 1, 2 << 20), table(2, b"c", b"d", 1, 1)]
    assert pick(full, 5).parents == (full[0],) and pick(full, 5, {1: 1}).parents == (full[1],) and pick(full, 2) is None
    assert [capacity(i) for i in range(4)] == [1 << 20, 1 << 20, 10 << 20, 100 << 20]
    assert pick(chain[3:], 5, None, {4}).parents == (chain[3],)  # sought too often


def test_merge_keeps_deletions_unless_told(spark):
    e = frame_of(spark, [(b"a", 1, PUT, b"1"), (b"a", 2, DELETE, None), (b"b", 1, PUT, b"1")])
    assert merge(e).count() == 2 and merge(e, drop_deletions=True).count() == 1

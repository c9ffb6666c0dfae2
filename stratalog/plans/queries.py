"""Queries of the key-value operators over entry logs made from the given tables, with their SQL.

The main log is made of ``orders``: every order is put, a third overwritten, a tenth deleted. Keys and values are emitted as
text. Order is exposed as ``pos``, because results are compared as sets; ranks over all rows come from ranks within key
prefixes and the prefixes' sizes (see ``_pos``), not from one task.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..database import Database
from ..functions import bigint_key, decode_bigint, decode_text, padded_key, text_key
from ..model import DELETE, PUT, InvalidParams, Params, StartMode, WriteBatch
from ..operators import batch, compaction, scans, values
from ..operators.resolve import latest, live
from ..sources.manifest import Manifest, tables_frame
from ..streaming import ingest


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _entries(rows: DataFrame, key, seq, op, value) -> DataFrame:
    kind = F.lit(op).cast("byte") if isinstance(op, int) else op.cast("byte")
    return rows.select(key.alias("key"), seq.cast("long").alias("seq"), kind.alias("op"), (F.lit(None).cast("binary") if value is None else text_key(value)).alias("value"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts of all orders, overwrites of o_orderkey % 3 = 0, deletions of o_orderkey % 10 = 0, in one scan."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    change = lambda when, step, op, value: F.when(when, F.struct((k + step).alias("seq"), F.lit(op).alias("op"), value.cast("string").alias("v")))
    each = F.array(change(F.lit(True), 0, PUT, F.col("o_orderstatus")), change(k % 3 == 0, 1_000_000_000, PUT, F.concat(F.lit("v2_"), "o_orderpriority")), change(k % 10 == 0, 2_000_000_000, DELETE, F.lit(None)))
    rows = o.select("o_orderkey", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("c"))
    return _entries(rows, padded_key("order_", "o_orderkey", 8), F.col("c.seq"), F.col("c.op"), F.col("c.v"))


LOG = """log AS (
  SELECT printf('order_%08d', o_orderkey) AS key, o_orderkey AS seq, 1 AS op, o_orderstatus AS value FROM orders
  UNION ALL SELECT printf('order_%08d', o_orderkey), o_orderkey + 1000000000, 1, 'v2_' || o_orderpriority FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT printf('order_%08d', o_orderkey), o_orderkey + 2000000000, 2, NULL FROM orders WHERE o_orderkey % 10 = 0)"""
LIVE = "live AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op = 1)"
WITH = f"WITH {LOG}, {LIVE}"
BOUNDS = b"order_00000301", b"order_00001151"


def _text(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(decode_text("key").alias("key"), decode_text("value").alias("value"), *more)


def _pos(rows: DataFrame, reverse: bool = False, width: int = 10) -> DataFrame:
    """Adds pos, the place in key order from 1. Rows rank within their key's first ``width`` bytes (here ten thousand keys at most), prefixes add up the sizes of those before them within a prefix three bytes shorter, and these within the whole; only the sizes of the shortest prefixes (ten million keys each) meet in one task."""
    order = (lambda c: F.col(c).desc()) if reverse else F.col
    split = rows.withColumn("_prefix", F.substring("key", 1, width))
    sizes = split.groupBy("_prefix").agg(F.count("*").alias("_n")).withColumn("_group", F.substring("_prefix", 1, width - 3))
    groups = sizes.groupBy("_group").agg(F.sum("_n").alias("_m"))
    ahead = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("_group", ahead("_m", Window.orderBy(order("_group"))).alias("_far"))
    before = sizes.select("_group", "_prefix", ahead("_n", Window.partitionBy("_group").orderBy(order("_prefix"))).alias("_near")).join(groups, "_group").select("_prefix", (F.col("_near") + F.col("_far")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_prefix").orderBy(order("key")))
    return split.withColumn("_own", within).join(before, "_prefix").withColumn("pos", (F.col("_own") + F.col("_before")).cast("long")).drop("_prefix", "_own", "_before")


def live_scan(spark, sf_dir):
    return _text(live(order_log(spark, sf_dir)))


def ordered_scan(spark, sf_dir):
    return _text(_pos(live(order_log(spark, sf_dir))), "pos")


def reverse_scan(spark, sf_dir):
    return _text(_pos(live(order_log(spark, sf_dir)), True), "pos")


def _found(spark, sf_dir, key: bytes):
    """One row for the key, found or not, so that an empty result can be compared, too."""
    asked = spark.createDataFrame([(bytearray(key),)], "key binary")
    got = scans.get(order_log(spark, sf_dir), key).withColumn("found", F.lit(True))
    return _text(asked.join(got, "key", "left"), F.coalesce("found", F.lit(False)).alias("found"))


def _found_sql(key: str) -> str:
    return f"{WITH} SELECT k.key, value, value IS NOT NULL AS found FROM (SELECT '{key}' AS key) AS k LEFT JOIN live ON live.key = k.key"


def multi_get(spark, sf_dir):
    keys = _read(spark, sf_dir, "customer").select(padded_key("order_", "c_custkey", 8).alias("key"))
    return _text(scans.multi_get(order_log(spark, sf_dir), keys), "found")


def _range(low: bytes, high: bytes):
    return lambda spark, sf_dir: _text(_pos(scans.range_scan(order_log(spark, sf_dir), low, high)), "pos")


def _range_sql(low: bytes, high: bytes) -> str:
    return f"{WITH} SELECT key, value, row_number() OVER (ORDER BY key) AS pos FROM live WHERE key >= '{low.decode()}' AND key < '{high.decode()}'"


def reverse_range_scan(spark, sf_dir):
    return _text(_pos(scans.reverse_range_scan(order_log(spark, sf_dir), BOUNDS[1], BOUNDS[0]), True), "pos")


def first_n(spark, sf_dir):
    return _text(scans.first_n(live(order_log(spark, sf_dir)), 20))


def last_n(spark, sf_dir):
    return _text(scans.first_n(live(order_log(spark, sf_dir)), 20, reverse=True))


def _sparse_log(spark, sf_dir) -> DataFrame:
    """Puts of all orders, then deletions of all but o_orderkey % 250 = 0: live keys stand far apart, with deletions in the gaps."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    put = F.struct(k.cast("long").alias("seq"), F.lit(PUT).alias("op"), F.col("o_orderstatus").alias("v"))
    gone = F.when(k % 250 != 0, F.struct((k + 1_000_000_000).cast("long").alias("seq"), F.lit(DELETE).alias("op"), F.lit(None).cast("string").alias("v")))
    rows = o.select("o_orderkey", F.explode(F.filter(F.array(put, gone), lambda x: x.isNotNull())).alias("c"))
    return _entries(rows, padded_key("order_", "o_orderkey", 8), F.col("c.seq"), F.col("c.op"), F.col("c.v"))


def sparse_range(spark, sf_dir):
    """The range's live keys. Its bounds are those of the SQL and do not grow with the table."""
    return _text(_pos(scans.range_scan(_sparse_log(spark, sf_dir), b"order_00000000", b"order_00001250")), "pos")


def overlapping_ranges(spark, sf_dir):
    """Three ranges that overlap, counted over one log; each row may count in several."""
    log = order_log(spark, sf_dir)
    cuts = [("a", 280, 400), ("b", 350, 560), ("c", 550, 710)]
    hit = F.array(*[F.when((F.col("key") >= F.lit(b"order_%08d" % lo)) & (F.col("key") < F.lit(b"order_%08d" % hi)), F.lit(n)) for n, lo, hi in cuts])
    near = log.filter((F.col("key") >= F.lit(b"order_%08d" % 280)) & (F.col("key") < F.lit(b"order_%08d" % 710)))
    return live(near).select(F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("range")).groupBy("range").agg(F.count("*").alias("n"))


def override_all(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    put = lambda step, value: _entries(p, padded_key("part_", "p_partkey", 8), F.col("p_partkey") + step, PUT, value)
    return _text(live(put(0, F.col("p_name")).unionByName(put(10**9, F.col("p_brand")))))


def override_subset(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    put = lambda rows, step, value: _entries(rows, padded_key("part_", "p_partkey", 8), F.col("p_partkey") + step, PUT, value)
    return _text(live(put(p, 0, F.col("p_name")).unionByName(put(p.filter("p_partkey <= 50"), 10**9, F.col("p_brand")))))


def _deleted(spark, sf_dir, again: bool):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    key, k = padded_key("order_", "o_orderkey", 8), F.col("o_orderkey")
    log = _entries(o, key, k, PUT, F.col("o_orderstatus")).unionByName(_entries(o, key, k + 10**9, DELETE, None))
    return log.unionByName(_entries(o.filter("o_orderkey % 7 = 0"), key, k + 2 * 10**9, PUT, F.col("o_orderpriority"))) if again else log


def delete_all(spark, sf_dir):
    """How many versions, keys and live keys there are after every key was deleted."""
    log = _deleted(spark, sf_dir, False)
    return latest(log).agg(F.count("*").alias("n_keys"), F.sum(F.when(F.col("op") == PUT, 1).otherwise(0)).cast("long").alias("n_live"))


def delete_then_put(spark, sf_dir):
    return _text(live(_deleted(spark, sf_dir, True)))


def delete_absent(spark, sf_dir):
    """Deletions of keys that never were: they add entries and no rows."""
    s = _read(spark, sf_dir, "supplier")
    log = _entries(s, padded_key("supp_", "s_suppkey", 8), F.col("s_suppkey"), PUT, F.col("s_name"))
    log = log.unionByName(_entries(s, padded_key("none_", "s_suppkey", 8), F.col("s_suppkey") + 10**9, DELETE, None))
    return _text(live(log))


def batch_put_delete(spark, sf_dir):
    """A first batch puts all parts; a second deletes every tenth and overwrites the others."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    key = padded_key("part_", "p_partkey", 8)
    one = p.select((F.col("p_partkey")).alias("ord"), key.alias("key"), F.lit(PUT).alias("op"), text_key("p_name").alias("value"))
    gone = F.col("p_partkey") % 10 == 0
    two = p.select(F.col("p_partkey").alias("ord"), key.alias("key"), F.when(gone, DELETE).otherwise(PUT).alias("op"), text_key("p_brand").alias("value"))
    return _text(live(batch.assign_sequence(one, 1).unionByName(batch.assign_sequence(two, 10**9))))


LINES = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def batch_same_key_last_wins(spark, sf_dir):
    """Many operations on one key; the last in the order of all columns wins. Keys are signed integers."""
    rows = _read(spark, sf_dir, "lineitem").select(*LINES.split(", "))
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINES.split(", ")[1:]))
    value = F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    operations = rows.select(order.alias("ord"), bigint_key(F.lit(0) - F.col("l_orderkey")).alias("key"), F.lit(PUT).alias("op"), text_key(value).alias("value"))
    return live(batch.assign_sequence(operations, 0)).select(decode_bigint("key").alias("key"), decode_text("value").alias("value"))


def event_log_latest(spark, sf_dir):
    """A change log: an error deletes its user, any other event puts its props."""
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props")
    op = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT)
    return live(_entries(e, bigint_key("user_id"), F.col("event_id"), op, F.col("props"))).select(decode_bigint("key").alias("key"), decode_text("value").alias("value"))


def _slices(spark, sf_dir) -> DataFrame:
    """Five tables of level 0 that overlap: slice i holds versions i of the orders whose key is a multiple of i + 1, some deleted."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k, out = F.col("o_orderkey"), None
    for i in range(5):
        op = F.when((k + i) % 11 == 0, DELETE).otherwise(PUT)
        part = _entries(o.filter(k % (i + 1) == 0), padded_key("order_", "o_orderkey", 8), k + i * 10**9, op, F.concat(F.lit(f"s{i}_"), "o_orderstatus"))
        part = part.withColumn("value", F.when(F.col("op") == PUT, F.col("value")))
        out = part if out is None else out.unionByName(part)
    return out


SLICES = "log AS (" + " UNION ALL ".join(f"SELECT printf('order_%08d', o_orderkey) AS key, o_orderkey + {i}000000000 AS seq, CASE WHEN (o_orderkey + {i}) % 11 = 0 THEN 2 ELSE 1 END AS op, CASE WHEN (o_orderkey + {i}) % 11 = 0 THEN NULL ELSE 's{i}_' || o_orderstatus END AS value FROM orders WHERE o_orderkey % {i + 1} = 0" for i in range(5)) + ")"
MERGED = "SELECT key, seq, CAST(op AS INTEGER) AS op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1"


def _physical(rows: DataFrame) -> DataFrame:
    return rows.select(decode_text("key").alias("key"), "seq", F.col("op").cast("int").alias("op"), decode_text("value").alias("value"))


def l0_merge(spark, sf_dir):
    """What merging five overlapping tables writes, deletions included."""
    return _physical(compaction.merge(_slices(spark, sf_dir)))


def merge_with_child(spark, sf_dir):
    """The same with the overlapping table of the next level, which is oldest."""
    o = _read(spark, sf_dir, "orders")
    child = _entries(o, padded_key("order_", "o_orderkey", 8), F.col("o_orderkey") - 10**9, PUT, F.concat(F.lit("child_"), "o_orderstatus"))
    return _physical(compaction.merge(_slices(spark, sf_dir).unionByName(child)))


def _tables(orders: DataFrame, part) -> Iterator[compaction.Table]:
    """Manifest rows (a row for each table) of all orders cut into disjoint key ranges by ``part``, one partition at a time."""
    rows = orders.select(padded_key("order_", "o_orderkey", 8).alias("key"), part.cast("long").alias("t")).groupBy("t").agg(F.min("key"), F.max("key"), F.count("*"))
    for r in rows.toLocalIterator():
        yield compaction.Table(r[0] + 1, 0, bytes(r[1]), bytes(r[2]), r[3], 14 * r[3], "")


def _disjoint(spark, sf_dir) -> list[compaction.Table]:
    """Ten tables by key range, of equal width between the least and the greatest key, that hold all orders."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey")
    low, high = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return [] if low is None else list(_tables(o, F.floor((F.col("o_orderkey") - low) * 10 / (high - low + 1))))


def trivial_move_layout(spark, sf_dir):
    """Tables of each level after two compaction steps over ten disjoint tables: only the manifest changes."""
    tables = _disjoint(spark, sf_dir)
    out = []
    for step in (1, 2):
        plan = compaction.pick(tables, 5)
        tables = [compaction.moved(plan) if t.table_id == plan.parents[0].table_id else t for t in tables]
        out += [(step, level, sum(t.level == level for t in tables)) for level in (0, 1)]
    return spark.createDataFrame(out, "step int, level int, n_tables long")


def _hundreds(spark, sf_dir) -> Iterator[compaction.Table]:
    """Tables of a hundred keys each that hold all orders; their number grows with the orders."""
    return _tables(_read(spark, sf_dir, "orders").select("o_orderkey"), F.floor((F.col("o_orderkey") - 1) / 100))


def table_pruning(spark, sf_dir):
    """Of all orders' tables, those whose closed range meets [order_00000250, order_00000450]; only these stay on the driver."""
    kept = compaction.prune(_hundreds(spark, sf_dir), b"order_00000250", b"order_00000450")
    return tables_frame(spark, Manifest(tables=tuple(kept))).select("table_id", decode_text("min_key").alias("min_key"), decode_text("max_key").alias("max_key"), "num_entries")


def _store(spark: SparkSession, **more) -> Database:
    """A store in the shared folder; a local session may leave that unset and gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise InvalidParams("spark.checkpoint.dir is unset; on a cluster it must name a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp()}"
    return Database(spark, StartMode.CREATE_OR_OVERRIDE, Params(path=f"{shared}/store-{uuid.uuid4().hex[:12]}", **more))


def _by_steps(log: DataFrame) -> list[DataFrame]:
    """The order log as three batches of operations."""
    step = F.floor(F.col("seq") / 10**9)
    return [log.filter(step == i).select((F.col("seq") - i * 10**9).alias("ord"), "key", "op", "value") for i in range(3)]


def flush_reopen_scan(spark, sf_dir):
    """The order log written to a store in three bulk batches, compacted, reopened and scanned."""
    db = _store(spark)
    for part in _by_steps(order_log(spark, sf_dir)):
        db.write_df(part)
    db.stop()
    return _text(Database(spark, StartMode.OPEN, db.params).scan())


def wal_replay_scan(spark, sf_dir):
    """Small batches of the log's first keys that stay in log and memtable, recovered by replay."""
    db = _store(spark)
    nation = _read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows at any size
    put, change = WriteBatch(), WriteBatch()
    for r in nation:
        key = b"nation_%04d" % r["n_nationkey"]
        put.put(key, r["n_name"].encode())
        change.delete(key) if r["n_nationkey"] % 5 == 0 else change.put(key, b"region_%d" % r["n_regionkey"]) if r["n_nationkey"] % 2 else change
    db.write(put)
    db.write(change)
    db.stop()
    return _text(Database(spark, StartMode.OPEN, db.params).scan())


def _separated(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(values, entries by reference) of the order log: one value batch for each thousand million of seq."""
    log = order_log(spark, sf_dir)
    where = [F.floor(F.col("seq") / 10**9).cast("long").alias("batch_id"), (F.col("seq") % 10**9).cast("long").alias("offset")]
    put = log.filter(F.col("op") == PUT)
    stored = put.select(*where, "key", "value")
    none = F.lit(None)
    entries = log.select("key", "seq", "op", none.cast("binary").alias("value"), *[F.when(F.col("op") == PUT, c).alias(n) for c, n in zip(where, ("batch_id", "offset"))])
    return stored, entries


def value_deref(spark, sf_dir):
    stored, entries = _separated(spark, sf_dir)
    return _text(values.dereference(live(entries), stored))


def value_gc_candidates(spark, sf_dir):
    stored, entries = _separated(spark, sf_dir)
    return values.dead_values(stored, entries).select("batch_id", "offset", decode_text("key").alias("key"))


def value_batch_liveness(spark, sf_dir):
    stored, entries = _separated(spark, sf_dir)
    return values.batch_liveness(stored, entries)


def level_stats(spark, sf_dir):
    """Tables of each level of a store after six bulk batches and all due compactions."""
    db = _store(spark)
    o = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), padded_key("supp_", "s_suppkey", 8).alias("key"), F.lit(PUT).alias("op"), text_key("s_name").alias("value"))
    for _ in range(6):
        db.write_df(o)
    return spark.createDataFrame(list(enumerate(db.manifest.level_counts())), "level int, n_tables long")


def _spread(spark, sf_dir, n: int) -> tuple[list[compaction.Table], int, int]:
    """n tables by key range that hold all orders, and the least and greatest order key."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey")
    low, high = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return ([], 0, 0) if low is None else (list(_tables(o, F.floor((F.col("o_orderkey") - low) * n / (high - low + 1)))), low, high)


def move_all_tables(spark, sf_dir):
    """Tables of each level after every compaction step of a hundred disjoint tables that hold all orders."""
    tables, out, step = _spread(spark, sf_dir, 100)[0], [], 0
    while plan := compaction.pick(tables, 2):  # two levels: the lower one takes all
        tables = [compaction.moved(plan) if t.table_id == plan.parents[0].table_id else t for t in tables]
        step += 1
        out += [(step, level, sum(t.level == level for t in tables)) for level in (0, 1)]
    return spark.createDataFrame(out, "step int, level int, n_tables long")


def prune_all_tables(spark, sf_dir):
    """Of two hundred tables that hold all orders, those that may hold a key of the middle half of the key range."""
    tables, low, high = _spread(spark, sf_dir, 200)
    first, last = low + (high - low) // 4, low + 3 * (high - low) // 4
    kept = compaction.prune(tables, b"order_%08d" % first, b"order_%08d" % last)
    return tables_frame(spark, Manifest(tables=tuple(kept))).select("table_id", decode_text("min_key").alias("min_key"), decode_text("max_key").alias("max_key"), "num_entries")


def range_scan_gaps(spark, sf_dir):
    """The middle half of all orders under keys 250 apart; every tenth is deleted, and the bounds lie in gaps."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    low, high = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    k = F.col("o_orderkey")
    key = padded_key("order_", 250 * k, 12)
    log = _entries(o, key, k, PUT, F.col("o_orderstatus")).unionByName(_entries(o.filter(k % 10 == 0), key, k + 10**9, DELETE, None))
    first, last = (250 * x + 7 for x in (low + (high - low) // 4, low + 3 * (high - low) // 4)) if low is not None else (0, 1)
    return _text(_pos(scans.range_scan(log, b"order_%012d" % first, b"order_%012d" % last), width=14), "pos")


def _order_store(spark, sf_dir, **more) -> Database:
    db = _store(spark, **more)
    for part in _by_steps(order_log(spark, sf_dir)):
        db.write_df(part)
    return db


ASKED = [1, 3, 10, 303, 310, 1151, 99_999_999]


def store_get(spark, sf_dir):
    """Point lookups through a store of tables, with one key overwritten and one deleted in the memtable."""
    db = _order_store(spark, sf_dir)
    db.write(WriteBatch().put(b"order_00000003", b"in the memtable").delete(b"order_00001151"))
    found = [(k, db.get(k)) for k in (b"order_%08d" % x for x in ASKED)]
    return spark.createDataFrame([(k.decode(), None if v is None else v.decode(), v is not None) for k, v in found], "key string, value string, found boolean")


def store_get_separate(spark, sf_dir):
    """The same lookups with values stored apart, each by its place."""
    db = _order_store(spark, sf_dir, separate_values=True)
    found = [(k, db.get(k)) for k in (b"order_%08d" % x for x in ASKED)]
    return spark.createDataFrame([(k.decode(), None if v is None else v.decode(), v is not None) for k, v in found], "key string, value string, found boolean")


def store_multi_get(spark, sf_dir):
    keys = _read(spark, sf_dir, "customer").select(padded_key("order_", "c_custkey", 8).alias("key"))
    return _text(_order_store(spark, sf_dir).multi_get(keys), "found")


def store_separate_scan(spark, sf_dir):
    """The order log with values stored apart, garbage collected, reopened and scanned in reverse."""
    db = _order_store(spark, sf_dir, separate_values=True)
    db.collect_garbage()
    db.vacuum()
    db.stop()
    return _text(Database(spark, StartMode.OPEN, db.params).reverse_scan())


def store_garbage(spark, sf_dir):
    """What garbage collection does to the batches of all parts' values, all but each tenth overwritten, the rest deleted."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    db, k = _store(spark, separate_values=True), F.col("p_partkey")
    rows = lambda op, value, keep: p.filter(keep).select(k.alias("ord"), padded_key("part_", "p_partkey", 8).alias("key"), F.lit(op).cast("byte").alias("op"), text_key(value).alias("value"))
    for op, value, keep in ((PUT, F.col("p_name"), F.lit(True)), (PUT, F.col("p_brand"), k % 10 != 0), (PUT, F.col("p_name"), k % 10 > 1), (DELETE, F.lit(""), k % 10 == 0)):
        db.write_df(rows(op, value, keep))
    return spark.createDataFrame(sorted(db.collect_garbage().items()), "batch_id long, action string")


def store_layers(spark, sf_dir):
    """A range of a store whose versions lie in two tables, a memtable that was flushed, and the memtable."""
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    db, k = _store(spark), F.col("s_suppkey")
    rows = lambda value, keep: s.filter(keep).select(k.alias("ord"), padded_key("supp_", "s_suppkey", 8).alias("key"), F.lit(PUT).cast("byte").alias("op"), text_key(value).alias("value"))
    db.write_df(rows(F.col("s_name"), F.lit(True)))
    db.write_df(rows(F.upper("s_name"), k % 2 == 0))
    db.write(WriteBatch().put(b"supp_00000001", b"flushed").delete(b"supp_00000002"))
    db.flush()
    db.write(WriteBatch().put(b"supp_00000002", b"again").delete(b"supp_00000003").put(b"zupp", b"outside"))
    return _text(db.range_scan(b"supp_", b"supq"))


def wal_replay_orders(spark, sf_dir):
    """The whole order log through the log in batches of 500, whose frames executors write; the flush cuts it, the rest is replayed at the reopening."""
    db = _store(spark, max_memtable_size=1 << 20)
    db.write_batches(order_log(spark, sf_dir).withColumnRenamed("seq", "ord"), 500)
    db.stop()
    return _text(Database(spark, StartMode.OPEN, db.params).scan())


def stream_late_changes(spark, sf_dir):
    """The events as a change stream whose newer half arrives first, ingested micro-batch by micro-batch, then all once more."""
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props")
    op = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT)
    entries = _entries(e, bigint_key("user_id"), F.col("event_id"), op, F.col("props"))
    middle = e.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    db = _store(spark)
    src, read = f"{db.params.path}-changes", lambda: spark.readStream.schema(entries.schema).parquet(f"{db.params.path}-changes")
    for half in (F.col("seq") > middle, F.col("seq") <= middle):
        entries.filter(half).write.mode("append").parquet(src)
        ingest(read(), db, f"{db.params.path}-first").awaitTermination()
    ingest(read(), db, f"{db.params.path}-again").awaitTermination()
    return db.scan().select(decode_bigint("key").alias("key"), decode_text("value").alias("value"))


def stop_and_go(spark, sf_dir):
    """What each start mode finds of a store of all regions: rows after reopening, after opening or making, after overriding."""
    db = _store(spark)
    regions = _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ord"), padded_key("region_", "r_regionkey", 4).alias("key"), F.lit(PUT).cast("byte").alias("op"), text_key("r_name").alias("value"))
    db.write_df(regions)
    out = []
    for mode in (StartMode.OPEN, StartMode.CREATE_OR_OPEN, StartMode.CREATE_OR_OVERRIDE):
        db.stop()
        db = Database(spark, mode, db.params)
        out.append((mode.value, db.scan().count()))
    return spark.createDataFrame(out, "mode string, n long")


SEPARATED = """refs AS (SELECT CAST(floor(seq / 1000000000) AS BIGINT) AS batch_id, seq % 1000000000 AS "offset", key, seq, op FROM log),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM refs) WHERE rn = 1 AND op = 1)"""
PARTS = "SELECT printf('part_%08d', p_partkey) AS key,"

QUERIES = {
    "live_scan": live_scan,
    "ordered_scan": ordered_scan,
    "reverse_scan": reverse_scan,
    "point_get_hit": lambda s, d: _found(s, d, b"order_00000303"),
    "point_get_miss": lambda s, d: _found(s, d, b"order_99999999"),
    "point_get_deleted": lambda s, d: _found(s, d, b"order_00000310"),
    "multi_get": multi_get,
    "range_scan": _range(*BOUNDS),
    "range_scan_empty": _range(b"order_90000000", b"order_99999999"),
    "range_scan_sparse": sparse_range,
    "range_scan_overlapping": overlapping_ranges,
    "reverse_range_scan": reverse_range_scan,
    "first_n": first_n,
    "last_n": last_n,
    "override_all": override_all,
    "override_subset": override_subset,
    "delete_all": delete_all,
    "delete_then_put": delete_then_put,
    "delete_absent": delete_absent,
    "batch_put_delete": batch_put_delete,
    "batch_same_key_last_wins": batch_same_key_last_wins,
    "event_log_latest": event_log_latest,
    "l0_merge": l0_merge,
    "merge_with_child": merge_with_child,
    "trivial_move_layout": trivial_move_layout,
    "table_pruning": table_pruning,
    "flush_reopen_scan": flush_reopen_scan,
    "wal_replay_scan": wal_replay_scan,
    "value_deref": value_deref,
    "value_gc_candidates": value_gc_candidates,
    "value_batch_liveness": value_batch_liveness,
    "level_stats": level_stats,
    "move_all_tables": move_all_tables,
    "prune_all_tables": prune_all_tables,
    "range_scan_gaps": range_scan_gaps,
    "store_get": store_get,
    "store_get_separate": store_get_separate,
    "store_multi_get": store_multi_get,
    "store_separate_scan": store_separate_scan,
    "store_garbage": store_garbage,
    "store_layers": store_layers,
    "wal_replay_orders": wal_replay_orders,
    "stream_late_changes": stream_late_changes,
    "stop_and_go": stop_and_go,
}


def _asked_sql(change: str) -> str:
    asked = ", ".join(f"('order_{x:08d}')" for x in ASKED)
    return f"{WITH}, found AS ({change}) SELECT k.key, value, value IS NOT NULL AS found FROM (VALUES {asked}) AS k(key) LEFT JOIN found ON found.key = k.key"


ORACLES = {
    "live_scan": f"{WITH} SELECT key, value FROM live",
    "ordered_scan": f"{WITH} SELECT key, value, row_number() OVER (ORDER BY key) AS pos FROM live",
    "reverse_scan": f"{WITH} SELECT key, value, row_number() OVER (ORDER BY key DESC) AS pos FROM live",
    "point_get_hit": _found_sql("order_00000303"),
    "point_get_miss": _found_sql("order_99999999"),
    "point_get_deleted": _found_sql("order_00000310"),
    "multi_get": f"{WITH} SELECT k.key, value, value IS NOT NULL AS found FROM (SELECT DISTINCT printf('order_%08d', c_custkey) AS key FROM customer) AS k LEFT JOIN live ON live.key = k.key",
    "range_scan": _range_sql(*BOUNDS),
    "range_scan_empty": _range_sql(b"order_90000000", b"order_99999999"),
    "range_scan_sparse": "SELECT printf('order_%08d', o_orderkey) AS key, o_orderstatus AS value, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderkey % 250 = 0 AND o_orderkey >= 0 AND o_orderkey < 1250",
    "range_scan_overlapping": f"{WITH} SELECT r AS range, count(*) AS n FROM live JOIN (VALUES ('a', 'order_00000280', 'order_00000400'), ('b', 'order_00000350', 'order_00000560'), ('c', 'order_00000550', 'order_00000710')) AS v(r, lo, hi) ON key >= lo AND key < hi GROUP BY 1",
    "reverse_range_scan": f"{WITH} SELECT key, value, row_number() OVER (ORDER BY key DESC) AS pos FROM live WHERE key > '{BOUNDS[0].decode()}' AND key <= '{BOUNDS[1].decode()}'",
    "first_n": f"{WITH} SELECT key, value FROM live ORDER BY key LIMIT 20",
    "last_n": f"{WITH} SELECT key, value FROM live ORDER BY key DESC LIMIT 20",
    "override_all": f"{PARTS} p_brand AS value FROM part",
    "override_subset": f"{PARTS} CASE WHEN p_partkey <= 50 THEN p_brand ELSE p_name END AS value FROM part",
    "delete_all": "SELECT count(DISTINCT o_orderkey) AS n_keys, CAST(0 AS BIGINT) AS n_live FROM orders",
    "delete_then_put": "SELECT printf('order_%08d', o_orderkey) AS key, o_orderpriority AS value FROM orders WHERE o_orderkey % 7 = 0",
    "delete_absent": "SELECT printf('supp_%08d', s_suppkey) AS key, s_name AS value FROM supplier",
    "batch_put_delete": f"{PARTS} p_brand AS value FROM part WHERE p_partkey % 10 <> 0",
    "batch_same_key_last_wins": f"SELECT -l_orderkey AS key, l_returnflag || '|' || l_linestatus || '|' || l_partkey || '|' || l_suppkey AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(x + ' DESC' for x in LINES.split(', ')[1:])}) AS rn FROM lineitem) WHERE rn = 1",
    "event_log_latest": "SELECT user_id AS key, props AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'",
    "l0_merge": f"WITH {SLICES} {MERGED}",
    "merge_with_child": f"WITH {SLICES[:-1]} UNION ALL SELECT printf('order_%08d', o_orderkey), o_orderkey - 1000000000, 1, 'child_' || o_orderstatus FROM orders) {MERGED}",
    "trivial_move_layout": "SELECT CAST(step AS INTEGER) AS step, CAST(level AS INTEGER) AS level, CAST(CASE WHEN level = 0 THEN n - step ELSE step END AS BIGINT) AS n_tables FROM (SELECT count(DISTINCT (o_orderkey - 1) // 100) AS n FROM orders WHERE o_orderkey BETWEEN 1 AND 1000), (VALUES (1), (2)) AS s(step), (VALUES (0), (1)) AS l(level)",
    "table_pruning": "SELECT CAST((o_orderkey - 1) // 100 + 1 AS BIGINT) AS table_id, min(printf('order_%08d', o_orderkey)) AS min_key, max(printf('order_%08d', o_orderkey)) AS max_key, count(*) AS num_entries FROM orders WHERE o_orderkey BETWEEN 1 AND 1000 GROUP BY 1 HAVING max(o_orderkey) >= 250 AND min(o_orderkey) <= 450",
    "flush_reopen_scan": f"{WITH} SELECT key, value FROM live",
    "wal_replay_scan": "SELECT printf('nation_%04d', n_nationkey) AS key, CASE WHEN n_nationkey % 2 = 1 THEN 'region_' || n_regionkey ELSE n_name END AS value FROM nation WHERE n_nationkey % 5 <> 0",
    "value_deref": f"{WITH} SELECT key, value FROM live",
    "value_gc_candidates": f'WITH {LOG}, {SEPARATED} SELECT batch_id, "offset", key FROM refs WHERE op = 1 AND (batch_id, "offset") NOT IN (SELECT (batch_id, "offset") FROM newest)',
    "value_batch_liveness": f'WITH {LOG}, {SEPARATED} SELECT r.batch_id, count(*) AS total, count(n.key) AS live FROM refs AS r LEFT JOIN newest AS n ON n.batch_id = r.batch_id AND n."offset" = r."offset" WHERE r.op = 1 GROUP BY 1',
    "level_stats": "SELECT CAST(level AS INTEGER) AS level, CAST(n AS BIGINT) AS n_tables FROM (VALUES (0, 1), (1, 1), (2, 0), (3, 0), (4, 0)) AS v(level, n)",
    "move_all_tables": "WITH n AS (SELECT count(DISTINCT floor((o_orderkey - low) * 100 / (high - low + 1))) AS n FROM orders, (SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders)) SELECT CAST(step AS INTEGER) AS step, CAST(level AS INTEGER) AS level, CAST(CASE WHEN level = 0 THEN n - step ELSE step END AS BIGINT) AS n_tables FROM n, (SELECT unnest(range(1, 101)) AS step), (VALUES (0), (1)) AS l(level) WHERE step <= n - 4",
    "prune_all_tables": "WITH b AS (SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders) SELECT CAST(floor((o_orderkey - low) * 200 / (high - low + 1)) AS BIGINT) + 1 AS table_id, min(printf('order_%08d', o_orderkey)) AS min_key, max(printf('order_%08d', o_orderkey)) AS max_key, count(*) AS num_entries FROM orders, b GROUP BY 1, low, high HAVING max(o_orderkey) >= low + (high - low) // 4 AND min(o_orderkey) <= low + 3 * (high - low) // 4",
    "range_scan_gaps": "WITH b AS (SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders) SELECT printf('order_%012d', 250 * o_orderkey) AS key, o_orderstatus AS value, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders, b WHERE o_orderkey % 10 <> 0 AND 250 * o_orderkey >= 250 * (low + (high - low) // 4) + 7 AND 250 * o_orderkey < 250 * (low + 3 * (high - low) // 4) + 7",
    "store_get": _asked_sql("SELECT key, CASE WHEN key = 'order_00000003' THEN 'in the memtable' ELSE value END AS value FROM live WHERE key <> 'order_00001151'"),
    "store_get_separate": _asked_sql("SELECT * FROM live"),
    "store_multi_get": f"{WITH} SELECT k.key, value, value IS NOT NULL AS found FROM (SELECT DISTINCT printf('order_%08d', c_custkey) AS key FROM customer) AS k LEFT JOIN live ON live.key = k.key",
    "store_separate_scan": f"{WITH} SELECT key, value FROM live",
    "store_garbage": "SELECT CAST(b AS BIGINT) AS batch_id, CASE WHEN live = 0 THEN 'drop' ELSE 'rewrite' END AS action FROM (SELECT 1 AS b, count(*) AS total, 0 AS live FROM part UNION ALL SELECT 2, count(*) FILTER (p_partkey % 10 <> 0), count(*) FILTER (p_partkey % 10 = 1) FROM part) WHERE live < 0.25 * total",
    "store_layers": "SELECT printf('supp_%08d', s_suppkey) AS key, CASE s_suppkey WHEN 1 THEN 'flushed' WHEN 2 THEN 'again' ELSE CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END END AS value FROM supplier WHERE s_suppkey <> 3",
    "wal_replay_orders": f"{WITH} SELECT key, value FROM live",
    "stream_late_changes": "SELECT user_id AS key, props AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'",
    "stop_and_go": "SELECT m AS mode, CAST(CASE WHEN m = 'create_or_override' THEN 0 ELSE n END AS BIGINT) AS n FROM (SELECT count(*) AS n FROM region), (VALUES ('open'), ('create_or_open'), ('create_or_override')) AS v(m)",
}

"""Operator 7: sharding by extendible hashing.

A document's key is the first 60 bits of md5(doc_id). The directory starts as one bucket; a bucket over the byte limit is
split on the next bit, others are left, so a shard is named by the shortest prefix of bits whose documents fit. Splitting
needs only sums of bytes by prefix: those of twelve further bits are aggregated at once (partial sums before the shuffle).
A bucket is a shard if it fits and the two halves of the bucket above it together don't; each prefix finds the one it lies
in, and only buckets that are still too large go on to the next twelve bits. The shards of the first twelve bits are
broadcast, 4096 at most; later ones grow with the documents and are shuffled.

Edge cases: documents that no bit parts (one document over the limit, or rows with equal doc_id) make a shard of their
own that is flagged as oversized; null text has 0 bytes; a null doc_id is keyed as "null"; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

BITS, STEP = 60, 12
LIMIT = 16 << 20


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, key"""
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).cast("binary")
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("key"))


def _prefix(key, depth):
    """The first ``depth`` bits; depth may be a column."""
    return F.expr(f"shiftright({key}, {BITS} - {depth})")


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard (its bits), depth, shard_bytes, shard_docs, oversized for each document."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.save(keyed(docs), "keys")
    open_, done, low = rows, None, 0
    while True:
        high = min(low + STEP, BITS)
        sums = open_.groupBy(_prefix("key", high).alias("p")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("key").alias("a"), F.max("key").alias("b"))
        sums = scratch.save(sums, f"sums{low}")
        levels = sums.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("at", F.expr(f"shiftright(p, cast({high} - depth as int))"))
        buckets = levels.groupBy("depth", "at").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("a").alias("a"), F.max("b").alias("b")).withColumn("one", F.col("a") == F.col("b"))
        above = Window.partitionBy("depth", F.expr("shiftright(at, 1)"))  # a bucket and its other half
        split = (F.col("depth") == low) | ((F.sum("shard_bytes").over(above) > limit) & (F.min("a").over(above) != F.max("b").over(above)))
        fits = buckets.withColumn("split", split).filter("split").filter((F.col("shard_bytes") <= limit) | F.col("one"))
        least = levels.select("p", "depth", "at").join(fits.select("depth", "at", "shard_bytes", "shard_docs").hint("merge"), ["depth", "at"])
        leaves = scratch.save(least.select("p", F.struct("depth", "at", "shard_bytes", "shard_docs").alias("leaf")), f"leaves{low}")
        found = open_.withColumn("p", _prefix("key", high)).join(leaves.hint("broadcast" if low == 0 else "merge"), "p", "left")
        here = found.filter(F.col("leaf").isNotNull()).select("doc_id", "n_bytes", "leaf.*")
        done = here if done is None else done.unionByName(here)
        if high == BITS or leaves.count() == sums.count():  # each prefix has one leaf at most
            break
        open_ = scratch.save(found.filter(F.col("leaf").isNull()).select("doc_id", "n_bytes", "key"), f"open{low}")
        low = high + 1
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(at), depth, '0')"))
    return done.select("doc_id", "n_bytes", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes the documents, all columns, under path/shard=p<bits>; each shard's rows are gathered by the shuffle on its name.

    Null texts and null ids are rows like others; rows with equal doc_id share a shard; an empty table writes no shard. A
    column of the input that is called shard, in any case of letters, is refused."""
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("the documents have a column called shard")
    parts = assign(docs, limit).select("doc_id", F.concat(F.lit("p"), "shard").alias("shard")).dropDuplicates(["doc_id"])
    joined = docs.join(parts, docs["doc_id"].eqNullSafe(parts["doc_id"])).drop(parts["doc_id"])
    joined.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: A limit at which also small tables are split.
SMALL = 64 << 10


def sharding_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over whole documents with shards of 64 KiB."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), SMALL)


def sql(limit: int = LIMIT) -> str:
    return f"""
WITH k AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key
  FROM documents),
l AS (SELECT *, unnest(range(0, {BITS + 1})) AS depth FROM k),
b AS (SELECT depth, key >> ({BITS} - depth) AS pfx, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs, min(key) = max(key) AS one FROM l GROUP BY 1, 2),
f AS (
  SELECT doc_id, n_bytes, b.depth, b.pfx, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY b.depth) AS nth
  FROM l JOIN b ON b.depth = l.depth AND b.pfx = (l.key >> ({BITS} - l.depth)) WHERE shard_bytes <= {limit} OR one)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(pfx), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS depth,
  shard_bytes, shard_docs, shard_bytes > {limit} AS oversized
FROM f WHERE nth = 1
"""

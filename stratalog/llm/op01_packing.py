"""Operator 1: bulk-synchronous best-fit packing.

Only the lengths of pieces matter to packing, and a length is a whole number up to the capacity. So documents and gaps are
held as *runs*: (size, first rank, count) of equally long pieces, and (gap, first sequence, count) of equally full
sequences. A run's ranks stand for its pieces, however many they are; the state has some thousand rows at any input size,
and a length that a third of all pieces share is one row.

Each superstep range-partitions the runs by size; in every range a sweep over descending sizes gives each document the
smallest gap that is no smaller (its successor). Several documents that want one gap are served in the order of their
rank; the first ones fill it, the next go on to the following successor. The gaps are updated, written, and the next
superstep sweeps wider ranges, until the last has one range, where documents without a gap open new sequences.

1. Pieces over half the capacity open a sequence each, as no two fit together.
2. Supersteps with ranges of capacity/16, /8 and /4.
3. One range, with opening.

Edge cases: null or empty text is a document of the end id alone; a null doc_id is kept; rows with equal doc_id are packed
each; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, documents, shuffle_partitions
from .tokens import default_path, encoder, forget, pieces, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUNS = "kind string, size long, lo long, n long, bin_lo long, per_bin long, offset long"
#: Placements beyond this many rows (some 10 MB) are joined by a shuffle instead of a broadcast.
MOST_BROADCAST = 200_000


def _cut(path: str, capacity: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(path)
        for batch, rows in texts(batches):
            out = [(d, *p) for d, x in zip(batch.column(0).to_pylist(), rows) for p in pieces(encode(x), capacity)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        forget()

    return run


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids, cut at the capacity."""
    return documents(docs).mapInArrow(_cut(tokenizer or default_path(), capacity), PIECES)


class Sweep:
    """Best fit of runs within one range of sizes."""

    def __init__(self, gaps: list[tuple[int, int, int]], capacity: int):
        self.capacity, self.runs, self.sizes, self.placed = capacity, {}, [], []
        for gap, first, n in sorted(gaps):
            self.give(gap, first, n)

    def give(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.runs:
                insort(self.sizes, gap)
            self.runs.setdefault(gap, []).append((first, n))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The successor of a size: the first run of the smallest gap that is no smaller."""
        if (i := bisect_left(self.sizes, least)) == len(self.sizes):
            return None
        gap = self.sizes[i]
        first, n = self.runs[gap].pop(0)
        if not self.runs[gap]:
            del self.runs[gap], self.sizes[i]
        return gap, first, n

    def fill(self, size: int, lo: int, n: int, gap: int, first: int, bins: int) -> tuple[int, int]:
        """Puts documents of a run into equal gaps, in the order of rank; gives what is left of the run."""
        per = gap // size
        for k, used in ((per, min(bins, n // per)), (n % per, 1)):
            if k and used and bins and n >= k * used and (k == per or n == k):
                self.placed.append((size, lo, k * used, first, k, self.capacity - gap))
                self.give(gap - k * size, first, used)
                lo, n, first, bins = lo + k * used, n - k * used, first + used, bins - used
        self.give(gap, first, bins)
        return lo, n

    def run(self, docs: list[tuple[int, int, int]], new_bin: int | None = None) -> list[tuple[int, int, int]]:
        """Sweeps over descending sizes. new_bin: the number of the next sequence, if new ones may be opened. Gives the runs that found no gap."""
        left = []
        for size, lo, n in sorted(docs, key=lambda x: (-x[0], x[1])):
            while n and (found := self.take(size)):
                lo, n = self.fill(size, lo, n, *found)
            if n and new_bin is not None:
                bins = -(-n // (self.capacity // size))
                lo, n = self.fill(size, lo, n, self.capacity, new_bin, bins)
                new_bin += bins
            if n:
                left.append((size, lo, n))
        return left


def _superstep(state: DataFrame, width: int, capacity: int, new_bin: int | None = None) -> DataFrame:
    """One sweep in every range of sizes; placements made before stay out of it."""

    def sweep(rows):
        import pandas as pd

        pick = lambda kind, *c: [tuple(map(int, r)) for r in rows.loc[rows.kind == kind, list(c)].itertuples(index=False)]
        work = Sweep(pick("gap", "size", "bin_lo", "n"), capacity)
        left = work.run(pick("doc", "size", "lo", "n"), new_bin)
        out = [("placed", s, lo, n, b, k, at) for s, lo, n, b, k, at in work.placed] + [("doc", s, lo, n, 0, 0, 0) for s, lo, n in left]
        out += [("gap", gap, 0, n, b, 0, 0) for gap, runs in work.runs.items() for b, n in runs]
        return pd.DataFrame(out, columns=["kind", "size", "lo", "n", "bin_lo", "per_bin", "offset"])

    open_ = state.filter(F.col("kind") != "placed")
    swept = open_.groupBy(F.floor((F.col("size") - 1) / width).alias("range")).applyInPandas(sweep, RUNS)
    return state.filter(F.col("kind") == "placed").unionByName(swept)


def placements(classes: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """classes: size, n. Gives (size, lo, n, bin_lo, per_bin, offset): the ranks lo to lo + n - 1 of a size go, per_bin at a time, into the sequences from bin_lo on, from that offset."""
    zero = F.lit(0).cast("long")
    larger = Window.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)  # over at most `capacity` rows
    large = classes.filter(F.col("size") * 2 > capacity).withColumn("bin_lo", F.coalesce(F.sum("n").over(larger), zero))
    columns = lambda kind, size, lo, n, bin_lo, per_bin, offset: [F.lit(kind).alias("kind"), size.alias("size"), lo.alias("lo"), n.alias("n"), bin_lo.alias("bin_lo"), per_bin.alias("per_bin"), offset.alias("offset")]
    n, size, bin_lo = F.col("n"), F.col("size"), F.col("bin_lo")
    opened = large.select(*columns("placed", size, zero, n, bin_lo, F.lit(1).cast("long"), zero))
    gaps = large.filter(size < capacity).select(*columns("gap", F.lit(capacity).cast("long") - size, zero, n, bin_lo, zero, zero))
    small = classes.filter(size * 2 <= capacity).select(*columns("doc", size, zero, n, zero, zero, zero))
    state = scratch.save(opened.unionByName(gaps).unionByName(small).coalesce(1), "state0")
    bins = large.agg(F.coalesce(F.sum("n"), zero)).first()[0]
    for k, width in enumerate((capacity // 16, capacity // 8, capacity // 4, capacity), 1):
        if width:
            state = scratch.save(_superstep(state, width, capacity, bins if width == capacity else None).coalesce(1), f"state{k}")
    return state.filter(F.col("kind") == "placed").drop("kind")


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece's place in a sequence of at most ``capacity`` ids."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    with arrow_batches(spark):
        cut = scratch.save(token_pieces(docs, capacity, tokenizer).withColumn("salt", F.monotonically_increasing_id()), "pieces")
    blocks = 4 * shuffle_partitions(spark)
    # A length that many pieces share is ranked block by block; the stored salt parts pieces that are equal in all else.
    cut = cut.withColumn("block", F.pmod(F.xxhash64("salt"), F.lit(blocks)))
    counts = scratch.save(cut.groupBy("length", "block").agg(F.count("*").alias("n")), "counts")
    base = counts.select("length", "block", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = placements(counts.groupBy(F.col("length").alias("size")).agg(F.sum("n").alias("n")), capacity, scratch).withColumnsRenamed({"lo": "run_lo", "n": "run_n", "offset": "run_offset"})
    if placed.count() <= MOST_BROADCAST:
        placed = F.broadcast(placed)
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy("salt")) - 1
    ranked = cut.withColumn("own", own).join(base, ["length", "block"]).withColumn("rank", F.col("own") + F.col("base"))
    at = F.col("rank") - F.col("run_lo")
    found = ranked.join(placed, (F.col("length") == F.col("size")) & (at >= 0) & (at < F.col("run_n")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin_lo") + F.floor(at / F.col("per_bin"))).alias("sequence_id"), (F.col("run_offset") + at % F.col("per_bin") * F.col("length")).alias("offset"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Operator 3: benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

A benchmark item is the set of its windows (``window`` consecutive words; a shorter item is one window), a window the
sequence of its word shingles. Containment of a whole window needs all of its shingles, so its necessary prefix is one:
the rarest. The join runs in these steps:

1. One scan of the documents finds every place where a shingle of the benchmark stands, whatever the shingle's size.
2. Shingles are ordered by how often they stand in all documents (ties by hash); each window keeps the rarest.
3. Places join windows on that shingle; positional and length bounds drop windows that would start before the first or
   end after the last word.
4. The window's words are compared with the document's, so that a hash can't decide.

A benchmark of few shingles and windows (counted) is broadcast, and a place takes the words around it along for step 4. A larger one
is joined by a shuffle of bare places (document, position, hash); the windows that are left then go to their documents.

Edge cases: null or empty text has no words and is never hit; an item without words has no window; windows that several
items share count for each; rows with equal doc_id are judged each by their own text; a null doc_id is kept; an empty
benchmark hits nothing; empty documents give no rows; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh, let, words

#: Words of a shingle; a window of fewer words is one shingle.
SHINGLE = 4
#: Rows of the benchmark's side up to which it is broadcast (at about 100 bytes each).
MOST_BROADCAST = 200_000


def _shingle(w: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, at + j) for j in range(k)])


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """words, len, items: the distinct windows and the sorted ids of the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, window).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("len", F.size("words"))


#: What a row is known by: its id and two hashes of its text. Rows that share all three have one result.
KEY = ("doc_id", "h1", "h2")
HITS, ITEMS = "array<struct<start:int,len:int>>", "array<string>"


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 and the words of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents(docs).select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), words(F.col("text")).alias("w"))


def _places(sizes: list[int]) -> Column:
    """at, k, gram of every shingle of the words ``w``, for each of the sizes."""
    of = lambda w, k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("at"), F.lit(k).alias("k"), _shingle(w, i, k).alias("gram")))).otherwise(F.array().cast("array<struct<at:int,k:int,gram:bigint>>"))
    return let(F.col("w"), lambda w: F.concat(*[of(w, k) for k in sizes]))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, h1, h2, n_words, hits (sorted array of [start, length] of the benchmark windows it holds), items (their ids): a row for each document."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    wins = scratch.save(windows(benchmark, window).withColumn("window_id", F.monotonically_increasing_id()), "windows")
    k_of = F.least(F.col("len"), F.lit(SHINGLE))
    sizes = sorted(r[0] for r in wins.select(k_of.alias("k")).distinct().collect()) or [SHINGLE]  # SHINGLE values at most
    grams = []
    for k in sizes:
        places = F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("off")
        own = wins.filter(k_of == k).select("window_id", "words", "len", places)
        grams.append(own.select("window_id", "len", "off", F.lit(k).alias("k"), _shingle(F.col("words"), F.col("off"), k).alias("gram")))
    gram = scratch.save(_union(grams), "grams")
    known = gram.select("k", "gram").distinct()
    if max(known.count(), wins.count()) <= MOST_BROADCAST:
        return _by_broadcast(docs, gram, known, wins, sizes, window, scratch)
    return _by_shuffle(docs, gram, known, wins, sizes, scratch)


def _rarest(gram: DataFrame, found: DataFrame) -> DataFrame:
    """window_id, len, off, k, gram: of each window the shingle that stands least often in all documents, if all of its shingles stand somewhere."""
    freq = found.groupBy("k", "gram").agg(F.count("*").alias("freq"))
    order = Window.partitionBy("window_id").orderBy("freq", "gram", "off")
    return gram.join(freq, ["k", "gram"]).withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth", "freq")


def _by_broadcast(docs: DataFrame, gram: DataFrame, known: DataFrame, wins: DataFrame, sizes: list[int], window: int, scratch: Scratch) -> DataFrame:
    rows = _named(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("n_words", F.size("w").cast("long"))
    # each document's first place is kept anyway, for its row; the hash of one size is a plain column, others are exploded
    each = rows.select("row", *KEY, "n_words", "w", F.posexplode_outer("w").alias("at", "word")).drop("word")
    of = lambda k: F.when(F.col("at") + k <= F.col("n_words"), _shingle(F.col("w"), F.col("at"), k))
    if len(sizes) == 1:
        each = each.withColumn("k", F.lit(sizes[0])).withColumn("gram", of(sizes[0]))
    else:
        each = each.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), of(k).alias("gram")) for k in sizes])).alias("x")).select("row", *KEY, "n_words", "w", "at", "x.*")
    side = F.broadcast(known.select(F.col("k").alias("known_k"), F.col("gram").alias("known")))
    hit, first = F.col("known").isNotNull(), (F.coalesce("at", F.lit(0)) == 0) & (F.col("k") == sizes[0])
    around = F.slice("w", F.greatest(F.col("at") - (F.lit(window) - F.col("k")), F.lit(0)) + 1, 2 * window - F.col("k"))
    kept = each.join(side, (F.col("gram") == F.col("known")) & (F.col("k") == F.col("known_k")), "left").filter(hit | first)
    found = scratch.save(kept.select("row", *KEY, "n_words", "at", first.alias("first"), "k", F.when(hit, F.col("gram")).alias("gram"), F.when(hit, around).alias("around")), "places")

    places = found.filter(F.col("gram").isNotNull())
    prefix = scratch.save(_rarest(gram, places).drop("len").join(wins, "window_id").select("k", "gram", "off", "words", "len", "items"), "prefix")
    start = F.col("at") - F.col("off")
    lead = F.least(F.col("at"), F.lit(window) - F.col("k")) - F.col("off")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n_words")) & (lead >= 0)
    same = F.slice("around", lead + 1, F.col("len")) == F.col("words")
    hits = places.join(F.broadcast(prefix), ["k", "gram"]).filter(inside).filter(same)  # a row for each window, counted above
    per_row = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(start.alias("start"), F.col("len")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = found.filter("first").select("row", *KEY, "n_words").join(per_row, "row", "left")
    return out.select(*KEY, "n_words", F.coalesce("hits", F.array().cast(HITS)).alias("hits"), F.coalesce("items", F.array().cast(ITEMS)).alias("items"))


def _by_shuffle(docs: DataFrame, gram: DataFrame, known: DataFrame, wins: DataFrame, sizes: list[int], scratch: Scratch) -> DataFrame:
    each = _named(docs).select(*KEY, F.explode(_places(sizes)).alias("place")).select(*KEY, "place.*")
    found = scratch.save(each.join(known, ["k", "gram"]), "places")
    prefix = _rarest(gram, found)
    start = F.col("at") - F.col("off")
    meet = found.join(prefix, ["k", "gram"]).filter(start >= 0).select(*KEY, start.alias("start"), "window_id").distinct()
    tried = meet.join(wins, "window_id").groupBy(*KEY).agg(F.collect_list(F.struct("start", "len", "words", "items")).alias("tried"))
    own, w = _named(docs), F.col("w")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in KEY]
    both = own.join(tried.withColumnsRenamed({c: f"of_{c}" for c in KEY}), same[0] & same[1] & same[2], "left")
    good = F.filter(F.coalesce("tried", F.array().cast("array<struct<start:int,len:int,words:array<string>,items:array<string>>>")), lambda t: (t["start"] + t["len"] <= F.size(w)) & (F.slice(w, t["start"] + 1, t["len"]) == t["words"]))
    both = scratch.save(both.select(*KEY, F.size(w).cast("long").alias("n_words"), good.alias("good")).select(*KEY, "n_words", F.transform("good", lambda t: F.struct(t["start"].alias("start"), t["len"].alias("len"))).alias("hits"), F.flatten(F.transform("good", lambda t: t["items"])).alias("items")), "hits")
    return both.select(*KEY, "n_words", F.array_sort(F.array_distinct("hits")).alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def covered(hits: Column) -> Column:
    """Words inside any of the sorted [start, length] intervals."""
    grow = lambda acc, h: F.struct(
        F.greatest(acc["end"], h["start"] + h["len"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), h["start"] + h["len"] - F.greatest(acc["end"], h["start"]))).alias("n"),
    )
    return F.aggregate(hits, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), grow, lambda acc: acc["n"].cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    marked = mark(docs, benchmark, window).withColumn("n_hit", covered(F.col("hits")))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, all columns, that hold no window of the benchmark; each row by its own text, whatever ids it shares."""
    names = [fresh(docs, f"gone_{c}") for c in KEY]
    gone = mark(docs, benchmark, window).filter(F.size("hits") > 0).select(*[F.col(c).alias(n) for c, n in zip(KEY, names)]).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(text) == F.col(names[1])) & (F.xxhash64(F.lit(1), text) == F.col(names[2]))
    return docs.join(gone, same, "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
occ AS (
  SELECT doc_id, s, n, item
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) AS ns WHERE len(w) >= n) AS p
  JOIN win USING (n) WHERE array_to_string(p.w[s:s + n - 1], ' ') = win.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

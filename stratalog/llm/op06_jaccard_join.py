"""Operator 6: exact Jaccard join of documents on word n-grams by rare-first prefix filtering.

1. Every text becomes its set of hashed n-grams. Texts with one set share a 64-bit reference, so copies are one from here
   on. Postings (n-gram, reference) go, packed, to buckets of the n-gram's hash, which are dealt evenly to partitions.
2. Each bucket counts in how many sets an n-gram stands. An n-gram of one set alone can't be shared; of the others, each
   set gets its n-grams with these counts back.
3. In the order (count, hash), a set's unshared n-grams come first and take up its prefix; what is left of the prefix is
   indexed. Most sets have nothing left and are done.
4. Prefix n-grams give candidates under the length filter and the positional filter. First each n-gram's sets are paired
   with one pivot alone, the set whose n-grams are the most frequent, and the links found give components. Only sets of different components that share a prefix
   n-gram are paired after that, so a group of near copies costs its size and not its square. A pair is distinct before
   it is verified: it goes through the suffix filter (counts by class of hash bound the overlap) and one intersection.
5. Components of all links; each document gets its component's smallest doc_id.

Edge cases: null or empty text, or white space alone, has no n-grams and no links; fewer words than n are one n-gram;
rows with equal doc_id are rows of their own; a null doc_id never is a component's id unless all of it are null; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, documents, ending, fresh, give_back, label_of, shuffle_partitions, text_bytes
from .components import components

POSTED = "bucket int, doc_id long, h long, n long, ref long, blob binary"
SETS = "ref long, n long, unshared long, hub long, keys binary"
#: Bytes of text for each bucket: postings take about as many, so a bucket's size does not grow with the input. A small input has a bucket for each partition.
BUCKET = 16 << 20


def _pack(ref, n, count, keys) -> bytes:
    """References with set sizes and key counts, then all keys: of each, the first 6 bytes."""
    import numpy as np

    head = np.array([len(ref)], "<u8").tobytes() + ref.astype("<u8").tobytes() + n.astype("<u4").tobytes() + count.astype("<u4").tobytes()
    return head + np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpack(blob: bytes, extra: int = 0):
    """(ref, n, count, keys, counts): extra bytes follow for each key."""
    import numpy as np

    k = int(np.frombuffer(blob, "<u8", 1)[0])
    ref, n, count = np.frombuffer(blob, "<u8", k, 8), np.frombuffer(blob, "<u4", k, 8 + 8 * k), np.frombuffer(blob, "<u4", k, 8 + 12 * k)
    m, at = int(count.sum()), 8 + 16 * k
    keys = np.zeros((m, 8), np.uint8)
    keys[:, 2:] = np.frombuffer(blob, np.uint8, 6 * m, at).reshape(-1, 6)
    return ref, n, count, keys.view("<u8").ravel(), np.frombuffer(blob, "<u4", m, at + 6 * m) if extra else None


def _post(size: int, buckets: int):
    """A row for each document, and the batch's postings as one blob for each bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import mix, shingle_sets
        from .tokens import texts

        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch, rows in texts(batches):
            sets = list(shingle_sets(rows, size))
            refs = np.array([int((mix(s + np.uint64(0x51ED27)).sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(s)) if len(s) else 0) for s in sets], np.uint64)
            n = np.array([len(s) for s in sets], np.int64)
            _, once = np.unique(refs, return_index=True)  # copies within the batch are posted once
            once = once[n[once] > 0]
            out = [label_of(np.arange(len(sets)) % buckets).tolist(),  # rows of documents go round, so that copies don't meet
                   batch.column(0).to_pylist(), batch.column(2).to_pylist(), n.tolist(), refs.view(np.int64).tolist(), [None] * len(sets)]
            if len(once):
                keys, owner = np.concatenate([sets[i] for i in once]), np.repeat(np.arange(len(once)), n[once])
                to = (keys % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)
                order = np.argsort(to, kind="stable")
                keys, owner, to = keys[order], owner[order], to[order]
                edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
                for a, b, name in zip(edge[:-1].tolist(), edge[1:].tolist(), label_of(to[edge[:-1]]).tolist()):
                    who, count = np.unique(owner[a:b], return_counts=True)
                    for col, x in zip(out, (name, None, None, None, None, _pack(refs[once[who]], n[once[who]], count, keys[a:b]))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["bucket", "doc_id", "h", "n", "ref", "blob"])

    return ending(run)


def _in_two_sets(keys, owner):
    """(key, owner, number of its sets) of postings without repeats whose key stands in two sets or more, by key."""
    import numpy as np

    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[fresh], owner[fresh]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    sets = np.repeat(np.diff(edge), np.diff(edge)).astype(np.uint32)
    return keys[sets > 1], owner[sets > 1], sets[sets > 1]


def _shared(buckets: int):
    """A bucket's postings: those of n-grams in two sets or more, packed for each bucket of references."""

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        blobs = table.column("blob").drop_null().to_pylist()
        docs = table.filter(pc.is_null(table.column("blob")))
        del table
        out: list[list] = [[], []]
        if blobs:
            parts = [_unpack(x)[:4] for x in blobs]
            ref, n, count, keys = (np.concatenate(x) for x in zip(*parts))
            del parts, blobs
            names, first, which = np.unique(ref, return_index=True, return_inverse=True)
            sizes, owner = n[first].copy(), np.repeat(which.astype(np.uint32), count)
            found = [_in_two_sets(keys[own], owner[own]) for own in (np.flatnonzero(keys >> np.uint64(61) == q) for q in range(8))]  # eighths, to sort less at once
            keys, owner, sets = (np.concatenate(x) for x in zip(*found))
            del found, which, ref, n, count
            to = names[owner] % np.uint64(buckets)
            order = np.lexsort((owner, to))
            keys, owner, sets, to = keys[order], owner[order], sets[order], to[order]
            edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, np.int64)
            for a, b, name in zip(edge[:-1].tolist(), edge[1:].tolist(), label_of(to[edge[:-1]].astype(np.int64)).tolist()):
                who, k = np.unique(owner[a:b], return_counts=True)
                out[0].append(name)
                out[1].append(_pack(names[who], sizes[who], k, keys[a:b]) + sets[a:b].astype("<u4").tobytes())
        k = len(out[0])
        give_back()
        more = pa.table({"bucket": pa.array(out[0], pa.int32()), "doc_id": pa.nulls(k, pa.int64()), "h": pa.nulls(k, pa.int64()), "n": pa.nulls(k, pa.int64()), "ref": pa.nulls(k, pa.int64()), "blob": pa.array(out[1], pa.binary())})
        return pa.concat_tables([docs.select(more.column_names).cast(more.schema), more])

    return run


def _ranked(percent: int):
    """A bucket of references: each set's shared n-grams in the order (count, hash), if its prefix reaches them.

    hub is the mean count of its n-grams in thousandths: of a group of near copies, the one that is most like all has the highest."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        parts = [_unpack(x, 4) for x in table.column("blob").to_pylist()]
        del table
        ref, n, count, keys, sets = (np.concatenate(x) for x in zip(*parts))
        del parts
        names, first, which = np.unique(ref, return_index=True, return_inverse=True)
        size, owner = n[first].astype(np.int64), np.repeat(which, count)
        shared = np.bincount(owner, minlength=len(names))
        hub = (np.bincount(owner, weights=sets, minlength=len(names)) * 1000 / size).astype(np.int64)
        order = np.lexsort((keys, sets, owner))
        keys, ends = keys[order].astype("<u8"), np.cumsum(shared)
        kept = np.flatnonzero(shared * 100 >= percent * size)
        rows = [keys[ends[i] - shared[i] : ends[i]].tobytes() for i in kept.tolist()]
        del ref, n, count, sets, which, owner, order, keys
        give_back()
        return pa.table({"ref": pa.array(names[kept].view(np.int64)), "n": pa.array(size[kept]), "unshared": pa.array((size - shared)[kept]), "hub": pa.array(hub[kept]), "keys": pa.array(rows, pa.binary())})

    return run


def _prefix(percent: int):
    """key, ref, n, at, hub: the indexed part of each set's prefix; at counts from 0 in the set's order."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ref, n, unshared, hub = (batch.column(i).to_numpy() for i in range(4))
            k = np.maximum(n - (percent * n + 99) // 100 + 1 - unshared, 0)
            if not k.sum():
                continue
            keys = np.concatenate([np.frombuffer(x, "<i8", c) for x, c in zip(batch.column(4).to_pylist(), k.tolist())])
            at = np.arange(len(keys)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(unshared, k)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ref, k)), pa.array(np.repeat(n, k)), pa.array(at), pa.array(np.repeat(hub, k))], names=["key", "ref", "n", "at", "hub"])

    return ending(run)


def _verify(percent: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            good = []
            a, b, na, nb, ka, kb = (batch.column(i).to_pylist() for i in range(6))
            for i in range(len(a)):
                x, y = np.frombuffer(ka[i], "<u8"), np.frombuffer(kb[i], "<u8")
                least = -(-percent * (na[i] + nb[i]) // (100 + percent))  # overlap that the threshold asks for
                if min(len(x), len(y)) < least:
                    continue
                classes = lambda v: np.bincount((v >> np.uint64(20)).astype(np.int64) & 31, minlength=32)
                if np.minimum(classes(x), classes(y)).sum() >= least and len(np.intersect1d(x, y, assume_unique=True)) >= least:
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int32())), batch.column(1).take(pa.array(good, pa.int32()))], names=["a", "b"])

    return ending(run)


def _passes(percent: int, na, nb, at_a, at_b):
    """Length filter and positional filter of a pair that meets in one n-gram (if it is their first, it decides)."""
    least = F.ceil(percent * (na + nb) / (100 + percent))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - at_a, nb - at_b) >= least)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    own = lambda x: sets.select(F.col("ref").alias(x), F.col("n").alias(f"n{x}"), F.col("keys").alias(f"k{x}"))
    both = pairs.join(own("b"), "b").join(own("a"), "a").select("a", "b", "na", "nb", "ka", "kb")
    return both.mapInArrow(_verify(percent), "a long, b long")


def _release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps now; it does so when their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def classify(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id, keeper (the row of the least doc_id, then h, of its component; none without n-grams) for each document.

    Two documents link when 100 * intersection >= percent * union of their n-gram sets."""
    spark = docs.sparkSession
    scratch, buckets = Scratch(spark, "jaccard"), max(shuffle_partitions(spark), -(-text_bytes(docs) // BUCKET))
    with arrow_batches(spark):
        posted = documents(docs, F.xxhash64(F.col("text").cast("string")).alias("h")).mapInArrow(_post(size, buckets), POSTED)
        counted = scratch.save(posted.groupBy("bucket").applyInArrow(_shared(buckets), POSTED), "counted")
        _release(spark)
        members = scratch.save(counted.filter(F.col("blob").isNull()).select("doc_id", "h", "n", "ref"), "members")
        sets = scratch.save(counted.filter(F.col("blob").isNotNull()).select("bucket", "blob").groupBy("bucket").applyInArrow(_ranked(percent), SETS), "sets")
        scratch.drop("counted")
        prefix = scratch.save(sets.mapInArrow(_prefix(percent), "key long, ref long, n long, at long, hub long"), "prefix")
        _release(spark)

        # one pivot for each n-gram: the set most like the others
        pivot = prefix.groupBy("key").agg(F.max(F.struct("hub", "ref", "n", "at")).alias("p"), F.count("*").alias("sets")).filter("sets > 1").drop("sets")
        met = prefix.join(pivot, "key").filter(F.col("ref") != F.col("p.ref"))
        pairs = met.filter(_passes(percent, F.col("n"), F.col("p.n"), F.col("at"), F.col("p.at"))).select(F.col("p.ref").alias("a"), F.col("ref").alias("b")).distinct()
        links = scratch.save(_links(pairs, sets, percent), "links1")
        comps = components(links, scratch, "first")

        # what is left: sets of different components in one n-gram's list
        named = prefix.join(comps, F.col("ref") == F.col("node"), "left").select("key", "ref", "n", "at", F.coalesce("comp", "ref").alias("comp"))
        open_ = named.groupBy("key", "comp").agg(F.count("*").alias("k"))
        mixed = open_.groupBy("key").agg(F.count("*").alias("comps")).filter("comps > 1").select("key")
        named = scratch.save(named.join(mixed, "key"), "mixed")
        left = named.select("key", F.col("ref").alias("a"), F.col("n").alias("la"), F.col("at").alias("at_a"), F.col("comp").alias("ca"))
        right = named.select("key", F.col("ref").alias("b"), F.col("n").alias("lb"), F.col("at").alias("at_b"), F.col("comp").alias("cb"))
        cross = left.join(right, "key").filter((F.col("ca") < F.col("cb")) & _passes(percent, F.col("la"), F.col("lb"), F.col("at_a"), F.col("at_b")))
        more = scratch.save(_links(cross.select("a", "b").distinct(), sets, percent), "links2")
        for done in ("prefix", "mixed", "sets"):
            scratch.drop(done)
        _release(spark)
        if not more.isEmpty():
            comps = components(more, scratch, "second", known=comps)
    return _classes(members, comps, scratch)


def _classes(members: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """The smallest doc_id of each component, first over copies, then over linked sets."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h"))
    first = members.filter("n > 0").groupBy("ref").agg(least.alias("low"))
    of_set = first.join(comps, F.col("ref") == F.col("node"), "left").select("ref", "low", F.coalesce("comp", "ref").alias("comp"))
    of_set = scratch.save(of_set, "classes")
    of_comp = of_set.groupBy("comp").agg(F.min("low").alias("low"))
    known = of_set.select("ref", "comp").join(of_comp, "comp").select(F.col("ref").alias("known"), "low")
    out = members.join(known, (F.col("ref") == F.col("known")) & (F.col("n") > 0), "left")
    keeper = F.col("low").isNotNull() & F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("h") == F.col("low.h"))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("low.doc_id", "doc_id").alias("component_id"), keeper.alias("keeper"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for each document."""
    return classify(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The documents, all columns, of which one of each component stays: that of the smallest doc_id, then text hash.

    Documents without n-grams are in no group and stay. Rows with equal doc_id and equal text are one, if they have n-grams."""
    found = Scratch(docs.sparkSession, "one").save(classify(docs, size, percent).filter("n_shingles > 0"), "classes")
    id_, h_ = fresh(docs, "other_id"), fresh(docs, "other_h")
    named = [F.col("doc_id").alias(id_), F.col("h").alias(h_)]
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h_))
    left = docs.join(found.filter(~F.col("keeper")).select(*named).distinct(), same, "left_anti")
    twice = found.filter("keeper").groupBy("doc_id", "h").count().filter("count > 1").select(*named)
    if twice.isEmpty():
        return left
    # rows that differ in other columns alone: the first in the order of these, written out
    nth, spelled = fresh(docs, "nth"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    once = left.join(twice, same).withColumn(nth, F.row_number().over(Window.partitionBy(id_, h_).orderBy(spelled))).filter(F.col(nth) == 1).select(*[f"`{c}`" for c in docs.columns])
    return left.join(twice, same, "left_anti").unionByName(once)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
rep AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, sig) AS r FROM (SELECT doc_id, count(*) AS n, bit_xor(g) AS sig FROM s GROUP BY 1)),
u AS (SELECT s.* FROM s JOIN rep USING (doc_id) WHERE doc_id = r),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u AS a JOIN u AS b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (max(na.n) + max(nb.n) - count(*))),
e AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach(x, y) AS (SELECT doc_id, doc_id FROM rep WHERE doc_id = r UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y),
c AS (SELECT x, min(y) AS comp FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_shingles, coalesce(comp, d.doc_id) AS component_id
FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN c ON c.x = rep.r
"""

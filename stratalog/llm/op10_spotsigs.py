"""Operator 10: SpotSigs document fingerprints (DataFrame functions only).

Where a common word (an anchor) is followed by content words, the anchor and the next two content words, common words
between them left out, make a spot signature; of anchors in a row the last one counts. A text's fingerprint is the sorted
set of its signatures' 32-bit hashes, eight hexadecimal digits each. Words far from any spot are signatures themselves: those
more than 16 words away, or than ``900 (spots / words)^2`` if that is less, distinct spots and words counted. In prose spots
lie closer together; the fewer spots a text has, the more of its words count, and without spots all do. Only texts without
words have an empty fingerprint. Likeness is the Jaccard coefficient of two sets (1 for equal fingerprints, 0 if one alone is
empty).

``near_duplicates`` partitions sets by length, so that only neighbouring partitions can reach the threshold, indexes a
prefix of each set, and compares candidates by Jaccard, pruned by the lengths and the positions where they meet. The query
compares each fingerprint with two given ones and doesn't join all with all (see README).

For "the next document", documents are cut into ranges of doc_id at approximate quantiles; an id that takes several
quantiles is cut further by the hash of the text. A window finds the next row within a range, and the first row of the
following range serves its last one. No task sees more than a range; only rows equal in id and text can't be parted.

Edge cases: null or empty text has an empty fingerprint and is near nothing; a null doc_id comes first and never names a
group unless all of it are null; rows with equal doc_id are ordered by their text's hash; a single document is its own
next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, let, shuffle_partitions, words
from .components import components

#: Anchors: common words of the corpus's languages.
ANCHORS = sorted(
    set(
        "a an and are as at be but by for from had has have he in is it its not of on or she that the their there they this to was were which will with you "
        "aber als am auf aus bei das dem den der des die ein eine einer er es für ich im ist mit nicht sich sie so und von war wie zu zum "
        "au aux avec ce dans de des du elle en est et il la le les leur mais ne ou par pas pour que qui se son sur un une "
        "al como con del el ella en es esta la las lo los más no o para pero por que se su sus un una y".split()
    )
)
#: Content words of a chain.
CHAIN = 2
#: How far a spot stands for the words around it: REACH times the square of the share of spots among words, FAR at most.
REACH, FAR = 900, 16
#: Bits of a hash that make its class, by which rarity is counted.
CLASSES = 17
SET = "array<bigint>"


def spots(text: Column) -> Column:
    """The sorted set of signature hashes of a text (without nulls)."""
    none = F.array().cast(SET)
    number = lambda *x: F.shiftrightunsigned(F.xxhash64(*x), 32)

    def of(w: Column) -> Column:
        content = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: ~F.get(w, i).isin(ANCHORS))
        return let(content, lambda c: chains(w, c))

    def chains(w: Column, c: Column) -> Column:
        after = lambda k: F.get(c, k) > F.coalesce(F.get(c, k - 1), F.lit(-1)) + 1
        starts = F.filter(F.sequence(F.lit(0), F.size(c) - CHAIN), after)
        return let(F.when(F.size(c) >= CHAIN, starts).otherwise(F.array().cast("array<int>")), lambda s: marks(w, c, s))

    def marks(w: Column, c: Column, s: Column) -> Column:
        chain = lambda k: number(F.get(w, F.get(c, k) - 1), *[F.get(w, F.get(c, k + j)) for j in range(CHAIN)])
        reach = lambda m: F.least(F.lit(FAR), F.floor(REACH * F.pow(F.size(m) / F.size(F.array_distinct(w)), F.lit(2.0))).cast("int"))
        return let(F.array_distinct(F.transform(s, chain)), lambda m: F.concat(m, let(reach(m), lambda r: far(w, c, s, r))))

    def far(w: Column, c: Column, s: Column, r: Column) -> Column:
        def gap(j: Column) -> Column:
            low, high = F.get(c, F.get(s, j - 1) + (CHAIN - 1)) + 1 + r, F.get(c, F.get(s, j)) - 2 - r
            low, high = F.coalesce(low, F.lit(0)), F.coalesce(high, F.size(w) - 1)
            return F.when(low <= high, F.transform(F.sequence(low, high), lambda i: number(F.get(w, i)))).otherwise(none)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(s)), gap))

    return F.sort_array(F.array_distinct(let(words(text), lambda w: F.when(F.size(w) == 0, none).otherwise(of(w)))))


def fingerprint(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sorted signature sets; equal ones, empty ones and disjoint ranges need no comparison."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b)
    apart = (F.size(a) == 0) | (F.size(b) == 0) | (F.get(a, F.size(a) - 1) < F.get(b, F.lit(0))) | (F.get(b, F.size(b) - 1) < F.get(a, F.lit(0)))
    return F.when(a == b, 1.0).when(apart, 0.0).otherwise(common / (either - common))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, h (hash of the text), n_spots, component_id: documents whose signature sets have a Jaccard coefficient of percent / 100 or more are linked.

    Equal sets are one from the start. As in a prefix join, a set is indexed by its first n - ceil(t n) + l hashes, rare ones
    first, and by its length partition; sets that reach the threshold have l of these in common, l being 1, 2 or 4 by the
    length of the shorter one. Rarity is that of a hash's class, of which there are 2^CLASSES at any size of the input: any
    order is right, and this one keeps hashes that many sets share out of the index. Candidates meet a pivot first and only
    then sets of other components."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "spotsigs")
    text = F.coalesce("text", F.lit(""))
    rows = documents(docs).select("doc_id", F.xxhash64(text).alias("h"), spots(text).alias("spots"))
    rows = scratch.save(rows.select("doc_id", "h", F.col("spots").cast(SET).alias("spots"), F.size("spots").alias("n"), F.xxhash64("spots").alias("ref")), "rows")
    members = scratch.save(rows.drop("spots"), "members")
    sets = rows.filter("n > 0").groupBy("ref").agg(F.first("n").alias("n"), F.first("spots").alias("spots"))
    kind = lambda x: x.bitwiseAND(F.lit((1 << CLASSES) - 1)).cast("int")
    every = rows.select(F.explode("spots").alias("x")).select(kind(F.col("x")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    every = every.unionByName(spark.range(1 << CLASSES).select(F.col("id").cast("int").alias("c"), F.lit(0).cast("long").alias("n"))).groupBy("c").agg(F.sum("n").alias("n"))
    counts = every.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "n"))), lambda x: x["n"]).alias("counts")).withColumn("one", F.lit(1))
    counts = F.broadcast(scratch.save(counts, "counts"))  # one row of 2^CLASSES numbers
    ranked = F.sort_array(F.transform("spots", lambda x: F.shiftleft(F.least(F.get("counts", kind(x)), F.lit((1 << 31) - 1)), 32).bitwiseOR(x)))
    # how common a set's hashes are on average: of a group of near copies, the one most like all has the highest
    hub = F.aggregate("spots", F.lit(0).cast("long"), lambda acc, x: acc + F.get("counts", kind(x))) / F.col("n")
    sets = scratch.save(sets.withColumn("one", F.lit(1)).join(counts, "one").select("ref", "n", ranked.alias("spots"), hub.alias("hub")), "sets")
    scratch.drop("rows")
    often = lambda n: F.when(n < 16, 1).when(n < 32, 2).otherwise(4)  # noqa: E731  l of a set's length
    # Sets of similar length fall into one partition or into neighbours: each is indexed in its own and in the next. A hash
    # goes over the network once; the partitions are made where it arrives.
    part = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    first = F.slice("spots", F.lit(1), F.least(F.col("n"), F.col("n") - F.ceil(percent * F.col("n") / 100).cast("int") + often(F.col("n"))))
    index = sets.select("ref", "n", "hub", F.posexplode(first).alias("at", "key")).repartition("key")
    index = index.select("ref", "n", "hub", "at", "key", F.explode(F.array(part(F.col("n")), part(F.col("n")) + 1)).alias("part"))
    group = Window.partitionBy("key", "part")
    index = index.withColumn("p", F.max(F.struct("hub", "ref", "n", "at")).over(group)).withColumn("sets", F.count("*").over(group))
    index = scratch.save(index.filter("sets > 1").drop("sets"), "index")
    asked = lambda na, nb: F.ceil(percent * (na + nb) / (100 + percent))  # noqa: E731  common hashes that the threshold asks for
    near = lambda na, nb: F.least(na, nb) * 100 >= percent * F.greatest(na, nb)

    def candidates(met: DataFrame) -> DataFrame:
        """a, b of pairs (a, b, na, nb, pa, pb, part: a meeting in one hash) that meet often enough and not too late, in the partition of the longer one."""
        here = met.filter(near(F.col("na"), F.col("nb")) & (F.greatest(part(F.col("na")), part(F.col("nb"))) == F.col("part")))
        # the positions of the first meeting bound what can follow it
        pairs = here.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
        least = asked(F.col("na"), F.col("nb"))
        return pairs.filter((F.col("k") >= F.least(often(F.least("na", "nb")), least)) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= least)).select("a", "b")


    def links(pairs: DataFrame) -> DataFrame:
        own = lambda x: sets.select(F.col("ref").alias(x), F.col("spots").alias(f"s{x}"))
        both = pairs.join(own("a"), "a").join(own("b"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")

    met = index.filter(F.col("ref") != F.col("p.ref")).select(F.col("p.ref").alias("a"), F.col("ref").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"), F.col("p.at").alias("pa"), F.col("at").alias("pb"), "part")
    found = scratch.save(links(candidates(met)), "links1")
    comps = components(found, scratch, "first")
    named = index.drop("p").join(comps, F.col("ref") == F.col("node"), "left").select("part", "key", "ref", "n", "at", F.coalesce("comp", "ref").alias("comp"))
    mixed = named.groupBy("part", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("part", "key")
    named = scratch.save(named.join(mixed, ["part", "key"]), "mixed")
    side = lambda x: named.select("part", "key", F.col("ref").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"p{x}"), F.col("comp").alias(f"c{x}"))
    cross = side("a").join(side("b"), ["part", "key"]).filter(F.col("ca") < F.col("cb"))
    more = scratch.save(links(candidates(cross)), "links2")
    for done in ("sets", "index", "mixed"):
        scratch.drop(done)
    comps = components(more, scratch, "second", known=comps)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id"))
    of_set = members.filter("n > 0").groupBy("ref").agg(least.alias("low")).join(comps, F.col("ref") == F.col("node"), "left").select("ref", "low", F.coalesce("comp", "ref").alias("comp"))
    low = of_set.join(of_set.groupBy("comp").agg(F.min("low").alias("least")), "comp").select("ref", F.col("least.doc_id").alias("component_id"))
    out = members.join(low, "ref", "left").select("doc_id", "h", F.col("n").alias("n_spots"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return scratch.save(out, "components")


def _count_to(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the value, by binary search."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(x).cast("long") for x in cuts])
    return let(table, lambda t: _descend(F.lit(0), t, value, 1 << (len(cuts).bit_length() - 1), len(cuts)))


def _range_of(at: Column, h: Column, cuts: list[int]) -> Column:
    """The range of (at, h): a value that is several cuts is one range for each of them, by h."""
    upper, lower = _count_to(at, cuts), F.when(at == LOWEST, 0).otherwise(_count_to(at - F.lit(1).cast("long"), cuts))
    of = lambda m: F.least(F.floor((h / F.lit(2.0**64) + 0.5) * m).cast("int"), m - 1)
    return let(F.struct(upper.alias("u"), lower.alias("l")), lambda x: F.when(x["u"] - x["l"] < 2, x["u"]).otherwise(x["l"] + 1 + of(x["u"] - x["l"])))


def _descend(at: Column, table: Column, value: Column, step: int, n: int) -> Column:
    if not step:
        return at
    take = (at + step <= n) & (F.get(table, at + step - 1) <= value)
    return let(at + F.when(take, step).otherwise(0), lambda x: _descend(x, table, value, step // 2, n))


#: Stands for a null doc_id in the order.
LOWEST = -(1 << 63)


def with_next(docs: DataFrame, more: dict[str, Column]) -> DataFrame:
    """doc_id, text, the columns of ``more``, and next_text and next_<name>: those of the next document, after the last the first."""
    spark = docs.sparkSession
    rows = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LOWEST)).alias("at")).withColumn("h", F.xxhash64("text"))
    ranges = 4 * shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges)).alias("cuts")).first().cuts or []  # a value for each range
    rows = rows.withColumn("range", _range_of(F.col("at"), F.col("h"), sorted(cuts)))
    # the first document of each range: as many rows as there are ranges, found by id and hash
    least = rows.groupBy("range").agg(F.min(F.struct("at", "h")).alias("x")).select("range", "x.*").orderBy("range").collect()
    held = ["text", *more]
    # what is computed from texts is computed after they have travelled
    full = rows.repartition("range").select("*", *[c.alias(n) for n, c in more.items()])
    ahead = full.withColumn("next", F.lead(F.struct(*held)).over(Window.partitionBy("range").orderBy("at", "h")))
    if least:
        text = json.dumps([{"before": a["range"], "at": b["at"], "h": b["h"]} for a, b in zip(least, least[1:] + least[:1])])
        follower = spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<before:int,at:bigint,h:bigint>>")))
        firsts = rows.join(F.broadcast(follower), ["at", "h"]).withColumn("nth", F.row_number().over(Window.partitionBy("before").orderBy("h"))).filter("nth = 1")
        heads = firsts.select("before", *[c.alias(n) for n, c in {"text": F.col("text"), **more}.items()]).select("before", F.struct(*held).alias("head"))
        both = ahead.join(heads, (F.col("range") == F.col("before")) & F.col("next").isNull(), "left")
        ahead = both.withColumn("next", F.coalesce("next", "head"))
    return ahead.select("doc_id", *held, *[F.col(f"next.{n}").alias(f"next_{n}") for n in held])


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document."""
    rows = with_next(docs, {"spots": spots(F.coalesce(F.col("text"), F.lit("")))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "spots", "next_spots", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "spots", "next_spots", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), spots(F.col("edited")).alias("edited_spots"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))

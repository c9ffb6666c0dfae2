"""Operator 5: license scan by ordered signature rules (DataFrame functions only).

A document passes the keyword prefilter if one of its words is the signal word of any rule's keyword; only then are its
words joined by single spaces, and each keyword found in them calls the rules that it guards (an equi-join with the rule
table, whose size is fixed). Detections are word intervals. One that lies inside another of higher priority, or inside a
longer one of equal priority, is suppressed.

All steps are linear in a text's length but for sorting: word numbers come from running sums, and suppression from running
maxima over the detections of a text in the order of their starts.

Base phrases are reported wherever their words stand, suppression or not.

Edge cases: null or empty text has no words; rows with equal doc_id are scanned each; a null doc_id is kept; repeated and
overlapping phrases count each; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, let, running, words
from .license_rules import GENERIC, rules

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def _places(w: Column, phrase: str) -> Column:
    """Starts of a phrase in the words."""
    want = phrase.split()
    here = lambda i: _all([F.get(w, i + j) == x for j, x in enumerate(want)])
    every = F.sequence(F.lit(0), F.size(w) - len(want))
    return F.when(F.size(w) >= len(want), F.filter(every, here)).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def keywords() -> list[str]:
    return sorted({keyword for _, _, keyword, _, _ in rules()})


def signals() -> list[str]:
    """A word of each keyword that any text with the keyword holds: the longest that is not a generic one."""
    rarest = lambda k: max(k.split(), key=lambda w: (w not in GENERIC, len(w), w))
    return sorted({rarest(k) for k in keywords()})


def rule_table(spark: SparkSession) -> DataFrame:
    """rule, label, guard, pattern, priority: a row for each rule."""
    kind = "array<struct<rule:string,label:string,guard:string,pattern:string,priority:int>>"
    text = json.dumps([dict(zip(("rule", "label", "guard", "pattern", "priority"), r)) for r in rules()])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


DETECTION = "array<struct<start:int,end:int,priority:int,label:string,rule:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, starts (an array for each base phrase), found (array of kept detections), a row for each document."""
    spark = docs.sparkSession
    low = documents(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    gate = F.arrays_overlap("w", F.array(*[F.lit(x) for x in signals()]))
    joined = low.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.when(gate, F.col("w")).alias("w"))
    joined = joined.select("*", F.when(F.col("w").isNotNull(), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))).alias("norm"))
    holds = lambda x: F.contains("norm", F.lit(f" {x}"))
    named = F.filter(F.array(*[F.when(holds(f"{k} "), F.lit(k)) for k in keywords()]), lambda x: x.isNotNull())
    starts = F.struct(*[F.when(holds(p), _places(F.col("w"), p)).otherwise(F.array().cast("array<int>")).alias(label) for p, label in BASE.items()])
    rows = joined.select("row", "doc_id", "n_words", starts.alias("starts"), "norm", F.when(F.col("norm").isNotNull(), named).alias("named"))
    called = rows.select("row", "doc_id", "n_words", "starts", "norm", F.explode_outer("named").alias("keyword"))
    rule = F.broadcast(rule_table(spark))  # fixed size
    pattern = F.concat(F.lit("(?<= )(?:"), F.col("pattern"), F.lit(")(?= )"))
    tried = called.join(rule, F.col("keyword") == F.col("guard"), "left")
    hits = tried.withColumn("hit", F.when(F.col("pattern").isNotNull(), F.regexp_like("norm", pattern)).otherwise(False))
    # each document keeps its row for the first keyword, hit or not
    spans = F.when(F.col("hit"), _word_spans(F.col("norm"), pattern)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    out = hits.select("row", "doc_id", "n_words", "starts", F.when(F.col("hit"), F.struct("rule", "label", "priority", spans.alias("spans"))).alias("d"))
    scratch = Scratch(spark, "license")
    kept = scratch.save(out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("starts").alias("starts"), F.collect_set("d").alias("d")), "detections")
    flat = F.flatten(F.transform("d", lambda d: F.transform(d["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["rule"].alias("rule")))))
    left = _unsuppressed(kept.select("row", F.explode(flat).alias("x")).select("row", "x.*"))
    left = left.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "priority", "label", "rule"))).alias("found"))
    return kept.join(left, "row", "left").select("doc_id", "n_words", "starts", F.coalesce("found", F.array().cast(DETECTION)).alias("found"))


def _word_spans(norm: Column, pattern: Column) -> Column:
    """Word intervals of the matches; a word's number is the count of spaces before it, less one."""
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    step = lambda gap, hit: spaces(gap) + spaces(hit)
    place = lambda hits: lambda gaps: let(
        running(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, step)),
        lambda ends: F.zip_with(hits, ends, lambda hit, end: F.struct((end - spaces(hit) - 1).alias("start"), end.alias("end"))),
    )
    return let(F.regexp_extract_all(norm, pattern, F.lit(0)), lambda hits: let(F.split(norm, pattern), place(hits)))


def _unsuppressed(found: DataFrame) -> DataFrame:
    """Detections (row, start, end, priority, rule, ...) without those inside one of higher priority, or inside a longer one (or the same place by an earlier rule) of equal priority.

    In the order of start, then falling end, priority, then rule, whatever can suppress a detection comes before it; so it is
    suppressed if the greatest end before it, of its priority or above, is not less than its own."""
    before = Window.partitionBy("row").orderBy("start", F.col("end").desc(), F.col("priority").desc(), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({p for *_, p in rules()})
    reach = [F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before).alias(f"reach{p}") for p in levels]
    own = F.coalesce(*[F.when(F.col("priority") == p, F.coalesce(f"reach{p}", F.lit(-1))) for p in levels])
    return found.select("*", *reach).filter(own < F.col("end")).select(*found.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the highest priority of a kept detection, 50 at least with a base phrase, over 100)."""
    base = F.concat(*[F.col("starts")[x] for x in BASE.values()])
    labels = F.filter(F.array(*[F.when(F.size(F.col("starts")[x]) > 0, F.lit(x)) for x in BASE.values()]), lambda x: x.isNotNull())
    every = F.array_sort(F.array_distinct(F.concat(labels, F.transform("found", lambda x: x["label"]))))
    best = F.greatest(F.array_max(F.transform("found", lambda x: x["priority"])), F.when(F.size(labels) > 0, 50).otherwise(0)) / 100.0
    return scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), best.cast("double").alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))

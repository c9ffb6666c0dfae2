"""Connected components of a graph of links by contraction, as DataFrame rounds; only emptiness checks reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str, known: DataFrame | None = None) -> DataFrame:
    """links: a, b (long). Gives node, comp: the smallest node reachable, for every node that has a link.

    First each node keeps the link to its least neighbour below, and its other neighbours are linked to that one instead: a
    group in which all are linked to a few becomes a tree. Then every round names each node by the least of its neighbours
    and itself and replaces links by links of names; the graph shrinks by a factor until no link is left. Names of all
    rounds composed are the components. known: components (node, comp) found before, with which the links are renamed first.
    """
    edges = _ordered(links)
    if known is not None:
        of = lambda x: known.select(F.col("node").alias(f"_{x}"), F.col("comp").alias(f"_{x}c"))
        for x in ("a", "b"):
            edges = edges.join(of(x), F.col(x) == F.col(f"_{x}"), "left").withColumn(x, F.coalesce(f"_{x}c", x)).select("a", "b")
        edges = _ordered(edges)
    least = edges.withColumn("m", F.min("a").over(Window.partitionBy("b")))
    edges = scratch.save(_ordered(least.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))), f"{name}-edges0")
    names, k = known, 0
    while not edges.isEmpty():
        near = edges.union(edges.select("b", "a")).toDF("node", "other").groupBy("node").agg(F.min("other").alias("low"))
        step = scratch.save(near.select("node", F.least("node", "low").alias("comp")), f"{name}-names{k}")
        left = step.select(F.col("node").alias("a"), F.col("comp").alias("na"))
        right = step.select(F.col("node").alias("b"), F.col("comp").alias("nb"))
        edges = scratch.save(_ordered(edges.join(left, "a").join(right, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))), f"{name}-edges{k + 1}")
        if names is None:
            names = step
        else:
            onward = step.select(F.col("node").alias("at"), F.col("comp").alias("to"))
            moved = names.join(onward, F.col("comp") == F.col("at"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
            fresh = step.join(names.select("node"), "node", "left_anti")
            names = scratch.save(moved.unionByName(fresh), f"{name}-all{k}")
        k += 1
    return names if names is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))

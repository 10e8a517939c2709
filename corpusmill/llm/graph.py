"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.lineage import dropped, written
from corpusmill.operators.joins import spread_join

#: Tasks that one node's neighbours are dealt out over.
SALTS = 8


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the edges (a, b); the label is the component's smallest node.

    Large-star and small-star steps alternate until the edges stand still: each node's larger neighbours, then its
    smaller ones, are joined to its smallest neighbour. Minima are combined before they are shuffled and no neighbourhood
    is gathered; a node's neighbours are dealt out over SALTS tasks where they meet its minimum. Each round's edges are written
    out.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while not edges.isEmpty():
        both = _both(edges)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread_join(both.where("b > a"), least, "a", by="b", salts=SALTS).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, small_least, "a", by="b", salts=SALTS).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        before, edges = edges, written(small.where("a <> b").distinct())
        dropped(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    labelled = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labelled.unionByName(labelled.select(F.col("label").alias("node"), "label").distinct())

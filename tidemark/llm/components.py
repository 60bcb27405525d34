"""Connected components of a graph that is given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step: each node's neighbours (the smaller ones and itself, if ``small``; else
    the larger ones) are tied to the least of node and neighbours. Least values are
    aggregated before the shuffle, and a node with very many neighbours is a skewed key
    of a plain join, which adaptive execution splits."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) if small else _both(edges)
    least = pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    tied = pairs.join(least, "a")
    if small:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    else:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: comparable, not null), where
    component is the least node that it is tied to, directly or not.

    Large-star and small-star steps alternate until nothing changes; the rounds grow
    with the logarithm of the longest chain. Each round is written to the shared folder:
    lineage stays short and nothing is collected but one row of sums. Edges of a node to
    itself, repeated and reversed edges are harmless; an empty table gives an empty one.
    """
    edges = written(edges, "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        e = written(_star(_star(e, small=False), small=True), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

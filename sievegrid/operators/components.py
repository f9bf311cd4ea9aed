"""Connected components by contraction, with every round written to scratch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.sources.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node that it reaches) for every node of ``links`` (a, b: long, not null).

    In each round every node takes the smallest of itself and its neighbours, the
    links are rewritten to what their ends took, and links to oneself go. Chains
    halve, so rounds grow as the logarithm of the longest one. A hub's neighbours
    are met in partial aggregates and joins, and never gathered.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    roots = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a")))
        took = materialize(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to")), "took")
        # one jump: what a node took has mostly taken something smaller itself
        nxt = took.select(F.col("node").alias("via"), F.col("to").alias("jump"))
        took = materialize(took.join(nxt, took["to"] == nxt["via"]).select("node", F.col("jump").alias("to")), "jumped")
        left, right = (took.select(F.col("node").alias(f"{x}_node"), F.col("to").alias(f"{x}_to")) for x in "ab")
        moved = edges.join(left, edges["a"] == left["a_node"]).join(right, F.col("b") == right["b_node"])
        moved = moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        # a node and what it took stay linked where the latter moved on
        kept = took.join(left, took["to"] == left["a_node"]).select(F.least("to", "a_to").alias("a"), F.greatest("to", "a_to").alias("b"))
        step = took.select(F.col("node").alias("at"), "to")
        if roots is None:
            roots = step.select(F.col("at").alias("node"), F.col("to").alias("root"))
        else:
            roots = roots.join(step, roots["root"] == step["at"], "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = materialize(roots, "roots")
        edges = materialize(moved.union(kept).where("a <> b").distinct(), "edges")
        if edges.isEmpty():
            return roots

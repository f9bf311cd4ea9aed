"""Closures over edges, by rounds of joins that are written to scratch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.operators.search import top_per
from sievegrid.sources.scratch import materialize


def closure(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """node and depth (least number of edges from a seed) of all that ``seeds`` (node) reach over ``edges`` (src, dst).

    Cycles end, since only nodes not seen before go on. depth: the most rounds.
    """
    frontier, k = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "closure"), 0
    rounds = [frontier]
    while depth is None or k < depth:
        k += 1
        found = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.union, rounds)
        frontier = materialize(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(k)), "frontier")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
        if len(rounds) == 32:  # plans stay short, and what was found is seldom written again
            rounds = [materialize(reduce(DataFrame.union, rounds), "closure")]
    return reduce(DataFrame.union, rounds)


def ancestors(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """What reaches the seeds."""
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, depth)


def scopes(nodes: DataFrame, edges: DataFrame, prod_roots: DataFrame) -> DataFrame:
    """node and scope: prod if a production root reaches it, else dev."""
    prod = closure(edges, prod_roots).select("node", F.lit("prod").alias("scope"))
    return nodes.select("node").join(prod, "node", "left").select("node", F.coalesce("scope", F.lit("dev")).alias("scope"))


def affected(changed: DataFrame, imports: DataFrame, entrypoints: DataFrame, depth: int = 2) -> DataFrame:
    """Files to look at again: changed ones, importers up to ``depth`` steps, and entrypoints that reach a changed one."""
    near = ancestors(imports, changed, depth).select("node")
    reach = ancestors(imports, changed).select("node").join(entrypoints.select("node"), "node", "left_semi")
    return near.union(reach).distinct()


def paths(edges: DataFrame, roots: DataFrame, targets: DataFrame, most: int = 5, depth: int = 12) -> DataFrame:
    """node and path (array of nodes): up to ``most`` shortest ways from a root to each target, without cycles."""
    goal = targets.select("node").distinct()
    back = ancestors(edges, goal, depth).select("node")  # only what leads to a target is walked
    useful = materialize(edges.join(back.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "useful")
    live = roots.select("node", F.array("node").alias("path")).join(back, "node", "left_semi")
    found = None
    for _ in range(depth + 1):
        live = materialize(live, "paths")
        here = live.join(goal, "node", "left_semi")
        found = here if found is None else found.union(here)
        if live.isEmpty():
            break
        live = live.join(useful, live["node"] == useful["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
    return top_per(found, ["node"], [F.size("path"), F.array_join("path", "\0")], most).drop("place")

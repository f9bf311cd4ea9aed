"""Hard negatives by one-dimensional distance keys.

Vectors get one more component so that all have the same length; then a higher inner product with an anchor is a smaller
distance to it. Each vector belongs to its nearest pivot and is stored by (pivot, distance to the pivot). By the triangle
inequality, rows within distance r of an anchor have keys within r of the anchor's own distance to the pivot: an annulus,
which is an interval of keys. A search first scans the annuli around the NEAR nearest pivots; what it finds bounds how far
better rows can be, and the second scan takes exactly the remaining annuli within that bound, so that its end certifies the
result. Scores are exact integers; distances are doubles with a margin.

Positives are searched inside the anchor's label; negatives in rows of other labels, for the window of scores that a
positive allows. Rows of a (pivot) or (label, pivot) are cut by their order into cells of at most about CELL rows, and
anchors that visit a cell into groups of at most about GROUP, so that no task holds more, however hot a label or vector is.
Pivots are chosen from a sample of about SAMPLE rows (they decide work, never results).

Rows with a null id or label, a null vector, or a component that is null or not finite take no part. Rows that share a
vec_id are one: the one with the least (label, vector). Ties of scores go to the smaller vec_id. An anchor without other rows
of its label has no positives and no result; an empty table gives an empty result. Vectors of different lengths fail. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sievegrid.llm.arrow import bound_batches
from sievegrid.llm.vectors import matrix, products, squared, whole
from sievegrid.operators.ranking import positioned
from sievegrid.sources.scratch import materialize

#: Pivots, rows looked at to choose them, pivots of the first scan, rows of a cell, anchors of a group, relative margin of distances.
PIVOTS, SAMPLE, NEAR, CELL, GROUP, MARGIN = 48, 6144, 4, 16_384, 2048, 1e-9


def choose_pivots(sample: np.ndarray, longest: int, pivots: int) -> np.ndarray:
    """Pivots among augmented vectors: centres of a few rounds of clustering of the sample, as doubles."""
    x = _augmented(sample, longest)
    centers = np.unique(x, axis=0)
    centers = centers[np.random.default_rng(5).permutation(len(centers))[:pivots]]
    for _ in range(6):
        near = _gaps(x, centers).argmin(1)
        for j in range(len(centers)):
            if (near == j).any():
                centers[j] = x[near == j].mean(0)
    return centers


def _augmented(x: np.ndarray, longest: int) -> np.ndarray:
    """Vectors with the component that gives all of them the squared length ``longest``."""
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))]).astype(np.float64)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0))


def keyed(rows: DataFrame, pivots: np.ndarray, longest: int) -> DataFrame:
    """Adds ``pivot`` and ``gap``, the key of each row."""
    schema = T.StructType([*rows.select("vec_id", "label", "vec").schema, *T.StructType.fromDDL("pivot int, gap double")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = _gaps(_augmented(matrix(batch.column("vec"), pivots.shape[1] - 1), longest), pivots)
            near = gaps.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(gaps[np.arange(len(near)), near])], names=[*batch.schema.names, "pivot", "gap"])

    return rows.select("vec_id", "label", "vec").mapInArrow(run, schema)


def celled(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their ``cell``, cells with by, least and greatest gap): at most about CELL rows each, in order of (by, gap, vec_id)."""
    placed = positioned(rows, [*by, "gap", "vec_id"], "_sg_at").withColumn("block", F.floor(F.col("_sg_at") / CELL).cast("long")).drop("_sg_at")
    cells = placed.groupBy(*by, "block").agg(F.min("gap").alias("low"), F.max("gap").alias("high"))
    return placed, cells


def visits(anchors: DataFrame, cells: DataFrame, pivots: np.ndarray, longest: int, by_label: bool, again: bool) -> DataFrame:
    """(anchor rows, cell): where each anchor has to look.

    The first scan (again false) looks at cells of the nearest pivots, as far as the anchor's ``reach`` goes; the second one at
    the cells of other pivots within reach.
    """
    schema = T.StructType([*anchors.schema, *T.StructType.fromDDL("pivot int, off double")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("vec"), pivots.shape[1] - 1).astype(np.float64)
            gaps = _gaps(np.column_stack([q, np.zeros(len(q))]), pivots)
            rank = gaps.argsort(1, kind="stable").argsort(1, kind="stable")
            chosen = (rank >= NEAR) if again else (rank < NEAR)
            row, pivot = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(pivot, pa.int32()), pa.array(gaps[row, pivot])], names=[*batch.schema.names, "pivot", "off"])

    looks = anchors.mapInArrow(run, schema)
    slack = F.col("reach") * (1 + 1e-6) + F.lit(1e-6 * float(longest) ** 0.5 + 1e-6)
    within = (looks["off"] - slack <= cells["high"]) & (looks["off"] + slack >= cells["low"])
    on = (looks["pivot"] == cells["pivot"]) & within
    if by_label:
        on &= looks["label"] == cells["label"]
    return looks.join(cells, on).select(*(looks[c] for c in anchors.columns), cells["pivot"].alias("pivot"), cells["block"].alias("block"))


def _in_cells(rows: DataFrame, looks: DataFrame, by: list[str], groups: int, best, schema: str) -> DataFrame:
    """``best`` of each cell's rows for the anchors that look at it; anchors in ``groups`` groups, each with its own copy of the cell."""
    if groups > 1:
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        looks = looks.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    else:
        rows, looks = rows.withColumn("part", F.lit(0)), looks.withColumn("part", F.lit(0))
    keys = [*by, "block", "part"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        left = left.sort_by("vec_id").combine_chunks()
        right = right.combine_chunks()
        width = len(left["vec"][0])
        scores = products(matrix(right["vec"].chunk(0), width), matrix(left["vec"].chunk(0), width))
        return pa.Table.from_pydict(dict(zip(out.names, best(scores, left["vec_id"].to_numpy(), left["label"].to_numpy(), right), strict=True)), schema=out)

    out = to_arrow_schema(T.StructType.fromDDL(schema))
    return rows.groupBy(*keys).cogroup(looks.groupBy(*keys)).applyInArrow(work, schema)


def top_rows(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of the allowed scores, ties by place (rows are in order of id)."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((at, -scores[at]))][:k]


def _positives(k: int):
    def best(scores, ids, labels, right):
        mine, own = right["vec_id"].to_numpy(), right["label"].to_numpy()
        found = [(i, at) for i in range(len(mine)) for at in top_rows(scores[i], (ids != mine[i]) & (labels == own[i]), k)]
        rows, ats = np.array([f[0] for f in found], int), np.array([f[1] for f in found], int)
        return mine[rows], ids[ats], scores[rows, ats]

    return best


def _negatives(k: int, share: int):
    """For each positive of an anchor, the k best rows of other labels with share * positive <= 100 * negative <= 100 * positive."""

    def best(scores, ids, labels, right):
        mine, own = right["vec_id"].to_numpy(), right["label"].to_numpy()
        positives = right["positives"].to_pylist()
        out: list[tuple[int, int, int, int]] = []
        for i, its in enumerate(positives):
            row = scores[i]
            other = (labels != own[i]) & (100 * row >= share * min(p["score"] for p in its))
            for p in its:
                fits = other & (row <= p["score"]) & (100 * row >= share * p["score"])
                out += [(mine[i], p["id"], ids[at], row[at]) for at in top_rows(row, fits, k)]
        return tuple(np.array([o[c] for o in out], np.int64) for c in range(4))

    return best


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best (score, then smaller id) of each group; a group has at most k rows for each cell."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, relabelled: int = 7, positives: int = 5, negatives: int = 5, share: int = 80, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, from ``vectors`` (vec_id, label, embedding).

    Anchors are rows whose id is divisible by ``every``; where an id is divisible by ``relabelled`` the label is (label + 1) % 10 first.
    """
    bound_batches(vectors)
    spark, out = vectors.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    label = F.when(F.col("vec_id") % relabelled == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label").cast("long"))
    some = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding")
    rows = whole(some, "embedding", None, scale, "vec").groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")
    rows = materialize(rows, "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(squared("vec")).alias("longest"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    if not size["n"] or not size["anchors"] or not size["most"]:
        return spark.createDataFrame([], out)
    if size["least"] != size["most"]:
        raise ValueError("vectors have different lengths")
    longest, groups = size["longest"], ceil(size["anchors"] / GROUP)
    sample = rows.sample(min(1.0, SAMPLE / size["n"]), seed=5).orderBy("vec_id").select("vec").limit(2 * SAMPLE).collect() or rows.select("vec").limit(1).collect()
    pivots = choose_pivots(np.array([r["vec"] for r in sample], np.int64), longest, PIVOTS)
    keys = keyed(rows, pivots, longest)
    by_label, label_cells = celled(keys, ["label", "pivot"])
    by_pivot, pivot_cells = celled(keys, ["pivot"])
    anchors = rows.where(F.col("vec_id") % every == 0)
    far = 2.0 * float(longest) ** 0.5 + 1

    def searched(seekers: DataFrame, table: DataFrame, cells: DataFrame, labelled: bool, best, schema: str, by: list[str], k: int, reach) -> DataFrame:
        """Both scans: ``seekers`` have a first reach; ``reach`` narrows it by what the first scan found."""
        ways = ["label", "pivot"] if labelled else ["pivot"]
        scan = lambda s, again: _in_cells(table, visits(s, cells, pivots, longest, labelled, again), ways, groups, best, schema)
        first = materialize(_best(scan(seekers, False), by, k).drop("rank"), "found")
        second = scan(reach(seekers, first), True)
        return _best(first.unionByName(second), by, k)

    # squared distance between an anchor of squared length a and a row of score s: a + longest - 2 s
    apart = lambda a, s: F.sqrt(F.greatest(a + F.lit(longest) - 2 * s, F.lit(0)).cast("double"))

    def narrowed(seekers: DataFrame, first: DataFrame) -> DataFrame:
        worst = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.count("*").alias("_sg_n"), F.min("score").alias("_sg_s"))
        near = F.when(F.col("_sg_n") >= positives, apart(squared("vec"), F.col("_sg_s"))).otherwise(F.col("reach"))
        return seekers.join(worst, "vec_id", "left").withColumn("reach", near).select(*seekers.columns)

    near = searched(anchors.withColumn("reach", F.lit(far)), by_label, label_cells, True, _positives(positives), "anchor_id long, id long, score long", ["anchor_id"], positives, narrowed)
    lists = materialize(near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("positives")), "positives")
    useful = lists.withColumn("positives", F.filter("positives", lambda p: p["score"] >= 0)).where(F.size("positives") > 0)  # a negative score allows nothing below it
    lowest = F.array_min(F.transform("positives", lambda p: p["score"]))
    seekers = anchors.join(useful.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("reach", apart(squared("vec"), F.ceil(lowest * share / 100)))

    def narrowed_windows(seekers: DataFrame, first: DataFrame) -> DataFrame:
        """The reach of an anchor is that of its positive that still has to look farthest."""
        full = first.groupBy("vec_id", "positive_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= negatives)
        done = full.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("positive_id", "s"))).alias("_sg_done"))
        ends = F.transform("positives", lambda p: F.coalesce(F.element_at("_sg_done", p["id"]), F.ceil(p["score"] * share / 100)))
        joined = seekers.join(done, "vec_id", "left").withColumn("_sg_done", F.coalesce("_sg_done", F.create_map().cast("map<bigint,bigint>")))
        return joined.withColumn("reach", apart(squared("vec"), F.array_min(ends))).select(*seekers.columns)

    found = searched(seekers, by_pivot, pivot_cells, False, _negatives(negatives, share), "vec_id long, positive_id long, id long, score long", ["vec_id", "positive_id"], negatives, narrowed_windows)
    scores = lists.select("anchor_id", F.explode("positives").alias("p")).select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return found.withColumnRenamed("vec_id", "anchor_id").join(scores, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

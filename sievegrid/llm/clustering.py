"""Exact centroid clustering with adaptive bounds on the distances to the nearest centroids.

A row keeps an upper bound on the distance to its centroid, lower bounds for the NEAREST next centroids in order, and one
lower bound for all the rest. After a round the bounds are widened by how far the centroids moved. Where they certify that
a row's centroid is still the only nearest one, no distance is computed; else its own distance is made exact, then the
prefix of next centroids that could be nearer is rescanned, and all of them where even the bound of the rest is too small.
Distances are exact integers; bounds are doubles with a margin for their rounding, so ties never rest on a bound.

A round writes one table of rows with bounds and deletes the one before the last; only k centroids reach the driver. Rows
without exactly ``size`` finite components are left out. Rows with a null id come last in the choice of the first
centroids; repeated rows count each; fewer rows than ``k`` give fewer centroids; an empty table gives an empty result.
Other columns are ignored. Sums of components must stay in 64 bits: 2**36 rows at the largest component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.vectors import distances, matrix, whole
from sievegrid.sources.scratch import discard, materialize

#: Next centroids with a lower bound of their own, and the relative margin of all bounds.
NEAREST, MARGIN = 3, 1e-9

_STATE = "vec_id long, vec array<int>, cluster int, upper double, next array<int>, low array<double>, rest double"


def rescanned(x: np.ndarray, centers: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, its distance, the ``keep`` next ones, their distances, distance of the next after them), all exact."""
    d = distances(x, centers)
    order = np.argsort(d, axis=1, kind="stable")
    near = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    rest = near[:, keep + 1] * (1 - MARGIN) if d.shape[1] > keep + 1 else np.full(len(x), np.inf)
    return order[:, 0], near[:, 0] * (1 + MARGIN), order[:, 1 : keep + 1], near[:, 1 : keep + 1] * (1 - MARGIN), rest


def moved_bounds(cluster: np.ndarray, upper: np.ndarray, nexts: np.ndarray, low: np.ndarray, rest: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds that still hold after centroid j moved by at most shift[j]."""
    return (upper + shift[cluster]) * (1 + MARGIN), (low - shift[nexts]) * (1 - MARGIN), (rest - shift.max(initial=0)) * (1 - MARGIN)


def assigned(x: np.ndarray, centers: np.ndarray, cluster: np.ndarray, upper: np.ndarray, nexts: np.ndarray, low: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row and new bounds, from bounds that hold; and how many distances that took."""
    cluster, upper, nexts, low, rest = cluster.copy(), upper.copy(), nexts.copy(), low.copy(), rest.copy()
    least = np.minimum(low.min(axis=1, initial=np.inf), rest)
    open_ = np.flatnonzero(upper >= least)
    if not len(open_):
        return cluster, upper, nexts, low, rest, 0
    own = ((x[open_] - centers[cluster[open_]]) ** 2).sum(1)
    upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + MARGIN)
    scanned, still = len(open_), upper[open_] >= least[open_]
    open_, own = open_[still], own[still]
    full = upper[open_] >= rest[open_]
    some, all_ = open_[~full], open_[full]
    if len(some):
        # the shortest prefix of next centroids that holds all whose bound isn't above the own distance
        need = (upper[some, None] >= low[some]) * np.arange(1, low.shape[1] + 1)
        prefix = need.max(1)
        ids = np.column_stack([cluster[some], nexts[some]])
        exact = np.full(ids.shape, np.iinfo(np.int64).max)
        exact[:, 0] = own[~full]
        bound = np.column_stack([np.zeros(len(some)), low[some]])
        for q in range(1, ids.shape[1]):
            rows = np.flatnonzero(prefix >= q)
            exact[rows, q] = ((x[some[rows]] - centers[ids[rows, q]]) ** 2).sum(1)
            bound[rows, q] = np.sqrt(exact[rows, q].astype(np.float64)) * (1 - MARGIN)
            scanned += len(rows)
        bound[:, 0] = np.sqrt(exact[:, 0].astype(np.float64)) * (1 - MARGIN)
        best = np.lexsort((ids, exact), axis=1)[:, 0]  # smaller distance, then smaller number
        at = np.arange(len(some))
        cluster[some], upper[some] = ids[at, best], np.sqrt(exact[at, best].astype(np.float64)) * (1 + MARGIN)
        bound[at, best] = -1.0  # goes first, and is cut off
        order = np.argsort(bound, axis=1, kind="stable")[:, 1:]
        nexts[some], low[some] = np.take_along_axis(ids, order, 1), np.take_along_axis(bound, order, 1)
    if len(all_):
        scanned += len(all_) * len(centers)
        cluster[all_], upper[all_], nexts[all_], low[all_], rest[all_] = rescanned(x[all_], centers, nexts.shape[1])
    return cluster, upper, nexts, low, rest, scanned


def _round(rows: DataFrame, size: int, centers: np.ndarray, shift: np.ndarray | None) -> DataFrame:
    """One assignment: rows (vec_id, vec), with bounds from the second round on, to rows with cluster and bounds."""
    keep = max(0, min(NEAREST, len(centers) - 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"), size)
            if shift is None:
                made = rescanned(x, centers, keep)
            else:
                cluster = batch.column("cluster").to_numpy().astype(np.int64)
                nexts = batch.column("next").flatten().to_numpy().astype(np.int64).reshape(len(x), keep)
                low = batch.column("low").flatten().to_numpy().reshape(len(x), keep)
                bounds = moved_bounds(cluster, batch.column("upper").to_numpy(), nexts, low, batch.column("rest").to_numpy(), shift)
                *made, _ = assigned(x, centers, cluster, bounds[0], nexts, *bounds[1:])
            cluster, upper, nexts, low, rest = made
            ends = pa.array(np.arange(0, (len(x) + 1) * keep, keep) if keep else np.zeros(len(x) + 1), pa.int32())
            arrays = [batch.column("vec_id"), batch.column("vec"), pa.array(cluster, pa.int32()), pa.array(upper), pa.ListArray.from_arrays(ends, pa.array(nexts.ravel(), pa.int32())), pa.ListArray.from_arrays(ends, pa.array(low.ravel(), pa.float64())), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "vec", "cluster", "upper", "next", "low", "rest"])

    return rows.mapInArrow(run, _STATE)


def _means(rows: DataFrame, size: int, centers: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster's rows; an empty cluster's centroid stays."""
    new = centers.copy()
    for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("vec", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(size))).collect():
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return new


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each row of ``vectors`` (vec_id, embedding) that is kept."""
    spark = vectors.sparkSession
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = written = materialize(whole(vectors.select("vec_id", "embedding"), "embedding", size, scale, "vec").select("vec_id", "vec"), "vectors")
    first = rows.withColumn("_sg_key", key).orderBy(F.col("_sg_key").asc_nulls_last(), "vec").limit(k).collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    centers, shift = np.array([r["vec"] for r in first], np.int64), None
    for _ in range(rounds):
        rows = materialize(_round(rows, size, centers, shift), "clusters")
        discard(written)
        written, new = rows, _means(rows, size, centers)
        shift = np.sqrt(((new - centers) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)
        centers = new
    last = _round(rows, size, centers, shift) if rounds else _round(rows, size, centers, None)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = matrix(batch.column("vec"), size), batch.column("cluster").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(((x - centers[c]) ** 2).sum(1))], names=["vec_id", "cluster", "distance"])

    ends = materialize(last.select("vec_id", "vec", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long"), "assigned")
    discard(written)
    sums = {r["cluster"]: r["d"] for r in ends.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    facts = spark.createDataFrame([(j, sums[j], sum(sums.values()), digests[j]) for j in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return ends.join(F.broadcast(facts), "cluster").select(*(f.split()[0] for f in out.split(", ")))

"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. A document's set is its distinct shingles of five words, as 64-bit hashes.
   Documents with equal sets are one class, and one row stands for it from here.
2. Each class has HASHES MinHash values. Each of TREES orders sorts the classes
   by its own sequence of values. Classes whose common prefix has at least FIRST
   values are one region. A pair is a candidate if the smallest region that holds
   both, at whatever depth (FIRST to DEPTH), has at most SMALL classes: so depth
   adapts to how crowded a region is. In crowded regions each class also pairs
   with its NEAR next ones, those with the longest common prefixes.
3. Candidates are confirmed on full sets, and linked if
   100 * intersection >= 75 * union. Linked classes make components.
4. In crowded regions that hold several components, each class outside the
   region's largest one is compared with every class of another component, in
   blocks, on full sets. What is linked there joins the components.

Sorting spreads equal prefixes over partitions, so no region lands in one task;
pairs over partitions' ends are found from their edges, over several short ones
where need be. A pair at similarity 0.75
is missed with probability (1 - 0.75^3)^20, 2 in 100,000, and less above it.

Null and empty texts have empty sets and are linked with nothing. Rows with a
null doc_id are linked with nothing and kept. Rows that share a doc_id are one
document with the texts' classes linked; they stay or go together. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.arrow import bound_batches, map_slices, texts
from sievegrid.operators.components import components
from sievegrid.operators.ranking import shuffle_width
from sievegrid.sources.scratch import materialize

SHINGLE, PERCENT = 5, 75
HASHES, TREES, FIRST, DEPTH, SMALL, NEAR = 64, 20, 3, 8, 16, 2
#: Rows that a partition's end shows to the next one, and rows that are looked at together.
EDGE, CHUNK = 3 * SMALL, 1 << 16
#: Classes and shingles of a block of a crowded region.
BLOCK, LOAD = 256, 1 << 18
#: A pair at 0.75 agrees in fewer of its HASHES values with probability 2 in a million.
AGREE = 30

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_A = np.array([xxhash.xxh64_intdigest(b"a%d" % i) | 1 for i in range(HASHES)], np.uint64)
_B = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(0xD1B54A32D192ED03, k, 1 << 64)) for k in range(SHINGLE)]


def set_of(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    sums = h[:n] * _POWERS[0]
    for k in range(1, SHINGLE):
        sums = sums + h[k : k + n] * _POWERS[k]
    return np.unique(sums ^ (sums >> np.uint64(29)))


def signature(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES 32-bit MinHash values of each stretch of ``sets``, which begin at ``starts``."""
    out = np.empty((len(starts), HASHES), np.uint32)
    for k in range(HASHES):
        h = sets * _A[k]
        h ^= h >> np.uint64(32)
        h *= _B
        out[:, k] = np.minimum.reduceat((h >> np.uint64(32)).astype(np.uint32), starts)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the set) and sig (big-endian values); the last two null for empty sets."""

    def make():
        def work(part: pa.RecordBatch) -> list:
            sets = [set_of(t) for t in texts(part, "text")]
            n = np.array([len(s) for s in sets], np.int64)
            some = n > 0
            keys: list[bytes | None] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sigs: list[bytes | None] = [None] * len(sets)
            if some.any():
                rows = signature(np.concatenate(sets), np.concatenate(([0], np.cumsum(n[some])[:-1])))
                for i, row in zip(np.flatnonzero(some), rows.astype(">u4"), strict=True):
                    sigs[i] = row.tobytes()
            return [n, pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())]

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(rows, "text", make, "n_shingles long, set_key binary, sig binary", drop=("text",))


def neighbours(lcp: np.ndarray, small: int = SMALL, near: int = NEAR, first: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of a sorted order. lcp[i]: common prefix of rows i and i + 1, 0 where orders change."""
    n = len(lcp) + 1
    left, right = [], []
    padded = np.concatenate((np.zeros(small + 1, lcp.dtype), lcp, np.zeros(small + 1, lcp.dtype)))
    at = np.flatnonzero(lcp >= first)
    depth = lcp[at]
    for k in range(1, small):
        if not len(at):
            break
        if k <= near:
            use = np.ones(len(at), bool)
        else:
            use = np.zeros(len(at), bool)
        size = np.full(len(at), k + 1)
        for step, begin in ((-1, at - 1), (1, at + k)):
            go = np.flatnonzero(size <= small)
            for s in range(small):
                go = go[padded[begin[go] + step * s + small + 1] >= depth[go]]
                if not len(go):
                    break
                size[go] += 1
        use |= size <= small
        left.append(at[use])
        right.append(at[use] + k)
        inside = at + k < n - 1
        at, depth = at[inside], np.minimum(depth[inside], lcp[at[inside] + k])
        deep = depth >= first
        at, depth = at[deep], depth[deep]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


class Order:
    """Sorted rows of some trees: tree, prefix values, class and set size."""

    def __init__(self, tree: np.ndarray, values: np.ndarray, rep: np.ndarray, n: np.ndarray) -> None:
        self.tree, self.values, self.rep, self.n = tree, values, rep, n

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Order:
        tree, rep, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tree", "rep", "n"))
        values = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), ">u4").reshape(-1, DEPTH)
        return cls(tree, values, rep, n)

    def __len__(self) -> int:
        return len(self.rep)

    def cut(self, a: int, b: int) -> Order:
        return Order(self.tree[a:b], self.values[a:b], self.rep[a:b], self.n[a:b])

    def then(self, other: Order) -> Order:
        return Order(*(np.concatenate(x) for x in ((self.tree, other.tree), (self.values, other.values), (self.rep, other.rep), (self.n, other.n))))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of candidates whose set sizes allow a link."""
        if len(self) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        equal = self.values[1:] == self.values[:-1]
        lcp = np.where(equal.all(1), DEPTH, equal.argmin(1))
        lcp[self.tree[1:] != self.tree[:-1]] = 0
        i, j = neighbours(lcp)
        fits = 100 * np.minimum(self.n[i], self.n[j]) >= PERCENT * np.maximum(self.n[i], self.n[j])
        return i[fits], j[fits]

    def named(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(self.rep[i], self.rep[j]), np.maximum(self.rep[i], self.rep[j])


def _found(a: np.ndarray, b: np.ndarray, edge: Order | None = None, part: int = 0, side: int = 0) -> pa.RecordBatch:
    m, e = len(a), len(edge) if edge else 0
    blank = lambda x, kind: pa.array([None] * m + x, kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*a, *[None] * e], pa.int64()),
            pa.array([*b, *[None] * e], pa.int64()),
            blank([part] * e, pa.int32()),
            blank([side] * e, pa.int32()),
            blank(list(range(e)), pa.int32()),
            blank(edge.tree.tolist() if edge else [], pa.int32()),
            blank([v.tobytes() for v in edge.values.astype(">u4")] if edge else [], pa.binary()),
            blank(edge.rep.tolist() if edge else [], pa.int64()),
            blank(edge.n.tolist() if edge else [], pa.int64()),
        ],
        names=["a", "b", "part", "side", "place", "tree", "prefix", "rep", "n"],
    )


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one sorted partition, and its first and last EDGE rows."""
    part = TaskContext.get().partitionId()
    head: Order | None = None
    held: Order | None = None
    none = np.empty(0, np.int64)

    def settle(order: Order, done: int, final: bool) -> tuple[Order, np.ndarray, np.ndarray]:
        """Pairs that begin in rows of ``order`` that have EDGE rows after them, and what later rows still need."""
        i, j = order.pairs()
        end = len(order) if final else max(done, len(order) - EDGE)
        new = (i >= done) & (i < end)
        return order.cut(max(0, end - EDGE), len(order)), *order.named(i[new], j[new])

    done = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = Order.of(batch)
        if head is None or len(head) < EDGE:
            head = rows.cut(0, EDGE) if head is None else head.then(rows).cut(0, EDGE)
        held = rows if held is None else held.then(rows)
        if len(held) >= CHUNK:
            size = len(held)
            held, a, b = settle(held, done, False)
            done = EDGE if size - EDGE >= EDGE else max(0, size - EDGE)
            yield _found(a, b)
    if held is not None:
        last, a, b = settle(held, done, True)
        yield _found(a, b)
        tail = held.cut(max(0, len(held) - EDGE), len(held))
        yield _found(none, none, head, part, 0)
        yield _found(none, none, tail, part, 1)


def prefixes(classes: DataFrame, depth: int) -> DataFrame:
    """tree, prefix (the first ``depth`` values of the tree's order), rep and n of each class in each tree."""
    start = F.col("tree") * (FIRST * 4) % (HASHES * 4) + 1
    rows = classes.select("rep", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    return rows.select("tree", F.substring(F.concat("sig", "sig"), start, F.lit(depth * 4)).alias("prefix"), "rep", "n")


def seams(sizes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(seam, part, side) for each partition but the last: whose last rows (side 1) and whose first ones (side 0) are looked at together.

    sizes: partitions in order, and their rows up to EDGE. A seam is named after the partition that its pairs begin in. It
    reaches back and on until it has EDGE rows on either side, over as many partitions as that takes.
    """
    out = []
    for at in range(len(sizes) - 1):
        for side, way in ((1, range(at, -1, -1)), (0, range(at + 1, len(sizes)))):
            rows = 0
            for k in way:
                out.append((sizes[at][0], sizes[k][0], side))
                rows += sizes[k][1]
                if rows >= EDGE:
                    break
    return out


def candidates(classes: DataFrame, width: int | None = None) -> DataFrame:
    """Distinct pairs (a < b) of classes (rep, n, sig) that the forest's orders put near each other."""
    spark = classes.sparkSession
    rows = prefixes(classes, DEPTH)
    width = width or max(1, min(shuffle_width(classes), classes.count() * TREES // (4 * EDGE)))
    order = rows.repartitionByRange(width, "tree", "prefix", "rep").sortWithinPartitions("tree", "prefix", "rep")
    bound_batches(order)
    found = materialize(order.mapInArrow(_sweep, "a long, b long, part int, side int, place int, tree int, prefix binary, rep long, n long"), "forest")
    sizes = sorted((r["part"], r["n"]) for r in found.where("side = 0").groupBy("part").agg(F.count("*").alias("n")).collect())  # one row per partition
    looks = spark.createDataFrame(seams(sizes), "seam int, part int, side int")
    edges = found.where("part is not null").join(F.broadcast(looks), ["part", "side"])  # a few rows per partition

    def over_seam(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "part", "place"], ascending=[False, True, True])
        order = Order.of(pa.RecordBatch.from_pandas(pdf[["tree", "prefix", "rep", "n"]], preserve_index=False))
        own, behind = ((pdf["side"] == 1) & (pdf["part"] == pdf["seam"])).to_numpy(), (pdf["side"] == 0).to_numpy()
        i, j = order.pairs()
        new = own[i] & behind[j]
        a, b = order.named(i[new], j[new])
        return pd.DataFrame({"a": a, "b": b})

    met = edges.select("seam", "part", "side", "place", "tree", "prefix", "rep", "n").groupBy("seam").applyInPandas(over_seam, "a long, b long")
    return found.where("a is not null").select("a", "b").union(met).where("a <> b").distinct()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of distinct hashes are similar enough for a link."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def same_document(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of texts that share a doc_id, by way of that doc_id."""
    ids = rows.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select(F.col("doc_id").alias("_sg_id"))
    several = rows.join(ids, rows["doc_id"] == ids["_sg_id"]).select("doc_id", F.col("set_key").alias("_sg_key"))
    return several.join(classes, several["_sg_key"] == classes["set_key"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """rep and items (the full set) of the documents whose id is in ``ids`` (rep), made anew from their texts."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(ids.distinct().hint("merge"), "rep", "left_semi")

    def make():
        return lambda part: [pa.array([set_of(t).tobytes() for t in texts(part, "text")], pa.binary())]

    return map_slices(wanted.select("rep", "text"), "text", make, "items binary", drop=("text",))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose full sets are similar enough; each class's set is that of the document it is named after.

    A partition holds each set ``a`` once, before the sets ``b`` that are compared
    with it, and is read as a stream. Joins are by sorting at every size, for the
    sets of ids grow with the corpus; so a small run moves what a large one does.
    """
    asked = pairs.select("a").distinct()
    own = sets.join(asked.hint("merge"), sets["rep"] == asked["a"], "left_semi").select(F.col("rep").alias("a"), F.lit(None).cast("long").alias("b"), "items")
    theirs = pairs.hint("merge").join(sets, pairs["b"] == sets["rep"]).select("a", "b", "items")
    dealt = own.union(theirs).repartition(shuffle_width(pairs), "a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    bound_batches(dealt)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own_sets = None, []
        for batch in batches:
            out_a, out_b = [], []
            for a, b, items in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("items"), strict=True):
                values = np.frombuffer(items.as_buffer(), np.uint64)
                if b is None:
                    if a != at:
                        at, own_sets = a, []
                    if not any(np.array_equal(values, x) for x in own_sets):
                        own_sets.append(values.copy())
                elif any(similar(x, values) for x in own_sets):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def crowded(classes: DataFrame) -> DataFrame:
    """region, tree, rep and n of the classes that share FIRST values of a tree with at least SMALL others."""
    rows = prefixes(classes, FIRST).select(F.xxhash64("tree", "prefix").alias("region"), "tree", "rep", "n")
    full = materialize(rows.groupBy("region").agg(F.count("*").alias("m")).where(F.col("m") > SMALL).select("region"), "crowded")
    return rows.join(full, "region")


def _across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components that a pair of similar sets joins, cell by cell; the sets that ask come first in a cell and are held."""
    columns = [np.arange(t * FIRST, (t + 1) * FIRST) % HASHES for t in range(TREES)]
    at, held, joined = None, [], set()
    reps = roots = sizes = sigs = None
    for batch in batches:
        if not batch.num_rows:
            continue
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("items")]
        ends = np.cumsum([len(x) for x in items])
        values = signature(np.concatenate(items), np.concatenate(([0], ends[:-1])))
        out_a, out_b = [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("region", "i", "j", "asks", "tree", "rep", "root", "outside")), items, values, strict=True)
        for region, i, j, asks, tree, rep, root, outside, own, sig in rows:
            if (region, i, j) != at:
                at, held, joined, reps = (region, i, j), [], set(), None
            if asks:
                held.append((rep, root, own.copy(), sig))
                continue
            if not held:
                continue
            if reps is None:
                reps, roots = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
                sizes, sigs = np.array([len(h[2]) for h in held]), np.stack([h[3] for h in held])
            may = (roots != root) & (100 * np.minimum(sizes, len(own)) >= PERCENT * np.maximum(sizes, len(own)))
            if outside:  # such a pair meets twice
                may &= reps < rep
            which = np.flatnonzero(may)
            same = sigs[which] == sig
            close = same.sum(1) >= AGREE
            for x, equal in zip(which[close], same[close], strict=True):
                pair = (int(roots[x]), root)
                # an earlier tree that both share has them too, or had them among its candidates
                if pair not in joined and not any(equal[columns[t]].all() for t in range(tree)) and similar(held[x][2], own):
                    joined.add(pair)
                    out_a.append(pair[0])
                    out_b.append(pair[1])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def across(inside: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components (node, root) that similar classes of a crowded region join.

    Classes outside the region's largest component ask; all classes of the region
    are asked. Both are cut into blocks, and each pair of blocks is one cell, of
    bounded size, that goes to a task; pairs are met inside tasks and only links
    between components leave them.
    """
    rooted = inside.join(roots, inside["rep"] == roots["node"], "left")
    rows = materialize(rooted.select("region", "tree", "rep", "n", F.coalesce("root", "rep").alias("root")), "inside")
    parts = rows.groupBy("region", "root").agg(F.count("*").alias("k"), F.sum("n").alias("load"))
    largest = F.max_by(F.struct("root", "k", "load"), F.struct("k", "root"))
    mixed = parts.groupBy("region").agg(F.count("*").alias("several"), largest.alias("big"), F.sum("k").alias("m"), F.sum("load").alias("load")).where("several > 1")
    blocks = lambda k, load: F.greatest(F.ceil(k / BLOCK), F.ceil(load / LOAD)).cast("int")
    asking = blocks(F.col("m") - F.col("big.k"), F.col("load") - F.col("big.load"))
    mixed = materialize(mixed.select("region", F.col("big.root").alias("big"), asking.alias("tall"), blocks(F.col("m"), F.col("load")).alias("wide")), "mixed")
    rows = rows.join(mixed, "region").withColumn("outside", F.col("root") != F.col("big"))
    place = lambda among: F.pmod(F.xxhash64("rep"), F.col(among)).cast("int")
    each = lambda among: F.explode(F.sequence(F.lit(0), F.col(among) - 1))
    columns = ["region", "tree", "rep", "root", "outside"]
    ask = rows.where("outside").select(*columns, F.lit(True).alias("asks"), place("tall").alias("i"), each("wide").alias("j"))
    asked = rows.select(*columns, F.lit(False).alias("asks"), place("wide").alias("j"), each("tall").alias("i"))
    met = ask.unionByName(asked).join(sets.where("octet_length(items) > 0"), "rep")
    dealt = met.repartition(shuffle_width(inside), "region", "i", "j").sortWithinPartitions("region", "i", "j", F.col("asks").desc(), "rep")
    bound_batches(dealt)
    return dealt.mapInArrow(_across, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that it reaches) and kept of every row of ``docs``."""
    rows = materialize(signed(docs), "signatures")
    some = rows.where("set_key is not null and doc_id is not null")
    classes = materialize(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    pairs = materialize(candidates(classes), "pairs")
    inside = materialize(crowded(classes), "regions")
    sets = materialize(sets_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(inside.select("rep")), docs), "sets")
    roots = components(confirmed(pairs, sets).union(same_document(some, classes)))
    wider = components(across(inside, roots, sets)).select(F.col("node").alias("_sg_part"), F.col("root").alias("_sg_whole"))
    named = classes.select("set_key", "rep").join(roots, classes["rep"] == roots["node"], "left").select(F.col("set_key").alias("_sg_key"), F.coalesce("root", "rep").alias("_sg_part"))
    named = materialize(named.join(wider, "_sg_part", "left").select("_sg_key", F.coalesce("_sg_whole", "_sg_part").alias("_sg_root")), "named")
    out = rows.join(named, (rows["set_key"] == named["_sg_key"]) & rows["doc_id"].isNotNull(), "left")
    component = F.coalesce("_sg_root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component.eqNullSafe(F.col("doc_id"))).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    gone = materialize(groups(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias("_sg_gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_sg_gone"], "left_anti")

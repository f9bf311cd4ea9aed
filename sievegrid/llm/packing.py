"""Best-two-fit packing of documents into sequences, planned on counts of lengths.

A bin is filled greedily with the longest pieces that fit; then its smallest
piece is given back if two unpacked pieces fill the widened gap more tightly.
Only the length of a piece matters, so the plan is made on one count for each
length: a filled pattern of lengths is used as often as the counts allow, and
each use of a pattern exhausts a length or leaves it too rare for a further one.
The plan's size depends on the sequence length and not on the number of
documents. Spark tokenizes, ranks the pieces of each length (a range sort, no
task holds a length) and gives every piece the place that its rank has.

Null and empty texts are one closing token long. Repeated rows are packed each.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.arrow import map_slices, texts
from sievegrid.llm.bpe import loaded
from sievegrid.operators.ranking import ranked
from sievegrid.sources.scratch import materialize


def pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document.

    Documents of over ``size`` ids are cut into pieces of ``size``; the first one
    takes the remainder. ids_crc32 is of the ids as unsigned little-endian 32 bits.
    """
    end = end_id.to_bytes(4, "little")

    def make():
        pre = loaded(path)

        def work(part: pa.RecordBatch) -> list:
            made = []
            for text in texts(part, "text"):
                ids = pre.ids(text) + end
                n = len(ids) // 4
                cuts = sorted({0, *range(n % size, n, size)}) if n > size else [0]
                view = memoryview(ids)
                made.append([{"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(view[4 * a : 4 * b])} for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], n], strict=True))])
            return [made]

        return work

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    cut = map_slices(rows, "text", make, "pieces array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>", drop=("text",))
    return cut.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32")


def best_two(left: dict[int, int], lengths: list[int], room: int, least: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest that is over ``least`` and at most ``room``."""
    best: tuple[int, int] | None = None
    for a in reversed(lengths[: bisect_right(lengths, room - 1)]):
        if 2 * a <= max(least, sum(best or (0, 0))):
            break
        at = bisect_right(lengths, min(a, room - a))
        while at and lengths[at - 1] == a and left[a] < 2:
            at -= 1
        if at and a + lengths[at - 1] > max(least, sum(best or (0, 0))):
            best = (a, lengths[at - 1])
            if sum(best) == room:
                break
    return best


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence's pieces, longest first) and how often each is used."""
    left = {k: n for k, n in counts.items() if n > 0}
    lengths = sorted(left)
    made = []
    while lengths:
        taken: list[int] = []
        gap = size

        def take(length: int) -> None:
            taken.append(length)
            left[length] -= 1
            if not left[length]:
                lengths.remove(length)

        def give(length: int) -> None:
            taken.remove(length)
            left[length] += 1
            if left[length] == 1:
                lengths.insert(bisect_right(lengths, length), length)

        while lengths and (at := bisect_right(lengths, gap)):
            gap -= lengths[at - 1]
            take(lengths[at - 1])
        if gap and len(taken) > 1 and lengths:
            smallest = min(taken)
            if two := best_two(left, lengths, gap + smallest, smallest):
                give(smallest)
                for x in two:
                    take(x)
        uses = {x: taken.count(x) for x in taken}
        more = min(left[x] // k for x, k in uses.items())
        for x, k in uses.items():
            left[x] -= k * more
            if not left[x] and x in lengths:
                lengths.remove(x)
        made.append((tuple(sorted(taken, reverse=True)), 1 + more))
    return made


_RANK_BITS = 40  # a length and a rank of that length make one sortable key


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Runs of places, by length and first rank: that key, the first rank, the first sequence and the offset."""
    runs: list[tuple[int, int, int, int]] = []
    rank: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            first = rank.get(x, 0)
            runs.append(((x << _RANK_BITS) + first, first, sequence, offset))
            rank[x] = first + times
            offset += x
        sequence += times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(runs), strict=True)) if runs else ()


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = materialize(pieces(docs, path, size, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    where = docs.sparkSession.sparkContext.broadcast(places(plan(counts, size)))
    rows = ranked(cut, ["length"], ["doc_id", "piece", "start"], "_sg_rank")

    def make():
        table = where.value

        def work(part: pa.RecordBatch) -> list:
            length, rank = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_sg_rank"))
            keys, first, sequence, offset = table
            run = np.searchsorted(keys, (length << _RANK_BITS) + rank, side="right") - 1
            return [sequence[run] + rank - first[run], offset[run]]

        return work

    # the slicer measures a text column; these rows have none
    wide = rows.withColumn("_sg_text", F.lit(None).cast("string"))
    return map_slices(wide, "_sg_text", make, "sequence_id long, offset long").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

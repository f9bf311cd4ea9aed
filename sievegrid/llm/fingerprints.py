"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points. At each level runs of one symbol become one
symbol; deterministic coin tossing then gives each symbol a label below 6 that
depends on it and a few symbols to its left, so that neighbours differ; phrases
begin at local minima of the labels, and a phrase's name is a hash of its
symbols. The names are the next level's sequence. Where two texts hold the same
passage, the parses inside it agree but for a few symbols at its ends, whatever
stands before it. The fingerprint holds the SKETCH smallest names of all levels
up to the root; the likeness of two fingerprints estimates the share of names that
both texts have.

Documents are put in order by ranges of (doc_id, hash of the text) that hold about
as many bytes each, however many rows share a doc_id or have none; the first row of
a range is sent to the range before it as well.

Null texts count as empty; the fingerprint of the empty text is empty and like
itself alone. Texts that are equal have equal fingerprints. Null doc_ids come
first; rows of one doc_id go by a hash of their texts, and repeated rows are each
other's next. An empty table gives an empty result. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.arrow import bound_batches, texts
from sievegrid.llm.ranges import below, cuts
from sievegrid.operators.ranking import shuffle_width

SKETCH, LEVELS = 64, 40
#: Ranges for each shuffle partition at least, and bytes of text of a range and of a partition at most.
RANGES, RANGE_BYTES, PART_BYTES = 8, 128 << 20, 256 << 20
CHUNK_ROWS, CHUNK_CHARS = 48, 1 << 17
_ROUNDS = 3  # after the first: 64-bit names to labels below 128, then 14, 8 and 6
_LOWEST = np.array([(b & -b).bit_length() - 1 if b else 0 for b in range(256)], np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_CODES = _mixed(np.arange(0x3000, dtype=np.uint64) + _ODD)


def _merged(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A name for each stretch of ``names`` that begins at ``starts``."""
    lengths = np.diff(starts, append=len(names))
    place = np.arange(len(names)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(names * _POWERS[place & 63], starts)  # names are mixed already
    return _mixed(sums ^ (lengths.astype(np.uint64) * _ODD))


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing: labels below 6, of which neighbours in a sequence differ. first: where sequences begin."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = ~names[first]
    left ^= names
    left &= ~left + np.uint64(1)
    bit = (left.astype(np.float64).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)  # exponents of powers of two
    label = ((bit << np.uint64(1)) | ((names >> bit) & np.uint64(1))).astype(np.uint8)
    for _ in range(_ROUNDS):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = ~label[first]
        at = _LOWEST[label ^ before]
        label = (at << np.uint8(1)) | ((label >> at) & np.uint8(1))
    return label


def _collapsed(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one name as one name, and where sequences begin after that."""
    begin = np.empty(len(names), bool)
    begin[0] = True
    np.not_equal(names[1:], names[:-1], out=begin[1:])
    begin[first] = True
    if begin.all():
        return names, first
    starts = np.flatnonzero(begin)
    length = np.diff(starts, append=len(names)).astype(np.uint64)
    out = names[starts]
    out = np.where(length > 1, _mixed(out ^ (length * _ODD)), out)
    return out, np.searchsorted(starts, first)


def sketches(docs: list[str]) -> list[np.ndarray]:
    """For each text the smallest names, ascending, as 32-bit numbers."""
    lengths = np.array([len(t) for t in docs], np.int64)
    live = np.flatnonzero(lengths)
    found_doc, found = [], []
    if len(live):
        codes = np.frombuffer("".join(docs).encode("utf-32-le", "surrogatepass"), np.uint32)
        names, size = _CODES[codes] if codes.max() < len(_CODES) else _mixed(codes.astype(np.uint64) + _ODD), lengths[live]
        for _ in range(1, LEVELS):
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            names, first = _collapsed(names, first)
            label = _labels(names, first)
            begin = np.empty(len(label), bool)
            begin[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:])
            begin[-1] = False
            last = np.append(first[1:], len(label)) - 1
            begin[last] = False
            after = first[first < last] + 1
            begin[after] = False  # a phrase of one symbol at a text's begin joins the next
            begin[first] = True
            starts = np.flatnonzero(begin)
            names = _merged(names, starts)
            size = np.diff(np.searchsorted(starts, first), append=len(starts))
            owner = np.repeat(live, size)
            done = size == 1
            found_doc.append(owner)
            found.append((names >> np.uint64(32)).astype(np.uint32))
            if done.all():
                break
            names, live, size = names[np.repeat(~done, size)], live[~done], size[~done]
    out = [np.empty(0, np.uint32)] * len(docs)
    if found:
        both = np.concatenate(found_doc).astype(np.uint64) << np.uint64(32) | np.concatenate(found).astype(np.uint64)
        both = np.unique(both)
        owner = (both >> np.uint64(32)).astype(np.int64)
        at = np.searchsorted(owner, np.arange(len(docs) + 1))
        out = [both[a : min(b, a + SKETCH)].astype(np.uint32) for a, b in zip(at, at[1:], strict=False)]
    return out


def fingerprint(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of names that both have, from 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = set(a.tolist()), set(b.tolist())
    least = sorted(x | y)[:SKETCH]
    return sum(v in x and v in y for v in least) / len(least)


def successors(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows dealt so that each stands directly before its next, by ascending doc_id.

    The first row of a range is sent to the range before it as well, and the first of all to the last, marked by
    ``_sg_guest``. ranges: as many as the texts' bytes ask for, unless given.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at, tie = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.shiftright(F.xxhash64(text), 1)
    rows = docs.select("doc_id", text.alias("text"), at.alias("_sg_at"), tie.alias("_sg_tie"))
    places = rows.select(F.col("_sg_at").alias("key"), F.col("_sg_tie").alias("tie"), F.octet_length("text").alias("weight"))
    all_ = places.agg(F.count("*").alias("n"), F.sum("weight").alias("bytes"), F.min(F.struct("key", "tie")).alias("first")).first()
    size, first = all_["bytes"] or 0, tuple(all_["first"] or (0, 0))
    width = max(shuffle_width(docs), size // PART_BYTES)
    marks = [m for m in cuts(places, all_["n"], ranges or max(RANGES * width, size // RANGE_BYTES)) if m > first]
    cell = below(marks, "bigint", F.col("_sg_at"), F.col("_sg_tie"))
    begins = cell != below(marks, "bigint", F.col("_sg_at"), F.col("_sg_tie") - 1)
    is_first = (F.col("_sg_at") == F.lit(first[0])) & (F.col("_sg_tie") == F.lit(first[1]))
    before = F.when(is_first, len(marks)).when(begins, cell - 1)
    stays = F.struct(cell.alias("cell"), F.lit(False).alias("guest"))
    guest = F.struct(before.alias("cell"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("_sg_to", F.explode(F.array_compact(F.array(stays, F.when(before.isNotNull(), guest)))))
    dealt = dealt.select("doc_id", "text", "_sg_at", "_sg_tie", F.col("_sg_to.cell").alias("_sg_cell"), F.col("_sg_to.guest").alias("_sg_guest"))
    return dealt.repartition(width, "_sg_cell").sortWithinPartitions("_sg_cell", "_sg_guest", "_sg_at", "_sg_tie")


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, their texts and one text more) of rows and the row after the last."""
    ids, held, chars, where = [], [], 0, None
    ended = False
    for batch in batches:
        for doc, text, cell, guest in zip(batch.column("doc_id").to_pylist(), texts(batch, "text"), batch.column("_sg_cell").to_pylist(), batch.column("_sg_guest").to_pylist(), strict=True):
            if cell != where:
                ids, held, chars, where, ended = [], [], 0, cell, False
            if ended:
                continue  # rows like the first guest
            if guest or len(ids) >= CHUNK_ROWS or chars >= CHUNK_CHARS:
                if ids:
                    yield ids, [*held, text]
                ids, held, chars, ended = [], [], 0, guest
            if not guest:
                ids.append(doc)
                held.append(text)
                chars += len(text)


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last quarter replaced by as many first code points of
    the next document, by ascending doc_id (after the last: the first).
    """
    dealt = successors(docs, ranges)
    bound_batches(dealt)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held in _compared(batches):
            own = held[:-1]
            edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(own, held[1:], strict=True)]
            marks, other = sketches(held), sketches(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                    pa.array([fingerprint(m) for m in marks[:-1]]),
                    pa.array([fingerprint(m) for m in other]),
                    pa.array([likeness(a, b) for a, b in zip(marks, other, strict=False)]),
                    pa.array([likeness(a, b) for a, b in zip(marks, marks[1:], strict=False)]),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return dealt.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""Byte-level BPE: ranked merges folded over the bytes of distinct words by higher-order functions, and decoding.

A word starts as the ids of its bytes; each step of a fold merges the leftmost pair of lowest rank, until no pair of the word
has a rank. The rank map is a constant of the plan: an array of cells, in which a perfect hash gives each pair of ids its slot.

Tasks count their words in summaries of bounded size; the most frequent words of all documents, at most FREQUENT and each of at
most WORD_BYTES, are folded once, spread over the cluster, and sent to every worker. Words that aren't among them are merged
in the worker that meets them, by a heap on the same ranks, and kept in a cache of bounded size. What the table and the
caches hold changes no result. Decoding concatenates the pieces of the ids.

Null texts count as empty and have no ids. Repeated rows are encoded each, and an empty table gives an empty result. Ids that a
vocabulary doesn't have decode to null, and so do null ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegrid.llm.arrow import bound_batches, map_slices, slices, texts
from sievegrid.sources.scratch import materialize

#: Entries of the table of frequent words, bytes of its longest word, words of a task's summary, and bytes of a worker's cache.
FREQUENT, WORD_BYTES, SUMMARY, CACHE_BYTES = 1 << 17, 32, 1 << 18, 100 << 20
#: Bits of an id in a cell; the value of a pair without a rank; the first bit of a hash that names its bucket.
ID_BITS, NONE, BUCKET_SHIFT = 20, 1 << 30, 40

#: Letters and numbers that Unicode added after the version that the vocabularies' library knows.
NEWER = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    r"\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    r"\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def split_pattern() -> str:
    """The published pattern of these vocabularies, whose classes leave out what is newer than their library."""
    letter, number = rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]"
    return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The rank of each pair of ids whose pieces together are a piece."""
    halves = ((rank, ranks.get(piece[:at]), ranks.get(piece[at:])) for piece, rank in ranks.items() for at in range(1, len(piece)))
    return {(left, right): rank for rank, left, right in halves if left is not None and right is not None}


def in_slots(pairs: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, moves): the pair with hash h is in slot (h modulo cells) xor moves[bits of h], if it is in the table at all.

    A cell is left, right and rank, ID_BITS each. Buckets of hashes, fullest first, get the first move that puts all
    their pairs into free slots, so that a lookup needs one slot.
    """
    slots, buckets = 1 << max(4, (2 * len(pairs)).bit_length()), 1 << max(1, (len(pairs) // 4).bit_length())
    hashed = [(left << ID_BITS | right, rank) for (left, right), rank in pairs.items()]
    hashed = [(xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42), key << ID_BITS | rank) for key, rank in hashed]
    while len({(h >> BUCKET_SHIFT & (buckets - 1), h & (slots - 1)) for h, _ in hashed}) < len(pairs):
        slots *= 2
    held: dict[int, list[tuple[int, int]]] = {}
    for h, cell in hashed:
        held.setdefault(h >> BUCKET_SHIFT & (buckets - 1), []).append((h & (slots - 1), cell))
    cells, moves = [-1] * slots, [0] * buckets
    for bucket, members in sorted(held.items(), key=lambda x: (-len(x[1]), x[0])):
        moves[bucket] = next(m for m in range(slots) if all(cells[at ^ m] < 0 for at, _ in members))
        for at, cell in members:
            cells[at ^ moves[bucket]] = cell
    return np.array(cells, np.int64), np.array(moves, np.int32)


def first_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """Rank of each pair of bytes, at 256 * left + right, or NONE."""
    return np.array([ranks.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)], np.int32)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the same merges, over a list of pieces where it is short, and by a heap of pairs at any length."""
    return _listed(word, ranks) if len(word) <= 2 * WORD_BYTES else _heaped(word, ranks)


def _listed(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    if word in ranks:  # a piece of the vocabulary is what its own bytes merge to
        return [ranks[word]]
    get = ranks.get
    pieces = [word[i : i + 1] for i in range(len(word))]
    low = [get(a + b, NONE) for a, b in zip(pieces, pieces[1:], strict=False)]
    while low and (least := min(low)) < NONE:
        at = low.index(least)
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        del low[at]
        if at:
            low[at - 1] = get(pieces[at - 1] + pieces[at], NONE)
        if at < len(low):
            low[at] = get(pieces[at] + pieces[at + 1], NONE)
    return [ranks[p] for p in pieces]


def _heaped(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    end = list(range(1, len(word) + 1))  # where the piece that starts at a byte ends; 0 where none starts any more
    before = list(range(-1, len(word) - 1))
    heap = []

    def offer(start: int) -> None:
        middle = end[start]
        if middle < len(word) and (rank := ranks.get(word[start : end[middle]])) is not None:
            heap.append((rank, start, middle, end[middle])) if not ready else heapq.heappush(heap, (rank, start, middle, end[middle]))

    ready = False
    for start in range(len(word)):
        offer(start)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, start, middle, stop = heapq.heappop(heap)
        if end[start] != middle or middle >= len(word) or end[middle] != stop:
            continue
        end[start], end[middle] = stop, 0
        if stop < len(word):
            before[stop] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    out, at = [], 0
    while at < len(word):
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Vocabulary:
    """The constants of one rank file on a session."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.ranks = spark, read_ranks(path)
        cells, moves = in_slots(pair_ranks(self.ranks))
        self.merges = self.constant(cells=pa.array(cells), moves=pa.array(moves), first=pa.array(first_pairs(self.ranks)), bytes=pa.array([self.ranks[bytes([b])] for b in range(256)], pa.int32()))

    def constant(self, **arrays: pa.Array) -> Column:
        """A struct of arrays, as a value that is computed once and goes to the tasks with the plan."""
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays.values()]
        made = self.spark.createDataFrame(pa.Table.from_arrays(lists, names=list(arrays)))
        return made.select(F.struct(*arrays)).scalar()


def _pair(t: Column, a: Column, b: Column) -> Column:
    """Rank of a pair of ids, or NONE. Binding values costs more than these few functions, so they are repeated."""
    key = F.shiftleft(a.cast("long"), ID_BITS).bitwiseOR(b)
    h = F.xxhash64(key)
    move = F.get(t["moves"], F.shiftright(h, BUCKET_SHIFT).cast("int").bitwiseAND(F.size(t["moves"]) - 1))  # sizes are powers of two
    cell = F.get(t["cells"], h.bitwiseAND(F.size(t["cells"]) - 1).cast("int").bitwiseXOR(move))
    return F.when(F.shiftright(cell, ID_BITS) == key, cell.bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")).otherwise(F.lit(NONE))


def _state(ids: Column, ranks: Column) -> Column:
    """State of the fold: ids, ranks of their pairs, the lowest of them, and the leftmost place that has it (from 1)."""
    low = F.array_min(ranks)
    return F.struct(ids.alias("ids"), ranks.alias("ranks"), low.alias("low"), F.array_position(ranks, low).cast("int").alias("at"))


def _step(t: Column, s: Column) -> Column:
    """One merge: the pair at ``at`` becomes its id, and the pairs beside it get new ranks."""
    at, ids, ranks, n = s["at"], s["ids"], s["ranks"], F.size(s["ids"])
    left = F.when(at > 1, F.concat(F.slice(ranks, F.lit(1), at - 2), F.array(_pair(t, F.get(ids, at - 2), s["low"])))).otherwise(F.slice(ranks, F.lit(1), F.lit(0)))
    right = F.when(at + 1 < n, F.concat(F.array(_pair(t, s["low"], F.get(ids, at + 1))), F.slice(ranks, at + 2, n))).otherwise(F.slice(ranks, F.lit(1), F.lit(0)))
    joined = F.concat(F.slice(ids, F.lit(1), at - 1), F.array(s["low"]), F.slice(ids, at + 2, n))
    return F.when(s["low"] < NONE, let(F.concat(left, right), lambda r: _state(joined, r))).otherwise(s)


def folded(t: Column, word: Column) -> Column:
    """Ids of a word: its bytes, merged by rank. ``t`` is the constant of merges."""
    letters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    codes = F.transform(letters, lambda c: F.ascii(c))

    def merges(codes: Column) -> Column:
        ids = F.transform(codes, lambda c: F.get(t["bytes"], c))
        ranks = F.transform(F.sequence(F.lit(1), F.size(codes) - 1), lambda i: F.get(t["first"], F.get(codes, i - 1) * 256 + F.get(codes, i)))
        start = let(ranks, lambda r: _state(ids, r))
        return F.when(F.size(codes) < 2, ids).otherwise(F.aggregate(F.slice(codes, F.lit(2), F.size(codes)), start, lambda s, _: _step(t, s), lambda s: s["ids"]))

    return let(codes, merges)


class _Spaces(Exception):
    """White space meets a space: words there depend on both sides."""


class _Cache(dict):
    """Packed ids by key; entries beside those of ``table`` take at most CACHE_BYTES, and long keys aren't held."""

    def __init__(self, table: dict[str, bytes], make: Callable[[str], bytes]) -> None:
        super().__init__(table)
        self.table, self.make, self.held = table, make, 0

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(key) <= 4 * WORD_BYTES:
            self.held += 4 * len(key) + len(ids) + 200
            if self.held > CACHE_BYTES:
                self.clear()
                self.update(self.table)
                self.held = 0
            self[key] = ids
        return ids


class Codec:
    """Encodes and decodes in a worker: ``table`` has the packed ids of frequent words, other words are merged here and cached.

    What stands between two single spaces is looked up whole before it is split into words: no word goes over such a space.
    """

    def __init__(self, ranks: dict[bytes, int], table: dict[str, bytes]) -> None:
        self.find = regex.compile(split_pattern()).findall
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.names = [str(i) for i in range(len(self.pieces))]
        self.words = _Cache(table, lambda word: np.array(merged(word.encode(), ranks), "<i4").tobytes())
        self.chunks = _Cache({}, self._chunk)

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def _chunk(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Spaces
        return self._split(" " + chunk)

    def encode(self, text: str) -> np.ndarray:
        first, *chunks = text.split(" ")
        try:
            if chunks and (not first or first[-1].isspace()):
                raise _Spaces
            packed = b"".join([self._split(first), *map(self.chunks.__getitem__, chunks)])
        except _Spaces:
            packed = self._split(text)
        return np.frombuffer(packed, "<i4")

    def decode(self, ids: list[int] | np.ndarray) -> bytes | None:
        """The pieces of ids in a row, or None where an id isn't in the vocabulary."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.pieces):
            return None
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def _summaries(docs: DataFrame) -> DataFrame:
    """word and n: counts of each task's frequent words. What stands between spaces is counted; a summary of over 2 * SUMMARY entries is
    cut to its SUMMARY most frequent ones, and those of under an 8 * FREQUENT-th of the task's aren't sent."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen, total = regex.compile(split_pattern()).findall, Counter(), 0
        for batch in batches:
            for piece in slices(batch, "text"):
                for text in texts(piece, "text"):
                    seen.update(text.split(" "))
                if len(seen) > 2 * SUMMARY:
                    total += seen.total()
                    seen = Counter(dict(seen.most_common(SUMMARY)))
                    total -= seen.total()
        least = max(2, (total + seen.total()) // (8 * FREQUENT))
        words: Counter[str] = Counter()
        for chunk, n in seen.items():  # what stands between spaces, split only now
            for word in find(" " + chunk) if n >= least and len(chunk) <= 4 * WORD_BYTES else ():
                words[word] += n
        sent = [(w, n) for w, n in words.items() if len(w.encode()) <= WORD_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in sent], pa.string()), pa.array([n for _, n in sent], pa.int64())], names=["word", "n"])

    return docs.mapInArrow(count, "word string, n long")


def frequent_words(vocabulary: Vocabulary, docs: DataFrame) -> dict[str, bytes]:
    """The most frequent words of ``docs`` (text) with their packed ids: at most FREQUENT rows of bounded length."""
    counted = _summaries(docs).groupBy("word").agg(F.sum("n").alias("n")).withColumn("level", F.floor(F.log2("n") * 16).cast("int"))
    counted, room, least = materialize(counted, "words"), FREQUENT, 1 << 30
    for r in counted.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # at most 64 * 16 levels
        room -= r["words"]
        if room < 0:
            break
        least = r["level"]
    spread = counted.where(F.col("level") >= least).repartition(max(1, docs.sparkSession.sparkContext.defaultParallelism), "word")
    made = spread.withColumn("_sg_t", vocabulary.merges).select("word", let(F.col("_sg_t"), lambda t: folded(t, F.col("word"))).alias("ids")).toArrow()
    return {word: np.array(ids, "<i4").tobytes() for word, ids in zip(made["word"].to_pylist(), made["ids"].to_pylist(), strict=True)}


def _coded(docs: DataFrame, vocabulary: Vocabulary, added: str, work: Callable[[Codec, str], tuple], drop: tuple[str, ...]) -> DataFrame:
    """Columns that a codec computes from column ``text``, row by row."""
    bound_batches(docs)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.ranks, frequent_words(vocabulary, docs.select("text"))))

    def make() -> Callable[[pa.RecordBatch], list]:
        codec = Codec(*shared.value)
        return lambda part: list(zip(*(work(codec, t) for t in texts(part, "text")), strict=True))

    return map_slices(docs, "text", make, added, drop=drop)


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with column ``ids`` (array of int): the whole text's ids."""
    return _coded(docs, vocabulary, "ids array<int>", lambda codec, text: (codec.encode(text),), ())


def decoded(df: DataFrame, vocabulary: Vocabulary, out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its column ``ids`` stands for, as binary: their pieces in a row."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.ranks)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, {})
        for batch in batches:
            made = [None if ids is None or None in ids else codec.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, out])

    bound_batches(df)
    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of ``docs``; path: a .tiktoken file, read on the driver."""

    def work(codec: Codec, text: str) -> tuple[int, str, str]:
        ids = codec.encode(text)
        names = ",".join(map(codec.names.__getitem__, ids.tolist()))
        return len(ids), hashlib.sha256(names.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    vocabulary = Vocabulary(docs.sparkSession, path)
    return _coded(docs.select("doc_id", "text"), vocabulary, "n_tokens long, ids_sha256 string, decoded_sha256 string", work, ("text",))

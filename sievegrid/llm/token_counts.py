"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

Tier 1 is a compact table from frequent pre-tokens to their numbers of tokens,
sent to every worker; tier 2 is a bounded cache in each worker that encodes what
tier 1 misses. Words of all documents are counted for the table, in a summary of
bounded size for each task; counts of tokens don't depend on what it holds.

Null texts count as empty, empty texts have 0 tokens, repeated rows are counted
each, other columns are ignored and an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.arrow import bound_batches, map_slices, slices, texts
from sievegrid.llm.bpe import loaded

#: Entries of the table, words that a task's summary holds, and characters of the longest pre-token in the table.
TABLE_ENTRIES, SUMMARY, LONGEST = 16_384, 1 << 17, 32


def frequent_table(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> tuple[bytes, bytes]:
    """The compact table: frequent pre-tokens, joined by NUL, and one byte for each one's number of tokens.

    Words between single spaces are counted; a task gives its ``entries`` most frequent ones, and a summary that holds
    2 * SUMMARY words is cut to the SUMMARY most frequent. Only such summaries are shuffled.
    """
    part = docs.select("text")
    bound_batches(part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        for batch in batches:
            for piece in slices(batch, "text"):
                for text in texts(piece, "text"):
                    words.update(text.split(" "))
                if len(words) > 2 * SUMMARY:
                    words = Counter(dict(words.most_common(SUMMARY)))
        pre, seen = loaded(path), Counter()
        for word, n in words.most_common(entries):
            for p in pre.split(" " + word) if len(word) <= LONGEST and pre.plain(word) else ():
                if len(p) <= LONGEST and "\0" not in p:
                    seen[p] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pre", "n"])

    top = part.mapInArrow(count, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre").limit(entries).collect()
    pre = loaded(path)
    kept = [(r["pre"], k) for r in top if 0 < (k := len(pre.ids(r["pre"])) // 4) < 256]
    return "\0".join(p for p, _ in kept).encode(), np.array([k for _, k in kept], np.uint8).tobytes()


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row of ``docs``.

    path: a tokenizers .json file of a byte-level BPE; executors must see it.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs.select(F.col("text").cast("string").alias("text")), path))

    def make():
        pre = loaded(path)
        names, counts = table.value

        class Lengths(dict):
            def __missing__(self, p: str) -> int:
                return len(pre.cache[p]) // 4

        tier1 = Lengths(zip(names.decode().split("\0"), counts) if names else ())
        get = tier1.__getitem__

        def work(part: pa.RecordBatch) -> list:
            return [[sum(map(get, pre.split(t))) if pre.plain(t) else len(pre.whole(t)) for t in texts(part, "text")]]

        return work

    rows = docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    counted = map_slices(rows, "text", make, "n_tokens long", drop=("text",))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

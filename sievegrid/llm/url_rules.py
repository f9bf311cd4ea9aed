"""URL rules by a sort-merge range join on reversed-host keys.

The labels of a host in reverse, each closed by NUL, make a key; a rule's host
and all its subdomains are then one interval of keys, and intervals are nested or
apart. Keys are cut into ranges of about equally many rows; a page goes to the
range that it is in, a rule to each range that its interval meets. A hot host is
cut too, by hashes of its pages. Ranges are sorted and swept as streams, with a
stack of the rules whose interval is open; the innermost host with a rule whose
path begins the page's path wins, and within a host the longest path.

Null urls and urls without :// have an empty host and path, and no rule fits
them. A rule whose host is null or empty, or whose path or verdict is null, fits
nothing. Of rules with one host and path the verdict that is last by code points
counts. Repeated pages are judged each. An empty table gives an empty result;
without rules every page has the default. Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.arrow import bound_batches
from sievegrid.llm.ranges import below, cuts
from sievegrid.operators.ranking import shuffle_width
from sievegrid.sources.scratch import materialize

#: Ranges for each shuffle partition. What a page gets doesn't depend on them.
RANGES = 4
_LEAST = -(1 << 63)

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    """Host of a url, A-Z lower-cased; empty for null or without ://."""
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Path of a url; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: str) -> str:
    return "".join(label + "\0" for label in reversed(host.split("."))) if host else ""


class Sweep:
    """The stack of open rules, fed with rules and pages in the order of their keys."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, str], list[int]]] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, verdict: str) -> None:
        self._close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        paths[path] = verdict
        if len(path) not in lengths:
            lengths.insert(bisect_left(lengths, len(path)), len(path))

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        self._close(key)
        for host_key, paths, lengths in reversed(self.stack):
            for n in reversed(lengths[: bisect_right(lengths, len(path))]):
                if path[:n] in paths:
                    return ".".join(reversed(host_key[:-1].split("\0"))) + path[:n], paths[path[:n]]
        return None, None


def key_column(host: Column) -> Column:
    """``key_of`` as a column."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\0"), F.lit("\0")))


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges the pages of sorted ranges; a range's rules of a key stand before the pages of that key and of all below it."""
    sweep, where = Sweep(), None
    for batch in batches:
        at: list[int] = []
        rules: list[str | None] = []
        found: list[str | None] = []
        for i, (cell, key, is_page, path, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "key", "is_page", "path", "verdict")), strict=True)):
            if cell != where:
                sweep, where = Sweep(), cell
            if not is_page:
                sweep.open(key, path, verdict)
                continue
            rule, said = sweep.judge(key, path) if key else (None, None)
            at.append(i)
            rules.append(rule)
            found.append(said)
        pages = batch.select(["page_id", "host", "path"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*pages.columns, pa.array(rules, pa.string()), pa.array(found, pa.string())], names=["page_id", "host", "path", "rule", "found"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule (host and path of the winning one, else null) and verdict of every page.

    rules: host, path, verdict. default: the verdict where no rule fits. ranges: RANGES for each shuffle partition, unless given.
    """
    width = shuffle_width(pages)
    ranges = ranges or RANGES * width
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sound = rules.select(host.alias("host"), "path", "verdict").where("host is not null and host <> '' and path is not null and verdict is not null")
    sound = sound.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", key_column(F.col("host")))
    asked = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    asked = materialize(asked.withColumns({"key": key_column(F.col("host")), "tie": F.xxhash64("page_id", "path")}), "asked")
    places = asked.select("key", "tie").union(sound.select("key", F.lit(_LEAST))).withColumn("weight", F.lit(1))
    marks = cuts(places, places.count(), ranges)

    key, least = F.col("key"), F.lit(_LEAST)
    behind = F.concat(F.substr("key", F.lit(1), F.length("key") - 1), F.lit("\1"))  # the first key behind the rule's interval
    first, last = below(marks, "string", key, least), below(marks, "string", behind, least)
    sent = sound.select(F.explode(F.sequence(first, last)).alias("cell"), "key", F.lit(False).alias("is_page"), "path", "verdict", F.lit(None).cast("long").alias("page_id"), "host")
    met = asked.select(below(marks, "string", key, F.col("tie")).alias("cell"), "key", F.lit(True).alias("is_page"), "path", F.lit(None).cast("string").alias("verdict"), "page_id", "host")
    dealt = sent.unionByName(met).repartition(width, "cell").sortWithinPartitions("cell", "key", "is_page", "path")
    bound_batches(dealt)
    judged = dealt.mapInArrow(_sweep, "page_id long, host string, path string, rule string, found string")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))

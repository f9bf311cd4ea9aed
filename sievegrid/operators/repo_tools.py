"""Looks into a repository's files: folders, slices of lines, searches, references, imports, and links to commits and actions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sievegrid.functions.repo import glob_pattern
from sievegrid.operators.search import top_per
from sievegrid.sources.scratch import discard, materialize


def children(files: DataFrame, folder: str) -> DataFrame:
    """name and is_folder of what stands directly in a folder ("" for the root)."""
    prefix = f"{folder}/" if folder else ""
    rest = F.substr("path", F.lit(len(prefix) + 1))
    return files.where(F.startswith("path", F.lit(prefix))).select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("name"), F.contains(rest, F.lit("/")).alias("is_folder")).distinct()


def line_slice(file_lines: DataFrame, asked: DataFrame) -> DataFrame:
    """Lines (file, line, content) that ``asked`` (file, start, end) names."""
    each = asked.select("file", F.explode(F.when(F.col("start") <= F.col("end"), F.sequence("start", "end"))).alias("line")).distinct()
    return file_lines.join(each, ["file", "line"], "left_semi")


def grep(file_lines: DataFrame, pattern: str, glob: str | None = None, regex: bool = False) -> DataFrame:
    """Lines that hold a text, or that a regular expression fits, in files whose path a glob fits."""
    found = file_lines.where(F.col("content").rlike(pattern) if regex else F.contains("content", F.lit(pattern)))
    return found.where(F.col("file").rlike(glob_pattern(glob))) if glob else found


def references(file_lines: DataFrame, names: DataFrame) -> DataFrame:
    """name, file and line of whole-word uses of identifiers. Words of lines are keys of an equi join with ``names`` (name)."""
    words = file_lines.select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("name"))
    return words.join(names.select("name").distinct(), "name").select("name", "file", "line")


def call_sites(file_lines: DataFrame, symbols: DataFrame, most_files: int | None = 5, most_lines: int | None = 8) -> DataFrame:
    """finding_id, file and line where an affected symbol's last part is called; the first files and lines of each finding, or all for None.

    symbols: finding_id, symbol.
    """
    last = symbols.select("finding_id", F.substring_index("symbol", ".", -1).alias("name")).distinct()
    called = file_lines.select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_$][\w$]*)\s*\("), F.lit(1)))).alias("name"))
    hits = called.join(last, "name").select("finding_id", "file", "line").distinct()
    if most_files is not None:
        files = top_per(hits.select("finding_id", "file").distinct(), ["finding_id"], [F.asc("file")], most_files).drop("place")
        hits = hits.join(files, ["finding_id", "file"])
    return hits if most_lines is None else top_per(hits, ["finding_id"], [F.asc("file"), F.asc("line")], most_lines).drop("place")


def import_table(edges: DataFrame) -> DataFrame:
    """file, imports (local targets), packages and importers of each file. edges: file, kind, target, package."""
    out = edges.groupBy("file").agg(F.array_sort(F.collect_set("target")).alias("imports"), F.array_sort(F.collect_set("package")).alias("packages"))
    back = edges.where("target is not null").groupBy(F.col("target").alias("file")).agg(F.array_sort(F.collect_set("file")).alias("importers"))
    none = F.array().cast("array<string>")
    return out.join(back, "file", "full").select("file", *(F.coalesce(c, none).alias(c) for c in ("imports", "packages", "importers")))


def commit_lines(commits: DataFrame) -> DataFrame:
    """commit, run and pos: each commit's place on a line of first parents, from 0 at its oldest commit, which names the line.

    commits: commit, parent (a row for each parent, null for a root). The least parent counts as the first, and its line goes on
    to its least child. Places come from pointer doubling: a round joins each commit with where it points, so a line of n
    commits takes about log2(n) rounds. Histories with a circle, which no repository has, are cut off after 40 rounds.
    """
    first = commits.groupBy("commit").agg(F.min("parent").alias("parent"))
    heirs = first.where("parent is not null").groupBy("parent").agg(F.min("commit").alias("heir"))
    known = first.select(F.col("commit").alias("parent"))
    kept = first.join(heirs, "parent").where("commit = heir").join(known, "parent", "left_semi").select("commit", F.col("parent").alias("to"))
    state = materialize(first.select("commit").join(kept, "commit", "left").select("commit", F.coalesce("to", "commit").alias("to"), F.col("to").isNotNull().cast("long").alias("pos")), "lines")
    for _ in range(40):
        ahead = state.select(F.col("commit").alias("to"), F.col("to").alias("next"), F.col("pos").alias("more")).where("more > 0")
        if ahead.join(state.where("pos > 0").select("to"), "to", "left_semi").isEmpty():
            break
        old, state = state, materialize(state.join(ahead, "to", "left").select("commit", F.coalesce("next", "to").alias("to"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos")), "lines")
        discard(old)
    return state.select("commit", F.col("to").alias("run"), "pos")


def is_ancestor(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """base, head and ancestor: whether base is head or one of its ancestors; null where either commit isn't known.

    commits: commit, parent (a row for each parent, null for a root). Whoever stands on a line at a place has all of the line
    below as ancestors. So a walk goes from line to line over the other parents, a round for each change of lines, and keeps
    only the highest place on each.
    """
    at = commit_lines(commits)
    asked = pairs.select("base", "head").distinct()
    place = lambda name: at.select(F.col("commit").alias(name), F.col("run").alias(f"{name}_run"), F.col("pos").alias(f"{name}_pos"))
    live = materialize(asked.join(place("base"), "base").join(place("head"), "head"), "asked")
    ends = commits.where("parent is not null").join(place("commit"), "commit").join(place("parent"), "parent")
    links = ends.where(~((F.col("commit_run") == F.col("parent_run")) & (F.col("commit_pos") == F.col("parent_pos") + 1)))
    links = materialize(links.select(F.col("commit_run").alias("run"), F.col("commit_pos").alias("from"), F.col("parent_run").alias("to_run"), F.col("parent_pos").alias("to_pos")), "links")
    seen = frontier = materialize(live.select("base", "head", F.col("head_run").alias("run"), F.col("head_pos").alias("top"), F.lit(-1).cast("long").alias("was")), "walk")
    while not frontier.isEmpty():
        steps = frontier.join(links, "run").where((F.col("from") <= F.col("top")) & (F.col("from") > F.col("was"))).groupBy("base", "head", F.col("to_run").alias("run")).agg(F.max("to_pos").alias("up"))
        best = seen.groupBy("base", "head", "run").agg(F.max("top").alias("had"))
        higher = steps.join(best, ["base", "head", "run"], "left").where(F.col("had").isNull() | (F.col("up") > F.col("had")))
        frontier = materialize(higher.select("base", "head", "run", F.col("up").alias("top"), F.coalesce("had", F.lit(-1)).alias("was")), "walk")
        seen = seen.union(frontier)
    found = seen.groupBy("base", "head", "run").agg(F.max("top").alias("top")).join(live, ["base", "head"]).where((F.col("run") == F.col("base_run")) & (F.col("base_pos") <= F.col("top")))
    marked = live.select("base", "head").join(found.select("base", "head").withColumn("hit", F.lit(True)), ["base", "head"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return asked.join(marked, ["base", "head"], "left").select("base", "head", F.col("hit").alias("ancestor"))


#: Bytes of names that one automaton may hold.
AUTOMATON_BYTES = 32 << 20


def names_in(texts: DataFrame, names: DataFrame, key: str, text: str, whole: bool = True) -> DataFrame:
    """name, key and n: how often each name (names: name) stands in each text, overlaps counted, by one sweep of an automaton.

    whole: only where no letter, digit or one of ``_$`` stands right before or after, if the name begins or ends with one. Names are
    sent to the tasks; where they take over AUTOMATON_BYTES, they are dealt into parts by their hash, and texts are swept once for each part.
    Null and empty names and null texts give nothing; repeated names count once.
    """
    some = names.where(F.length("name") > 0).select("name").distinct()
    total = some.agg(F.sum(F.octet_length("name") + 64)).first()[0] or 0
    parts = max(1, -(-total // AUTOMATON_BYTES))
    kind = texts.schema[key].dataType
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField(key, kind), T.StructField("n", T.LongType())])
    arrow, made = to_arrow_schema(schema), []
    for part in range(parts):
        mine = some.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part).toArrow()["name"].to_pylist()
        shared = texts.sparkSession.sparkContext.broadcast(mine)

        def sweep(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for name in shared.value:
                automaton.add_word(name, name)
            automaton.make_automaton()
            word = re.compile(r"[\w$]")
            for batch in batches:
                for k, t in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                    seen: Counter[str] = Counter()
                    for end, name in automaton.iter(t or "") if shared.value else ():
                        begin = end - len(name) + 1
                        inside = whole and ((begin > 0 and word.match(name[0]) and word.match(t[begin - 1])) or (end + 1 < len(t) and word.match(name[-1]) and word.match(t[end + 1])))
                        if not inside:
                            seen[name] += 1
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), arrow.field(0).type), pa.array([k] * len(seen), arrow.field(1).type), pa.array(list(seen.values()), pa.int64())], schema=arrow)

        made.append(texts.select(key, F.col(text).cast("string")).mapInArrow(sweep, schema))
    return reduce(DataFrame.union, made)


def best_actions(actions: DataFrame, resolves: DataFrame) -> DataFrame:
    """finding_id, action, command and others: the action of highest priority that resolves a finding, and how many other advisories it resolves.

    actions: action, priority, command. resolves: action, finding_id, advisory.
    """
    counts = resolves.groupBy("action").agg(F.count_distinct("advisory").alias("n"))
    own = resolves.groupBy("action", "finding_id").agg(F.count_distinct("advisory").alias("own"))
    met = own.join(counts, "action").join(actions.select("action", "priority", "command"), "action")
    best = top_per(met, ["finding_id"], [F.desc("priority"), F.desc("n"), F.asc("action")], 1)
    return best.select("finding_id", "action", "command", (F.col("n") - F.col("own")).alias("others"))


def usages_once(usages: DataFrame, most: int | None = None) -> DataFrame:
    """Different usages (file, line, package, symbol, kind) in order, with place; at most so many of a repository."""
    keys = ["repo", "file", "line", "package", "symbol", "kind"]
    rows = usages.select(*keys).distinct()
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(*keys[1:])))
    return placed if most is None else placed.where(F.col("place") <= most)


def failure_reasons(failures: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """scan and said: numbers of failures by reason, in a stable order ("2 timeout, 1 budget")."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("reason")), F.lit(0)), F.lit(len(order) + 1))
    counts = failures.groupBy("scan", "reason").agg(F.count("*").alias("n"))
    items = F.sort_array(F.collect_list(F.struct(place.alias("place"), "reason", "n")))
    return counts.groupBy("scan").agg(F.array_join(F.transform(items, lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["reason"])), ", ").alias("said"))

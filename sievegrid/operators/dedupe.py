"""Findings that several analyzers report once: transitive clusters, and best-first absorption."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.severity import CONFIDENCES, rank_of
from sievegrid.operators.components import components
from sievegrid.operators.ranking import same
from sievegrid.sources.scratch import materialize

#: Other names of rule families, tails that name none, and categories that may be merged.
FAMILIES = {
    "sqli": "sql-injection", "sql-i": "sql-injection", "nosqli": "nosql-injection", "os-command-injection": "command-injection", "shell-injection": "command-injection",
    "cross-site-scripting": "xss", "reflected-xss": "xss", "stored-xss": "xss", "directory-traversal": "path-traversal", "server-side-request-forgery": "ssrf",
    "unvalidated-redirect": "open-redirect", "insecure-deserialization": "unsafe-deserialization", "deserialization": "unsafe-deserialization", "eval-injection": "code-injection",
    "missing-authentication": "missing-authn", "missing-authorization": "missing-authz",
}
GENERIC, MERGEABLE = ("other", "tainted-flow", ""), ("sast", "taint", "config", "quality")


def family(rule_id: Column) -> Column:
    """The rule's tail under its usual name; blanks and underscores are dashes."""
    tail = F.regexp_replace(F.lower(F.trim(F.substring_index(rule_id, "/", -1))), r"[_\s]+", "-")
    names = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    return F.coalesce(F.element_at(names, tail), tail)


def source_rank(category: Column, traced: Column, produced_by: Column) -> Column:
    """0 taint, 1 deep review, 2 quick review, 3 anything else."""
    by = F.coalesce(produced_by, F.array().cast("array<string>"))
    quick = F.array_contains(by, "sast:llm-fast") & ~F.array_contains(by, "sast:llm")
    return F.when((category == "taint") | traced, 0).when((category == "sast") & quick, 2).when(category == "sast", 1).otherwise(3)


#: Lines of a bin: findings meet where they share one.
BIN = 16
TRACE = "array<struct<file:string,line:int,kind:string>>"


def sink(trace: Column) -> Column:
    """The place (file, line, kind) where a flow ends: its last step of kind sink, else its last step; null without a trace."""
    sinks = F.filter(trace, lambda s: s["kind"] == "sink")
    last = lambda steps: F.try_element_at(steps, F.lit(-1))
    return F.coalesce(last(sinks), last(trace))


def candidate_pairs(findings: DataFrame) -> DataFrame:
    """a and b (a wins): mergeable findings of one CWE or family that meet in a line range or through a trace step.

    findings: id, category, rule_id, cwe, file, start, end, trace (TRACE), rank (unique, smaller wins). Two traced flows
    are paired only if their sinks are on one line or one's sink lies in the other's range. Pairs come from an equi join
    on file, bin of lines and family, so a file's findings don't all meet each other.
    """
    trace = F.coalesce(F.col("trace").cast(TRACE), F.array().cast(TRACE))
    kinds = F.array_compact(F.array(F.concat(F.lit("cwe "), F.upper(F.trim("cwe"))), F.when(~F.col("family").isin(*GENERIC), F.col("family"))))
    rows = findings.where(F.col("category").isin(*MERGEABLE)).select("rank", family(F.col("rule_id")).alias("family"), "cwe", "file", "start", "end", trace.alias("trace"))
    rows = rows.withColumns({"kinds": kinds, "sink": sink(F.col("trace"))})
    bins = F.transform(F.sequence(F.floor(F.least("start", "end") / BIN), F.floor(F.greatest("start", "end") / BIN)), lambda b: F.struct(F.col("file").alias("at"), b.alias("bin")))
    steps = F.transform("trace", lambda s: F.struct(s["file"].alias("at"), F.floor(s["line"] / BIN).alias("bin")))
    places = F.array_distinct(F.concat(F.coalesce(bins, F.array().cast("array<struct<at:string,bin:bigint>>")), steps))
    touched = rows.withColumn("place", F.explode(places)).withColumn("kind", F.explode("kinds"))
    columns = ("rank", "file", "start", "end", "trace", "sink")
    a, b = (touched.select("place", "kind", *(F.col(c).alias(f"{t}_{c}") for c in columns)) for t in "ab")
    passes = lambda x, y: F.exists(f"{x}_trace", lambda s: (s["file"] == F.col(f"{y}_file")) & s["line"].between(F.col(f"{y}_start"), F.col(f"{y}_end")))
    overlap = (F.col("a_file") == F.col("b_file")) & (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))
    within = lambda x, y: (F.col(f"{x}_sink.file") == F.col(f"{y}_file")) & F.col(f"{x}_sink.line").between(F.col(f"{y}_start"), F.col(f"{y}_end"))
    one_end = (F.col("a_sink.file") == F.col("b_sink.file")) & ((F.col("a_sink.line") == F.col("b_sink.line")) | within("a", "b") | within("b", "a"))
    ends = F.col("a_sink").isNull() | F.col("b_sink").isNull() | one_end
    pairs = a.join(b, ["place", "kind"]).where((F.col("a_rank") < F.col("b_rank")) & (overlap | passes("a", "b") | passes("b", "a")) & ends)
    return pairs.select(F.col("a_rank").alias("a"), F.col("b_rank").alias("b")).distinct()


def beaten(pairs: DataFrame) -> DataFrame:
    """b: the findings of ``pairs`` (a beats b) that are absorbed when the best come first; all others win.

    In each round an open finding that no open one beats wins, what it beats is absorbed, and the pairs of decided
    findings go. Rounds are written to scratch and no task holds a component. There are as many as the longest
    chain of pairs in which each waits for the one before: few where ranks are mixed over a file, half of a
    chain's length where they ascend along it.
    """
    open_, lost = pairs, [pairs.select("b").limit(0)]
    while not open_.isEmpty():
        won = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")), "a", "left_anti")
        lost.append(materialize(open_.join(won, "a", "left_semi").select("b").distinct(), "lost"))
        # a winner's pairs go with those that it beats
        left = open_.join(lost[-1], "b", "left_anti").join(lost[-1].select(F.col("b").alias("a")), "a", "left_anti")
        open_ = materialize(left.select("a", "b"), "open")
        if len(lost) == 16:  # plans stay short
            lost = [materialize(reduce(DataFrame.union, lost), "lost")]
    return reduce(DataFrame.union, lost)


def absorbed(findings: DataFrame) -> DataFrame:
    """id and winner_id of findings that a better one absorbs: best first, each takes what matches it and isn't taken.

    Absorption isn't transitive. Findings of one family, CWE, file, line range and trace meet each other and the same
    others, so the best of them alone is paired, and the others go with it: to its winner, or else to itself.
    Pairs grow with the different ranges of a file and not with the square of its findings.
    """
    trace = F.coalesce(F.col("trace").cast(TRACE), F.array().cast(TRACE))
    rows = findings.where(F.col("category").isin(*MERGEABLE)).withColumns({"rank": F.col("rank").cast("long"), "trace": trace, "_sg_family": family(F.col("rule_id")), "cwe": F.upper(F.trim("cwe"))})
    key = ["_sg_family", "cwe", "file", "start", "end", "trace"]
    meets = F.coalesce(F.col("file").isNotNull() & (F.col("start") <= F.col("end")), F.lit(False)) & (~F.col("_sg_family").isin(*GENERIC) | F.col("cwe").isNotNull())
    rows = materialize(rows.select("id", "category", "rule_id", "rank", *key, meets.alias("_sg_meets")), "findings")
    alike = rows.where("_sg_meets")
    bests = materialize(alike.groupBy(*key).agg(F.min("rank").alias("best"), *(F.min_by(c, "rank").alias(c) for c in ("id", "category", "rule_id"))), "bests")
    alone = rows.where("not _sg_meets")
    columns = ["id", "category", "rule_id", "cwe", "file", "start", "end", "trace", "rank"]
    pairs = materialize(candidate_pairs(bests.withColumnRenamed("best", "rank").select(*columns).union(alone.select(*columns))), "pairs")
    # a finding may meet a winner before a better one is known to win, so winners are chosen when all are known
    taken = pairs.join(beaten(pairs).select(F.col("b").alias("a")), "a", "left_anti").groupBy(F.col("b").alias("best")).agg(F.min("a").alias("winner"))
    of = alike.alias("x").join(bests.alias("y"), same(alike, bests, [(k, k) for k in key])).select("x.id", "x.rank", "y.best").union(alone.select("id", "rank", F.col("rank").alias("best")))
    won = of.join(taken, "best", "left").withColumn("winner", F.coalesce("winner", "best")).where("winner <> rank").select("id", "winner")
    names = rows.select(F.col("rank").alias("winner"), F.col("id").alias("winner_id"))
    return won.join(names, "winner").select("id", "winner_id")


def merged_winners(findings: DataFrame, taken: DataFrame) -> DataFrame:
    """id, produced_by, fingerprints and note of each winner: what its losers add to it, best first.

    findings: id, rank, analyzer, produced_by, fingerprint, merged, rule_id, file, start. taken: id, winner_id.
    """
    none = F.array().cast("array<string>")
    by = F.coalesce("produced_by", F.array("analyzer"))
    place = F.concat("analyzer", F.lit(" ("), "rule_id", F.lit(" at "), "file", F.lit(":"), F.col("start").cast("string"), F.lit(")"))
    rows = findings.select("id", "rank", by.alias("by"), "fingerprint", F.coalesce("merged", none).alias("merged"), place.alias("place"))
    parts = rows.join(taken, "id").select(F.col("winner_id"), F.struct("rank", "by", F.concat(F.array("fingerprint"), "merged").alias("keys"), "place").alias("loser"))
    losers = parts.groupBy(F.col("winner_id").alias("id")).agg(F.sort_array(F.collect_list("loser")).alias("losers"))  # what meets one finding
    of = lambda c: F.transform("losers", lambda x: x[c])
    joined = losers.join(rows, "id")
    keys = F.filter(F.array_distinct(F.concat("merged", F.flatten(of("keys")))), lambda k: k != F.col("fingerprint"))
    note = F.concat(F.lit("Also reported by: "), F.array_join(of("place"), "; "), F.lit("."))
    return joined.select("id", F.array_distinct(F.concat("by", F.flatten(of("by")))).alias("produced_by"), keys.alias("fingerprints"), note.alias("note"))


def ranked_findings(findings: DataFrame) -> DataFrame:
    """Adds rank as a struct: source, severity, confidence, fingerprint, id; smaller wins."""
    traced = F.coalesce(F.size("trace"), F.lit(0)) > 0
    key = F.struct(source_rank(F.col("category"), traced, F.col("produced_by")), rank_of(F.col("severity")), rank_of(F.col("confidence"), CONFIDENCES), F.col("fingerprint"), F.col("id"))
    return findings.withColumn("win_key", key)


def clusters(issues: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and cluster (smallest id) of issues (id: long), transitively over ``pairs`` (a, b)."""
    roots = components(pairs)
    return issues.select("id").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("cluster"))

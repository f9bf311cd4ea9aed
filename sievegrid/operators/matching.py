"""Findings of two scans: identity, fuzzy identity, suppression, and what became of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.text import jaccard, words_of
from sievegrid.operators.search import latest_per
from sievegrid.sources.scratch import materialize

LINE_SLACK, RULE_LIKENESS, TITLE_LIKENESS, GENERIC_TITLE_LIKENESS = 3, 0.5, 0.6, 0.8
#: Rule tails that say nothing, and categories whose text a model writes.
GENERIC_TAILS = ("other", "tainted-flow", "")
AI_WRITTEN = ("sast", "taint", "quality", "config")


def finding_keys(fingerprint: Column, merged: Column) -> Column:
    return F.concat(F.array(fingerprint), F.coalesce(merged, F.array().cast("array<string>")))


def exact_matches(base: DataFrame, head: DataFrame) -> DataFrame:
    """head_id and base_id: the first base finding (by ord) that has the first of a head finding's keys that any has.

    Both: id, ord, keys. Several head findings may continue one base finding.
    """
    by_key = base.select("ord", F.col("id").alias("base_id"), F.explode("keys").alias("key"))
    first = by_key.groupBy("key").agg(F.min_by("base_id", "ord").alias("base_id"))
    asked = head.select(F.col("id").alias("head_id"), F.posexplode("keys").alias("pos", "key"))
    return asked.join(first, "key").groupBy("head_id").agg(F.min_by("base_id", "pos").alias("base_id"))


def same_issue(a: str, b: str) -> Column:
    """Whether findings of columns ``a``_* and ``b``_* are one issue that was worded or placed a little differently.

    Columns: category, file, start, end, cwe, tail, title.
    """
    x, y = (lambda n: F.col(f"{a}_{n}")), (lambda n: F.col(f"{b}_{n}"))
    near = (x("start") <= y("end") + LINE_SLACK) & (y("start") <= x("end") + LINE_SLACK)
    cwe = x("cwe").isNull() | y("cwe").isNull() | (F.upper(F.trim(x("cwe"))) == F.upper(F.trim(y("cwe"))))
    titles, tails = jaccard(words_of(x("title")), words_of(y("title"))), jaccard(words_of(x("tail")), words_of(y("tail")))
    generic = x("tail").isin(*GENERIC_TAILS) | y("tail").isin(*GENERIC_TAILS)
    worded = F.when(generic, titles >= GENERIC_TITLE_LIKENESS).otherwise((x("tail") == y("tail")) | ((tails >= RULE_LIKENESS) & (titles >= TITLE_LIKENESS)))
    return (x("category") == y("category")) & x("category").isin(*AI_WRITTEN) & (x("file") == y("file")) & near & cwe & worded


def fuzzy_matches(base: DataFrame, head: DataFrame) -> DataFrame:
    """head_id and base_id, one to one: pairs of same_issue, closest lines first, then by head and base order.

    Pairs are made by an equi join on category and file, and chosen in rounds.
    """
    columns = ["id", "ord", "category", "file", "start", "end", "cwe", "tail", "title"]
    b, h = (d.select(*(F.col(c).alias(f"{t}_{c}") for c in columns)) for d, t in ((base, "b"), (head, "h")))
    pairs = h.join(b, (F.col("h_category") == F.col("b_category")) & (F.col("h_file") == F.col("b_file"))).where(same_issue("h", "b"))
    pairs = pairs.select(F.col("h_id").alias("head_id"), F.col("b_id").alias("base_id"), F.struct(F.abs(F.col("h_start") - F.col("b_start")), F.col("h_ord"), F.col("b_ord")).alias("order"))
    return greedy_pairs(pairs, "head_id", "base_id", "order")


def greedy_pairs(pairs: DataFrame, left: str, right: str, order: str) -> DataFrame:
    """left and right, one to one: the pairs that a walk over all of them by ``order`` (which tells pairs apart) takes.

    In each round a pair that is first at both of its ends is taken, and all other pairs of its ends go. Rounds are
    written to scratch, and no task holds a file or a component.
    """
    open_, taken = materialize(pairs.select(left, right, order), "pairs"), [pairs.select(left, right).limit(0)]
    while not open_.isEmpty():
        first = lambda c: open_.groupBy(c).agg(F.min(order).alias(f"_sg_{c}"))  # noqa: E731, B023
        best = open_.join(first(left), left).join(first(right), right).where((F.col(order) == F.col(f"_sg_{left}")) & (F.col(order) == F.col(f"_sg_{right}")))
        won = materialize(best.select(left, right), "taken")
        taken.append(won)
        open_ = materialize(open_.join(won.select(left), left, "left_anti").join(won.select(right), right, "left_anti").select(left, right, order), "open")
    return reduce(DataFrame.union, taken)


def matches(base: DataFrame, head: DataFrame) -> DataFrame:
    """head_id, base_id and how: exact ones first, then fuzzy ones among what is left."""
    exact = exact_matches(base, head)
    rest_head = head.join(exact.select(F.col("head_id").alias("id")), "id", "left_anti")
    rest_base = base.join(exact.select(F.col("base_id").alias("id")).distinct(), "id", "left_anti")
    return exact.select("head_id", "base_id", F.lit("exact").alias("how")).union(fuzzy_matches(rest_base, rest_head).select("head_id", "base_id", F.lit("fuzzy")))


def scan_status(base: DataFrame, head: DataFrame, looked_at: DataFrame) -> DataFrame:
    """id and status: new and existing ones of head, and fixed ones of base whose file (looked_at: file) was looked at."""
    pairs = matches(base, head)
    now = head.join(pairs.select(F.col("head_id").alias("id"), F.lit("existing").alias("status")), "id", "left").select("id", F.coalesce("status", F.lit("new")).alias("status"))
    gone = base.join(pairs.select(F.col("base_id").alias("id")).distinct(), "id", "left_anti").join(looked_at.select("file").distinct(), "file", "left_semi")
    return now.union(gone.select("id", F.lit("fixed").alias("status")))


def suppressed(findings: DataFrame, suppressions: DataFrame, now: Column) -> DataFrame:
    """id and status of findings with a suppression in force under any of their keys; the first key that has one counts."""
    live = suppressions.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select(F.col("fingerprint").alias("key"), "status")
    asked = findings.select("id", F.posexplode("keys").alias("pos", "key"))
    return asked.join(live, "key").groupBy("id").agg(F.min_by("status", "pos").alias("status"))


def diff(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status of the distinct keys of both: added, fixed (only in base) or unchanged; null keys are equal."""
    side = lambda df, n: df.select(*keys, F.lit(n).alias("_sg_side"))
    both = side(base, 1).union(side(head, 2)).groupBy(*keys).agg(F.bit_or("_sg_side").alias("_sg_side"))
    return both.select(*keys, F.when(F.col("_sg_side") == 3, "unchanged").when(F.col("_sg_side") == 2, "added").otherwise("fixed").alias("status"))


def covered(rows: DataFrame, coverage: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with covered: whether ``coverage`` has their keys."""
    marks = coverage.select(*keys).distinct().withColumn("_sg_covered", F.lit(True))
    return rows.join(marks, keys, "left").select(*rows.columns, F.coalesce("_sg_covered", F.lit(False)).alias("covered"))


def first_of(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row of each key."""
    return latest_per(df, [key], [F.col(ordinal)])


def recall(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """expected_id, category and found: whether a finding lies in the file, within the tolerance, with the rule tail or CWE wanted.

    expected: expected_id, category, file, line, line_tolerance, cwe, rule_hint. findings: file, start, end, cwe, tail.
    """
    f = findings.select(F.col("file").alias("f_file"), F.col("start").alias("f_start"), F.col("end").alias("f_end"), F.col("cwe").alias("f_cwe"), F.col("tail").alias("f_tail"))
    near = (F.col("f_start") <= F.col("line") + F.col("line_tolerance")) & (F.col("f_end") >= F.col("line") - F.col("line_tolerance"))
    kind = F.col("f_cwe").eqNullSafe(F.col("cwe")) | F.contains(F.col("f_tail"), F.col("rule_hint"))
    joined = expected.join(f, (F.col("file") == F.col("f_file")) & near & F.coalesce(kind, F.lit(False)), "left")
    return joined.groupBy("expected_id", "category").agg(F.max(F.col("f_file").isNotNull()).alias("found"))


def affected_versions(versions: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows of ``versions`` (package, version, key) with advisory: those inside an interval (package, advisory, from_key, to_key, last_key).

    from is inside and missing means from the first; to is outside; last is inside.
    """
    i = intervals.withColumnRenamed("package", "_sg_package")
    inside = (F.col("from_key").isNull() | (F.col("key") >= F.col("from_key"))) & (F.col("to_key").isNull() | (F.col("key") < F.col("to_key"))) & (F.col("last_key").isNull() | (F.col("key") <= F.col("last_key")))
    return versions.join(i, (F.col("package") == F.col("_sg_package")) & inside).select(*versions.columns, "advisory").distinct()


def reachability(own: Column, sandboxed: Column, symbol_match: Column, malicious: Column, direct: Column, dev: Column, index_source: Column, ancestor_imported: Column, has_usage: Column) -> Column:
    """reachable, imported, unreachable or unknown, by the first rule that holds."""
    return (
        F.when(~has_usage, "unknown").when(own & malicious, "reachable").when(own & sandboxed & symbol_match, "reachable").when(own, "imported")
        .when(direct & index_source & ~dev, "unknown").when(direct, "unreachable").when(ancestor_imported, "unknown").otherwise("unreachable")
    )

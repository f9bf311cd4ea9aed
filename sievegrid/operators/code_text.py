"""Repository text: lines, metrics, duplicate blocks, located snippets, and SARIF documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1) and content of every line."""
    return df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)


def file_metrics(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines, lines with code, to-do marks and their share, and the longest line, without a shuffle."""
    rows = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    code = F.size(F.filter(rows, lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(//|#|\*|/\*)")))
    todo = F.size(F.filter(rows, lambda x: x.rlike(r"\b(TODO|FIXME|HACK|XXX)\b")))
    longest = F.array_max(F.transform(rows, F.length))
    return df.select(key, F.size(rows).alias("lines"), code.alias("code_lines"), todo.alias("todos"), F.when(code > 0, todo / code).otherwise(0.0).alias("todo_density"), longest.alias("longest_line"))


def equal_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """digest, first (least key) and n of each text that is there more than once; null texts are left out."""
    return df.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("digest")).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")


def duplicate_blocks(df: DataFrame, key: str, text: str, size: int = 6) -> DataFrame:
    """file_a, start_a, file_b, start_b and length of stretches of at least ``size`` equal lines, each taken with the first place that has it.

    Lines are compared without outer space, and empty ones are skipped. Windows of lines are hashed; windows that follow
    each other at the same distance in the same two files are one stretch. A window in many files is met once for each of
    them, with its first place, and never as all pairs.
    """
    kept = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("content"))), lambda x: x["content"] != "")
    starts = F.when(F.size("kept") >= size, F.sequence(F.lit(1), F.size("kept") - size + 1)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.struct(i.alias("at"), F.element_at("kept", i)["line"].alias("line"), F.xxhash64(F.transform(F.slice("kept", i, F.lit(size)), lambda x: x["content"])).alias("hash"))
    windows = df.select(F.col(key).alias("file"), kept.alias("kept")).select("file", F.explode(F.transform(starts, window)).alias("w")).select("file", "w.at", "w.line", "w.hash")
    first = windows.groupBy("hash").agg(F.min(F.struct("file", "at", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = windows.join(first, "hash").where((F.col("file") != F.col("first.file")) | (F.col("at") != F.col("first.at")))
    pairs = pairs.select(F.col("first.file").alias("file_a"), F.col("first.at").alias("at_a"), F.col("first.line").alias("start_a"), F.col("file").alias("file_b"), "at", F.col("line").alias("start_b"))
    w = Window.partitionBy("file_a", "file_b", F.col("at") - F.col("at_a")).orderBy("at")
    island = pairs.withColumn("island", F.col("at") - F.row_number().over(w))
    grouped = island.groupBy("file_a", "file_b", (F.col("at") - F.col("at_a")).alias("apart"), "island").agg(F.min("start_a").alias("start_a"), F.min("start_b").alias("start_b"), (F.count("*") + size - 1).alias("length"))
    return grouped.select("file_a", "start_a", "file_b", "start_b", "length")


def located(issues: DataFrame, file_lines: DataFrame, slack: int = 2, least: float = 0.8) -> DataFrame:
    """issue, line and likeness: where an issue's first snippet line stands, near its stated line or else anywhere in the file.

    issues: issue, file, line, snippet. file_lines: file, line, content. The stated place wins if it is alike enough.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    f = file_lines.select(F.col("file").alias("f_file"), F.col("line").alias("f_line"), plain(F.col("content")).alias("f_content"))
    asked = issues.withColumn("wanted", plain(F.substring_index("snippet", "\n", 1)))
    longest = F.greatest(F.length("wanted"), F.length("f_content"), F.lit(1))
    alike = 1 - F.levenshtein("wanted", "f_content") / longest
    # lengths alone tell that most lines can't be alike enough, before the costly distance
    close = F.least(F.length("wanted"), F.length("f_content")) >= least * longest
    found = asked.join(f, (F.col("file") == F.col("f_file")) & close).withColumn("likeness", alike).where(F.col("likeness") >= least)
    order = F.struct((F.abs(F.col("f_line") - F.col("line")) > slack).alias("far"), (-F.col("likeness")).alias("unlike"), F.col("f_line").alias("line"))
    best = found.groupBy("issue").agg(F.min(order).alias("best"))
    return best.select("issue", F.col("best.line").alias("line"), (-F.col("best.unlike")).alias("likeness"), F.when(F.col("best.far"), "relocated").otherwise("verified").alias("status"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def code_flow(trace: Column) -> Column:
    """SARIF's code flows of a trace (array of file, line, note); null without one."""
    at = lambda s: F.struct(F.struct(F.struct(s["file"].alias("uri")).alias("artifactLocation"), F.struct(s["line"].alias("startLine")).alias("region")).alias("physicalLocation"), F.struct(s["note"].alias("text")).alias("message"))
    steps = F.transform(trace, lambda s: F.struct(at(s).alias("location")))
    return F.when(F.size(trace) > 0, F.array(F.struct(F.array(F.struct(steps.alias("locations"))).alias("threadFlows"))))


def sarif(findings: DataFrame) -> DataFrame:
    """scan_id and document: SARIF 2.1.0 as JSON text, one for each scan; the first finding of a rule describes it.

    findings: scan_id, ord, rule_id, title, severity, file, start, end, fingerprint, and trace (array of file, line, note) if there is one.
    """
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("start").alias("startLine"), F.col("end").alias("endLine")).alias("region")).alias("physicalLocation"))
    flows = [code_flow(F.col("trace")).alias("codeFlows")] if "trace" in findings.columns else []
    result = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"), *flows)
    rules = findings.groupBy("scan_id", "rule_id").agg(F.min_by("title", "ord").alias("title"), F.min("ord").alias("ord"))
    rules = rules.groupBy("scan_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "rule_id", "title"))), lambda r: F.struct(r["rule_id"].alias("id"), F.struct(r["title"].alias("text")).alias("shortDescription"))).alias("rules"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", result.alias("result"))), lambda x, y: F.when(x["ord"] < y["ord"], -1).when(x["ord"] > y["ord"], 1).otherwise(0))
    results = findings.groupBy("scan_id").agg(F.transform(ordered, lambda r: r["result"]).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit("sievegrid").alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return results.join(rules, "scan_id").select("scan_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))

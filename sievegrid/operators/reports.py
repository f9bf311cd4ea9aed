"""What a scan's report says: statistics, grades, risks, steps, coverage and choices of what to look at next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.scrub import clipped, scrub_path, scrub_text
from sievegrid.functions.severity import CONFIDENCES, SEVERITIES, grade, rank_of
from sievegrid.functions.text import basename
from sievegrid.operators.search import top_per

CATEGORIES = ("secret", "sast", "taint", "quality", "dependency", "config")
#: What is said where a category that was looked at has nothing; the last two only if files were reviewed.
CLEAN = {
    "secret": "No hard-coded credentials were found in the code or the scanned git history.", "dependency": "No dependencies with known vulnerabilities were found.",
    "taint": "No untrusted-input-to-sink data flows were found in the reviewed code.", "config": "No insecure configuration was found.",
}


def exploitable(category: Column, confidence: Column, reachability: Column, liveness: Column) -> Column:
    """Whether a finding is known to be of use to an attacker."""
    return F.when(category == "dependency", F.coalesce(reachability == "reachable", F.lit(False))).when(category == "secret", F.coalesce(liveness == "live", F.lit(False))).otherwise(confidence == "high")


def summary_rows(findings: DataFrame, now: Column) -> DataFrame:
    """Findings that a summary counts: neither fixed nor called a false positive by a decision in force."""
    force = F.col("triage").eqNullSafe(F.lit("false_positive")) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return findings.where(~F.col("status").eqNullSafe(F.lit("fixed")) & ~force)


def zero_filled(df: DataFrame, key: str, column: str, domain: tuple[str, ...]) -> DataFrame:
    """key, column and n for each value of the domain, 0 where a key has none."""
    names = F.array(*map(F.lit, domain))
    counts = df.groupBy(key, column).agg(F.count("*").alias("n"))
    every = df.select(key).distinct().withColumn(column, F.explode(names))
    return every.join(counts, [key, column], "left").select(key, column, F.coalesce("n", F.lit(0)).alias("n"))


def grades(findings: DataFrame, key: str) -> DataFrame:
    """key and grade over findings (severity, category, confidence, reachability, liveness) that aren't info."""
    use = exploitable(*(F.col(c) for c in ("category", "confidence", "reachability", "liveness")))
    return findings.groupBy(key).agg(grade(F.col("severity"), use).alias("grade"))


def top_risks(findings: DataFrame, key: str, most: int = 3, cited: int = 10) -> DataFrame:
    """key, place, category, n, severity (the worst) and ids (the riskiest): the categories that hold the riskiest findings.

    findings: key, id, category, severity, risk_score; those of severity info are left out.
    """
    real = findings.where("severity <> 'info'")
    order = [F.desc("risk_score"), F.asc("id")]
    ranked = top_per(real, [key, "category"], order, cited)
    ids = ranked.groupBy(key, "category").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))
    heads = ranked.where("place = 1").select(key, "category", F.col("risk_score").alias("top_score"), F.col("id").alias("top_id"))
    counts = real.groupBy(key, "category").agg(F.count("*").alias("n"), F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.min(rank_of(F.col("severity"))) + 1).cast("int")).alias("severity"))
    placed = top_per(counts.join(heads, [key, "category"]).join(ids, [key, "category"]), [key], [F.desc("top_score"), F.asc("top_id")], most)
    return placed.select(key, "place", "category", "n", "severity", "ids")


def observations(scanned: DataFrame, findings: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """key, category and said for each category of CLEAN that was scanned (key, category) and has no finding. reviewed: key, files."""
    texts = F.create_map(*(F.lit(x) for pair in CLEAN.items() for x in pair))
    empty = scanned.where(F.col("category").isin(*CLEAN)).join(findings.select(key, "category").distinct(), [key, "category"], "left_anti")
    counted = empty.join(reviewed, key, "left").where(F.col("category").isin("secret", "dependency") | (F.coalesce("files", F.lit(0)) > 0))
    return counted.select(key, "category", F.element_at(texts, F.col("category")).alias("said"))


def coverage_report(coverage: DataFrame, key: str) -> DataFrame:
    """key, covered, relevant, percent and skipped ("analyzer: n" by number, then name): what was looked at of what matters.

    coverage: key, analyzer, path, status.
    """
    done = F.col("status").isin("reviewed", "reviewed-fast", "cached")
    sums = coverage.groupBy(key).agg(F.count_if(done).alias("covered"), F.count_if(F.col("status") != "not-relevant").alias("relevant"))
    left_out = coverage.where(F.col("status").startswith("skipped")).groupBy(key, "analyzer").agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "analyzer")))
    said = left_out.groupBy(key).agg(F.array_join(F.transform(order, lambda x: F.concat(x["analyzer"], F.lit(": "), (-x["less"]).cast("string"))), ", ").alias("skipped"))
    percent = F.when(F.col("relevant") > 0, F.round(100 * F.col("covered") / F.col("relevant"), 1)).otherwise(100.0)
    return sums.join(said, key, "left").select(key, "covered", "relevant", percent.alias("percent"), F.coalesce("skipped", F.lit("")).alias("skipped"))


def cache_hit_ratio(read: Column, fresh: Column) -> Column:
    """Share of input tokens that a cache had, to 4 digits; 0 for none."""
    return F.when(read + fresh > 0, F.round(read / (read + fresh), 4)).otherwise(0.0)


def advisory_tally(advisories: DataFrame, key: str) -> DataFrame:
    """key, advisories (different ones), worst (severity) and max_cvss (null where none has a score)."""
    worst = F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.min(rank_of(F.col("severity"))) + 1).cast("int"))
    return advisories.groupBy(key).agg(F.count_distinct("advisory").alias("advisories"), worst.alias("worst"), F.max("cvss").alias("max_cvss"))


def action_packages(resolves: DataFrame, key: str) -> DataFrame:
    """key, package ("name@version") and advisories (sorted) that an action resolves."""
    return resolves.groupBy(key, F.concat_ws("@", "package", "version").alias("package")).agg(F.array_sort(F.collect_set("advisory")).alias("advisories"))


def action_step(package: Column, old: Column, new: Column, kind: Column, jump: Column, command: Column, resolved: Column, breaking: Column) -> Column:
    """struct<title, detail, effort> of a fix action as a step."""
    title = F.when(new.isNotNull(), F.concat(F.lit("Upgrade "), package, F.lit(" "), old, F.lit(" → "), new)).otherwise(F.concat(F.lit("Remove "), package, F.lit(" "), old))
    word = F.when(resolved == 1, "advisory").otherwise("advisories")
    risk = F.when(breaking, "; may include breaking changes, so run your tests").otherwise("")
    detail = F.concat(F.lit("Run `"), command, F.lit("`. Resolves "), resolved.cast("string"), F.lit(" "), word, risk, F.lit("."))
    effort = F.when((kind == "remove") | F.coalesce(jump == "major", F.lit(False)), "hours").otherwise("minutes")
    return F.struct(clipped(title, 160).alias("title"), clipped(detail, 400).alias("detail"), effort.alias("effort"))


def finding_step(category: Column, title: Column, file: Column, line: Column, remedy: Column) -> Column:
    """struct<title, detail, effort> of a finding as a step."""
    verb = F.when(category == "secret", "Rotate and remove: ").otherwise("Fix: ")
    detail = F.concat(file, F.lit(":"), line.cast("string"), F.lit(" — "), scrub_text(remedy, 340))
    return F.struct(clipped(F.concat(verb, scrub_text(title, 150)), 160).alias("title"), clipped(detail, 400).alias("detail"), F.when(category == "dependency", "minutes").otherwise("hours").alias("effort"))


def digest_rows(findings: DataFrame) -> DataFrame:
    """id, category, rule_id, title, severity, risk_score, confidence and file of findings, scrubbed."""
    return findings.select("id", "category", scrub_text(F.col("rule_id"), 120).alias("rule_id"), scrub_text(F.col("title"), 160).alias("title"), "severity", "risk_score", "confidence", scrub_path(F.col("file")).alias("file"))


def valid_references(items: DataFrame, findings: DataFrame, item: str) -> DataFrame:
    """``items`` (item, ids) with only the ids that findings (id, severity) have, each once, and severity: the worst of them. Items left without any go."""
    each = items.select(item, F.posexplode("ids").alias("pos", "id")).groupBy(item, "id").agg(F.min("pos").alias("pos")).join(findings.select("id", "severity"), "id")
    worst = F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.min(rank_of(F.col("severity"))) + 1).cast("int"))
    kept = each.groupBy(item).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"), worst.alias("severity"))
    return items.drop("ids").join(kept, item)


def variation(base: DataFrame, head: DataFrame) -> DataFrame:
    """One row: not_reproduced, only_this_run and both, of the fingerprints of two scans of one commit."""
    sides = base.select("fingerprint", F.lit(1).alias("s")).union(head.select("fingerprint", F.lit(2))).groupBy("fingerprint").agg(F.bit_or("s").alias("s"))
    return sides.agg(F.count_if(F.col("s") == 1).alias("not_reproduced"), F.count_if(F.col("s") == 2).alias("only_this_run"), F.count_if(F.col("s") == 3).alias("both"))


def hunted_files(files: DataFrame, most_bytes: int = 256 * 1024) -> DataFrame:
    """path and tier of files in which credentials are looked for: environment files (0), configuration, CI and infrastructure (1), telling source (2).

    files: path, size, category, tags, skip, risky (whether a review found signs of credentials).
    """
    never = F.col("skip").isin("vendor", "binary", "minified", "symlink", "submodule", "file_limit", "too_large")
    usable = files.where((F.col("category") != "lockfile") & ~F.coalesce(never, F.lit(False)) & (F.col("size") <= most_bytes))
    env = basename(F.col("path")).rlike(r"^\.env($|\.)")
    tier = F.when(env, 0).when((F.col("category") == "config") | F.array_contains("tags", "ci") | F.array_contains("tags", "infra"), 1).when(F.col("risky"), 2)
    return usable.select("path", tier.alias("tier")).where("tier is not null")


def quality_score(long_functions: Column, deep_nesting: Column, lines: Column, todo_density: Column, long_file: int = 500, usual_todos: float = 0.02) -> Column:
    """How much a file's quality is worth a review."""
    zero = F.lit(0.0)
    return long_functions * 10 + deep_nesting * 8 + F.greatest(zero, lines - long_file) / 50 + F.greatest(zero, todo_density - usual_todos)


def risk_order() -> list[Column]:
    """Order in which findings (severity, category, confidence, file, start, id) are reviewed."""
    return [rank_of(F.col("severity")), (F.col("category") != "taint").cast("int"), rank_of(F.col("confidence"), CONFIDENCES), F.col("file"), F.col("start"), F.col("id")]


def worst_first(score: str = "cvss", severity: str = "severity", id_: str = "advisory") -> list[Column]:
    """Order of advisories: severity, then score, then name."""
    return [rank_of(F.col(severity)), F.desc_nulls_last(score), F.col(id_)]


def shared_windows(texts: DataFrame, asked: DataFrame, key: str, asked_key: str, size: int = 8) -> DataFrame:
    """key, asked_key and shared: how many different windows of ``size`` words (letters and digits, lower-case) two texts share.

    Windows at every offset are met by their 64-bit hashes, once for each text, and only those whose words are equal count;
    of ``texts`` only windows that ``asked`` has too are kept, by a semi join, before words are compared. Null texts have none.
    """

    def windows(df: DataFrame, name: str) -> DataFrame:
        found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
        starts = F.when(F.size("w") >= size, F.sequence(F.lit(1), F.size("w") - (size - 1))).otherwise(F.array().cast("array<int>"))
        words = F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(size)), " "))
        return df.select(name, found.alias("w")).select(name, F.explode(F.array_distinct(words)).alias("window")).withColumn("hash", F.xxhash64("window"))

    mine, other = windows(texts, key), windows(asked, asked_key)
    few = mine.join(other.select("hash").distinct(), "hash", "left_semi")
    return few.join(other, ["hash", "window"]).groupBy(key, asked_key).agg(F.count("*").alias("shared"))

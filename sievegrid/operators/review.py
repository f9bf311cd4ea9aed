"""Findings by rules over lines, and findings that carry over to a later scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.text import tags_of

#: A string that is put together from parts, and a plain name that isn't a literal.
_BUILT = r"""(?:(['"])[^'"]*\1\s*[+%]|[fF]['"]|`[^`]*\$\{)"""
_NAME = r"""[A-Za-z_$][\w$.\[\]]*\s*[,)+]"""
_ASKED = r"(?:req|request)\b"
#: What a line does that may be dangerous; the first that fits names the line's rule.
LINE_RULES = (
    ("sast/sql-injection", "high", r"\b(?:query|execute|executemany|raw)\s*\(\s*" + _BUILT),
    ("sast/command-injection", "critical", rf"\b(?:exec|execSync|system|popen|check_output)\s*\(\s*(?:{_BUILT}|{_NAME})"),
    ("sast/code-injection", "high", r"(?<![\w.$])(?:eval|new\s+Function)\s*\(\s*[^\s)'\"]"),
    ("sast/xss", "medium", r"\b(?:inner|outer)HTML\s*\+?=(?!=)|\bdocument\.write(?:ln)?\s*\(|\bdangerouslySetInnerHTML\b"),
    ("sast/open-redirect", "medium", r"\bredirect\s*\(\s*" + _ASKED),
    ("sast/ssrf", "high", r"\b(?:fetch|urlopen|got|(?:axios|requests|httpx)\.\w+)\s*\(\s*" + _ASKED),
    ("sast/unsafe-deserialization", "high", r"\b(?:pickle|dill|marshal)\.loads?\s*\("),
    ("sast/unsafe-yaml", "high", r"\byaml\.load(?:_all)?\s*\((?!.*Safe)"),
    ("sast/weak-crypto", "low", r"""(?i)\bhashlib\.(?:md5|sha1)\b|\bcreateHash\s*\(\s*['"](?:md5|sha1)['"]"""),
)


def rule_hits(file_lines: DataFrame, rules: tuple[tuple[str, str, str], ...] = LINE_RULES, most: int | None = None) -> DataFrame:
    """file, line, rule_id and severity: the first rule that fits each line. With ``most``, only so many of a file, and ``truncated``: whether it has more."""
    kinds = F.array(*(F.when(F.col("content").rlike(p), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, p in rules))
    hit = F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0))
    hits = file_lines.withColumn("_sg_hit", hit).where("_sg_hit is not null").select("file", "line", "_sg_hit.rule_id", "_sg_hit.severity")
    if most is None:
        return hits
    of = Window.partitionBy("file")
    placed = hits.withColumns({"_sg_place": F.row_number().over(of.orderBy("line")), "truncated": F.count("*").over(of) > most})
    return placed.where(F.col("_sg_place") <= most).drop("_sg_place")


def upserted(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` with those of ``changes`` put in the place of rows with the same keys, or added; one row for each key."""
    columns = [c for c in base.columns if c not in keys]
    rows = base.withColumn("_sg_new", F.lit(0)).unionByName(changes.withColumn("_sg_new", F.lit(1)))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_sg_new").alias("_sg_row"))
    return last.select(*keys, *(F.col(f"_sg_row.{c}").alias(c) for c in columns))


def carried(findings: DataFrame, covered: DataFrame, scope: DataFrame, scan: str) -> DataFrame:
    """Findings of files that the base scan covered and that are outside the scope of the new one, under ids of the new scan."""
    kept = findings.join(covered.select("file").distinct(), "file", "left_semi").join(scope.select("file").distinct(), "file", "left_anti")
    return kept.withColumn("id", F.sha2(F.concat(F.lit(scan + ":"), F.col("id").cast("string")), 256))


def overlapping(df: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Rows with ``overlaps``: whether a row that begins no later reaches into them, by the furthest end so far."""
    before = Window.partitionBy(key).orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("overlaps", F.coalesce(F.max(end).over(before) >= F.col(start), F.lit(False)))


#: Signs of a guard near a dangerous call: a check for a path of one's own site (which needs a look at "//" beside it),
#: values bound to placeholders, escaping, and a file's bare name.
GUARDS = (
    r"""(?i)\bstartswith\s*\(\s*(['"`])/\1""",
    r"""(?:\?|\$[1-9]|%s)[^'"`]*['"`]\s*,\s*[\[(]""",
    r"(?i)\b\w*(?:escape|sanitize|quote)\w*\s*\(",
    r"\b(?:basename|secure_filename)\s*\(",
)
BESIDE_FIRST = r"""(['"`])//\1"""


def verdicts(findings: DataFrame, file_lines: DataFrame, above: int = 6, guards: tuple[str, ...] = GUARDS, beside: str = BESIDE_FIRST) -> DataFrame:
    """id, verdict and evidence: refuted where a guard stands in a finding's lines or up to ``above`` lines before them
    (evidence: the first such line), else weakened in test code, else upheld.

    findings: id, file, start, end. file_lines: file, line, content. The first guard counts only if ``beside`` stands near too. Every line near a finding is a key of an equi join.
    """
    near = F.sequence(F.greatest(F.col("start") - above, F.lit(1)), F.greatest("start", "end"))
    asked = findings.select("id", "file", F.explode(near).alias("line")).join(file_lines, ["file", "line"])
    first, *others = guards
    other = F.lit(False)
    for pattern in others:
        other = other | F.col("content").rlike(pattern)
    line_if = lambda c: F.min(F.when(c, F.col("line")))
    seen = asked.groupBy("id").agg(line_if(F.col("content").rlike(first)).alias("path_check"), F.bool_or(F.col("content").rlike(beside)).alias("beside"), line_if(other).alias("guard"))
    rows = findings.select("id", "file").join(seen, "id", "left").withColumn("evidence", F.least("guard", F.when(F.col("beside"), F.col("path_check"))))
    verdict = F.when(F.col("evidence").isNotNull(), "refuted").when(F.array_contains(tags_of(F.col("file")), "test"), "weakened").otherwise("upheld")
    return rows.select("id", verdict.alias("verdict"), "evidence")


def incremental_plan(files: DataFrame, scope: DataFrame, most: float = 0.4) -> DataFrame:
    """One row: files, those in scope, their share, and whether it is over ``most``, so that a full scan is due. No files: no share, a full scan."""
    inside = files.select("file").distinct().join(scope.select("file").distinct().withColumn("_sg_in", F.lit(1)), "file", "left")
    sums = inside.agg(F.count("*").alias("files"), F.count("_sg_in").alias("in_scope"))
    share = F.when(F.col("files") > 0, F.col("in_scope") / F.col("files"))
    return sums.select("files", "in_scope", share.alias("share"), F.coalesce(share > most, F.lit(True)).alias("full"))

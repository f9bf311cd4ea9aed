"""Text, path, version and vector functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python",
    "json": "json", "jsonc": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell", "html": "html", "htm": "html", "css": "css", "scss": "css",
    "md": "markdown", "mdx": "markdown", "xml": "xml",
}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def language_of(path: Column) -> Column:
    base = basename(path)
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.when(base.rlike(r"(?i)^Dockerfile(\..+)?$|\.dockerfile$"), "dockerfile").when(base.rlike(r"^\.env($|\.)"), "env").otherwise(F.coalesce(F.element_at(known, extension(path)), F.lit("other")))


def tags_of(path: Column) -> Column:
    """Sorted subset of ci, example, infra and test."""
    test = path.rlike(r"(?i)(^|/)(tests?|__tests__|__mocks__|spec|fixtures)/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)test_[^/]*\.py$|_test\.py$")
    infra = path.rlike(r"(?i)(^|/)(Dockerfile[^/]*|docker-compose[^/]*\.ya?ml|[^/]+\.tf)$|(^|/)(terraform|k8s|kubernetes|helm|infra)/")
    ci = path.rlike(r"^\.github/workflows/|^\.circleci/|(^|/)\.gitlab-ci\.ya?ml$")
    example = path.rlike(r"(?i)(^|/)(examples?|samples?|demos?)/")
    return F.array_compact(F.array(F.when(ci, "ci"), F.when(example, "example"), F.when(infra, "infra"), F.when(test, "test")))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by NUL; null counts as empty."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def words_of(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits of over one character."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays of distinct ones; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / n
    return F.when(n > 0, -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + share(c) * F.log2(share(c)))).otherwise(0.0)


def redact(value: Column, shown: int = 4) -> Column:
    """The last ``shown`` characters at most, and never over a quarter of the value."""
    tail = F.least(F.lit(shown), F.floor(F.length(value) / 4).cast("int"))
    return F.concat(F.lit("…"), F.when(tail > 0, F.substring(value, F.length(value) - tail + 1, tail)).otherwise(""))


def file_clause(column: Column, spec: str) -> Column:
    """Exact path, everything under ``dir/``, or a pattern with ``*``, in any case."""
    if "*" in spec:
        escaped = spec.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
        return column.ilike(escaped)
    return F.startswith(column, F.lit(spec)) if spec.endswith("/") else column == spec


def within_one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or swap of neighbours apart, and not equal."""
    near = F.levenshtein(a, b, 1).between(0, 1)
    n = F.length(a)
    first = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    swapped = F.concat(F.substring(a, F.lit(1), first - 1), F.substring(a, first + 1, F.lit(1)), F.substring(a, first, F.lit(1)), F.substring(a, first + 2, n))
    return (a != b) & (near | (F.length(b) == n) & F.coalesce(swapped == b, F.lit(False)))


def normalize_pypi(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[-_.]+", "-")


def semver(version: Column) -> Column:
    """Sort key of a semantic version: struct of numbers and prerelease; null where it isn't one.

    A release is greater than its prereleases; numeric identifiers sort by value and before others; build data is ignored.
    """
    pattern = r"^\s*[vV=]*\s*(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$"
    part = lambda i: F.regexp_extract(version, pattern, i)
    ids = F.transform(F.split(part(4), r"\."), lambda x: F.struct(F.when(x.rlike(r"^\d+$"), 0).otherwise(1).alias("kind"), F.when(x.rlike(r"^\d+$"), x.try_cast("decimal(38,0)")).alias("number"), x.alias("text")))
    key = F.struct(*(part(i).try_cast("decimal(38,0)").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))), (part(4) == "").alias("release"), F.when(part(4) != "", ids).alias("pre"))
    return F.when(version.rlike(pattern), key)


def semver_jump(old: Column, new: Column) -> Column:
    """major, minor or patch between two sort keys; below 1.0 a minor step is major."""
    return F.when(old["major"] != new["major"], "major").when(old["minor"] != new["minor"], F.when(old["major"] == 0, "major").otherwise("minor")).otherwise("patch")


#: Weights of the published CVSS 3 base metrics.
_V3 = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62},
    "PR_U": {"N": 0.85, "L": 0.62, "H": 0.27}, "PR_C": {"N": 0.85, "L": 0.68, "H": 0.5}, "CIA": {"H": 0.56, "L": 0.22, "N": 0.0},
}


def cvss3(vector: Column) -> Column:
    """Base score of a CVSS 3.0 or 3.1 vector; null where it is malformed."""
    metrics = F.when(vector.rlike(r"^CVSS:3\.[01]/([A-Za-z]+:[A-Za-z]+/?)+$"), F.str_to_map(vector, F.lit("/"), F.lit(":")))
    table = lambda name: F.create_map(*(F.lit(x) for pair in _V3[name].items() for x in pair))
    weight = lambda name, metric: F.element_at(table(name), F.element_at(metrics, metric))
    scope = F.element_at(metrics, "S")
    changed = scope == "C"
    lost = 1 - (1 - weight("CIA", "C")) * (1 - weight("CIA", "I")) * (1 - weight("CIA", "A"))
    impact = F.when(changed, 7.52 * (lost - 0.029) - 3.25 * F.pow(lost - 0.02, F.lit(15))).otherwise(6.42 * lost)
    ease = 8.22 * weight("AV", "AV") * weight("AC", "AC") * F.when(changed, weight("PR_C", "PR")).otherwise(weight("PR_U", "PR")) * weight("UI", "UI")
    raw = F.least(F.when(changed, 1.08).otherwise(1.0) * (impact + ease), F.lit(10.0))
    scaled = F.floor(raw * 100000 + 0.5)
    up = F.when(scaled % 10000 == 0, scaled / 100000).otherwise((F.floor(scaled / 10000) + 1) / 10)
    return F.when(scope.isin("U", "C") & impact.isNotNull() & ease.isNotNull(), F.when(impact <= 0, 0.0).otherwise(up))


#: Further weights of the approximate CVSS 4 score.
_V4 = {"AT": {"N": 0.85, "P": 0.62}, "UI": {"N": 0.85, "P": 0.62, "A": 0.2}}


def cvss4(vector: Column) -> Column:
    """An approximation of the base score of a CVSS 4.0 vector, by the formula of version 3 and the worse of both systems' impacts; null where it is malformed."""
    metrics = F.when(vector.rlike(r"^CVSS:4\.0/([A-Za-z]+:[A-Za-z]+/?)+$"), F.str_to_map(vector, F.lit("/"), F.lit(":")))
    table = lambda values: F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    weight = lambda values, metric: F.element_at(table(values), F.element_at(metrics, metric))
    lost = lambda system: 1 - (1 - weight(_V3["CIA"], f"{system}C")) * (1 - weight(_V3["CIA"], f"{system}I")) * (1 - weight(_V3["CIA"], f"{system}A"))
    own, next_ = lost("V"), lost("S")
    ease = 8.22 * weight(_V3["AV"], "AV") * weight(_V3["AC"], "AC") * weight(_V4["AT"], "AT") * weight(_V3["PR_U"], "PR") * weight(_V4["UI"], "UI")
    impact = 6.42 * F.greatest(own, next_)
    scaled = F.floor(F.least(impact + ease, F.lit(10.0)) * 100000 + 0.5)
    up = F.when(scaled % 10000 == 0, scaled / 100000).otherwise((F.floor(scaled / 10000) + 1) / 10)
    return F.when(own.isNotNull() & next_.isNotNull() & ease.isNotNull(), F.when(impact <= 0, 0.0).otherwise(up))


def cvss_severity(score: Column) -> Column:
    """Band of a CVSS score."""
    return F.when(score <= 0, "info").when(score < 4, "low").when(score < 7, "medium").when(score < 9, "high").when(score.isNotNull(), "critical")

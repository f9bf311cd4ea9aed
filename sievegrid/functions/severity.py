"""Severities, risk scores and grades as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from worst to least, the score where each begins, and the impact each starts from.
SEVERITIES = ("critical", "high", "medium", "low", "info")
BANDS = {"critical": 85, "high": 65, "medium": 40, "low": 15, "info": 0}
IMPACT = {"critical": 92.0, "high": 75.0, "medium": 52.0, "low": 28.0, "info": 8.0}
#: Scores that findings have until they are scored.
PROVISIONAL = {"critical": 90.0, "high": 70.0, "medium": 50.0, "low": 25.0, "info": 5.0}
CONFIDENCES = ("high", "medium", "low")


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def rank_of(value: Column, order: tuple[str, ...] = SEVERITIES) -> Column:
    """0 for the first name of ``order``; null for a name that isn't in it."""
    return F.element_at(literal_map({name: i for i, name in enumerate(order)}), value)


def severity_from_score(score: Column) -> Column:
    out = F
    for name in SEVERITIES[:-1]:
        out = out.when(score >= BANDS[name], name)
    return out.otherwise("info")


def half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(x + 0.5)


def bump_severity(severity: Column, steps: Column | int, least: str = "low") -> Column:
    """``severity`` lowered by so many steps, not below ``least`` (one below it already stays)."""
    rank = rank_of(severity)
    floor = F.greatest(rank, F.lit(SEVERITIES.index(least)))
    names = F.array(*map(F.lit, SEVERITIES))
    return F.element_at(names, (F.least(rank + steps, floor) + 1).cast("int"))


#: What changes a score, in this order: its name, its factor, the flag that it needs, and one that rules it out.
MULTIPLIERS = (
    ("live_credential", 1.3, "is_live", None), ("revoked_credential", 0.35, "is_revoked", None), ("history_only", 0.75, "is_history_only", "is_live"),
    ("client_exposed", 1.2, "is_client_exposed", None), ("reachable", 1.15, "is_reachable", None), ("transitive_unknown", 0.85, "is_transitive_unknown", None),
    ("unreachable", 0.45, "is_unreachable", None), ("dev_dependency", 0.6, "is_dev", None), ("public_route", 1.2, "is_public_route", None),
    ("entrypoint", 1.1, "is_entrypoint", "is_public_route"), ("non_production_code", 0.4, "is_non_production", None),
    ("generated_code", 0.7, "is_generated", "is_non_production"), ("medium_confidence", 0.9, "is_medium_confidence", None),
    ("low_confidence", 0.7, "is_low_confidence", None), ("ai_unreviewed", 0.95, "is_ai_unreviewed", None),
)
LEAST_VISIBLE = 2


def _steps(flags: dict[str, Column]) -> list[tuple[str, Column]]:
    """Name and factor (1 where it doesn't hold) of each multiplier whose flag is among ``flags``."""
    holds = lambda f: F.coalesce(flags[f], F.lit(False)) if f in flags else F.lit(False)
    return [(name, F.when(holds(flag) & ~holds(unless) if unless else holds(flag), F.lit(m)).otherwise(1.0)) for name, m, flag, unless in MULTIPLIERS if flag in flags]


def _impact(base_severity: Column, cvss: Column) -> Column:
    return F.greatest(F.element_at(literal_map(IMPACT), base_severity), F.coalesce(cvss * 10, F.lit(0.0)))


def risk(base_severity: Column, cvss: Column, flags: dict[str, Column]) -> Column:
    """Score from 0 to 100: the impact times the multipliers whose flag holds, capped at each step. A flat expression."""
    score = _impact(base_severity, cvss)
    for _, factor in _steps(flags):
        score = F.least(F.lit(100.0), score * factor)
    return half_up(score).cast("double")


def risk_factors(base_severity: Column, cvss: Column, flags: dict[str, Column]) -> Column:
    """array<struct<factor, effect>>: what each multiplier changed, if the rounded change is at least LEAST_VISIBLE."""
    steps = F.array(*(F.struct(F.lit(name).alias("factor"), factor.alias("m")) for name, factor in _steps(flags)))
    none = F.array().cast("array<struct<factor:string,effect:double>>")

    def step(acc: Column, x: Column) -> Column:
        after = F.least(F.lit(100.0), acc["score"] * x["m"])
        effect = half_up(after - acc["score"]).cast("double")
        seen = F.when(F.abs(effect) >= LEAST_VISIBLE, F.array(F.struct(x["factor"].alias("factor"), effect.alias("effect")))).otherwise(none)
        return F.struct(after.alias("score"), F.concat(acc["factors"], seen).alias("factors"))

    return F.aggregate(steps, F.struct(_impact(base_severity, cvss).alias("score"), none.alias("factors")), step)["factors"]


def file_context(path: Column) -> Column:
    """test, example, docs, generated or source, by the first that the path fits."""
    dirs = lambda *names: rf"(?i)(^|/)({'|'.join(names)})/"
    test = path.rlike(dirs("test", "__tests__", "fixtures")) | path.rlike(r"(?i)(^|/)(test|__tests__)$|\.(test|spec)\.[^./]+$")
    docs = path.rlike(dirs("docs")) | path.rlike(r"(?i)\.md$")
    return F.when(test, "test").when(path.rlike(dirs("examples?")), "example").when(docs, "docs").when(path.rlike(dirs("vendor")), "generated").otherwise("source")


def risk_flags(finding: Column, factors: Column, entrypoint: Column, public_route: Column) -> dict[str, Column]:
    """The flags of ``risk`` from a finding's fields and the names of its factors.

    finding: struct of file, confidence, liveness, history_only, reachability, scope and direct.
    """
    has = lambda *names: F.arrays_overlap(factors, F.array(*map(F.lit, names)))
    context = file_context(finding["file"])
    return {
        "is_live": finding["liveness"] == "live", "is_revoked": finding["liveness"] == "revoked", "is_history_only": finding["history_only"], "is_client_exposed": has("client_exposed"),
        "is_reachable": finding["reachability"] == "reachable", "is_transitive_unknown": (finding["reachability"] == "unknown") & ~finding["direct"], "is_unreachable": finding["reachability"] == "unreachable",
        "is_dev": finding["scope"] == "dev", "is_public_route": public_route, "is_entrypoint": entrypoint, "is_non_production": context.isin("test", "example", "docs"), "is_generated": context == "generated",
        "is_medium_confidence": finding["confidence"] == "medium", "is_low_confidence": finding["confidence"] == "low", "is_ai_unreviewed": has("ai_unreviewed", "skeptic_unreviewed"),
    }


def guarded(score: Column, malicious: Column, refuted: Column, live: Column) -> Column:
    """The policy on a score, in order: within 0 to 100; malicious at least 85; refuted at most 14 unless malicious or live; live at least 65."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    s = F.when(malicious, F.greatest(s, F.lit(85.0))).otherwise(s)
    s = F.when(refuted & ~malicious & ~live, F.least(s, F.lit(14.0))).otherwise(s)
    return F.when(live, F.greatest(s, F.lit(65.0))).otherwise(s)


def grade(severity: Column, exploitable: Column) -> Column:
    """Aggregate over findings, A to F."""
    critical, high = severity == "critical", severity == "high"
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return F.when(some(critical & exploitable), "F").when(some(critical | (high & exploitable)), "D").when(some(high), "C").when(some(severity == "medium"), "B").otherwise("A")


def worse_grade(a: Column, b: Column) -> Column:
    return F.greatest(a, b)

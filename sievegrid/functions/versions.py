"""Versions and ranges of npm and PyPI as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievegrid.functions.text import semver

_PEP440 = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|rc|c)[-_.]?(\d*))?(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)


def _number(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(text.try_cast("decimal(38,0)"))


def pep440(version: Column) -> Column:
    """Sort key of a PEP 440 version: struct of epoch, release without closing zeros, pre, post, dev and local part; null where it isn't one."""
    part = lambda i: F.regexp_extract(version, _PEP440, i)
    numbers = F.transform(F.split(part(2), r"\."), lambda x: x.try_cast("decimal(38,0)"))
    last = F.coalesce(F.array_max(F.transform(numbers, lambda x, i: F.when(x > 0, i + 1).otherwise(0))), F.lit(0))
    release = F.slice(numbers, F.lit(1), last)
    name, dev = F.lower(part(3)), part(8) != ""
    posted = (part(5) != "") | (part(6) != "")
    phase = F.when(name.isin("a", "alpha"), 0).when(name.isin("b", "beta"), 1).when(name != "", 2).when(dev & ~posted, -1).otherwise(3)
    post = F.when(part(5) != "", _number(part(5))).when(part(6) != "", _number(part(7))).otherwise(-1)
    local = F.transform(F.split(F.lower(part(10)), "[-_.]"), lambda x: F.struct(x.rlike(r"^\d+$").alias("kind"), F.when(x.rlike(r"^\d+$"), x.try_cast("decimal(38,0)")).alias("number"), x.alias("text")))
    key = F.struct(
        _number(part(1)).alias("epoch"), release.alias("release"), phase.alias("phase"), F.when(name != "", _number(part(4))).otherwise(0).alias("pre"),
        post.cast("decimal(38,0)").alias("post"), (~dev).alias("final"), F.when(dev, _number(part(9))).otherwise(0).alias("dev"), F.when(part(10) != "", local).otherwise(F.slice(local, 1, 0)).alias("local"),
    )
    return F.when(version.rlike(_PEP440), key)


def is_valid(ecosystem: Column, version: Column) -> Column:
    return F.coalesce(F.when(ecosystem == "npm", semver(version).isNotNull()).otherwise(pep440(version).isNotNull()), F.lit(False))


def is_stable(ecosystem: Column, version: Column) -> Column:
    """Whether a version is valid and no prerelease."""
    python = pep440(version)
    return F.coalesce(F.when(ecosystem == "npm", semver(version)["release"]).otherwise((python["phase"] == 3) & python["final"]), F.lit(False))


def compare(ecosystem: Column, a: Column, b: Column) -> Column:
    """-1, 0 or 1 as version a is below, at or above b; null if one isn't valid."""
    sign = lambda x, y: F.when(x.isNull() | y.isNull(), None).when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(ecosystem == "npm", sign(semver(a), semver(b))).otherwise(sign(pep440(a), pep440(b)))


_PARTIAL = r"^(\^|~>?|>=|<=|>|<|=)?v?(\d+|[xX*])?(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"


def _bounds(token: Column) -> Column:
    """struct<low, high, above, below, pre, at> of one comparator: keys from low (or above it) to high (or below it)."""
    sign = F.regexp_extract(token, _PARTIAL, 1)
    raw = [F.regexp_extract(token, _PARTIAL, i) for i in (2, 3, 4)]
    pre = F.regexp_extract(token, _PARTIAL, 5)
    major, minor, patch = (F.when(r.rlike(r"^\d+$"), r.cast("long")) for r in raw)
    minor, patch = F.when(major.isNotNull(), minor), F.when(major.isNotNull() & minor.isNotNull(), patch)
    key = lambda *n: semver(F.concat_ws(".", *(F.coalesce(x, F.lit(0)).cast("string") for x in n)))
    at = semver(F.concat(F.concat_ws(".", *(F.coalesce(x, F.lit(0)).cast("string") for x in (major, minor, patch))), F.when((pre != "") & patch.isNotNull(), F.concat(F.lit("-"), pre)).otherwise("")))
    zero = F.lit(0).cast("long")
    after = F.when(major.isNull(), None).when(minor.isNull(), key(major + 1, zero, zero)).when(patch.isNull(), key(major, minor + 1, zero))
    caret = F.when(major.isNull(), None).when((major > 0) | minor.isNull(), key(major + 1, zero, zero)).when((minor > 0) | patch.isNull(), key(zero, minor + 1, zero)).otherwise(key(zero, zero, patch + 1))
    tilde = F.when(minor.isNull(), after).otherwise(key(major, minor + 1, zero))
    whole, any_ = patch.isNotNull(), major.isNull()
    equal = sign.isin("", "=")
    low = F.when(any_, None).when(sign.isin("<", "<="), None).when((sign == ">") & ~whole, after).when(sign == ">", None).otherwise(at)
    above = F.when((sign == ">") & whole, at)
    high = F.when((sign == "<=") & whole, at).when(equal & whole, at)
    below = F.when(sign == "<", at).when((sign == "<=") & ~whole, after).when(equal & ~whole, after).when(sign == "^", caret).when(sign.startswith("~"), tilde)
    none = any_ & sign.isin("<", ">")  # nothing is below or above everything
    return F.when(token.rlike(_PARTIAL), F.struct(low.alias("low"), above.alias("above"), high.alias("high"), F.when(~any_, below).alias("below"), ((pre != "") & whole).alias("pre"), at.alias("at"), none.alias("none")))


def satisfies_npm(version: Column, range_: Column) -> Column:
    """Whether an npm range holds the version; false for what isn't a version or a range.

    A prerelease is held only if a comparator of its set names a prerelease of the same three numbers.
    """
    v = semver(version)
    spread = F.regexp_replace(F.trim(range_), r"(^|\|\|\s*)\s*([^\s|]+)\s+-\s+([^\s|]+)", "$1>=$2 <=$3")
    joined = F.regexp_replace(F.regexp_replace(spread, r"([<>=~^]+)\s+", "$1"), r"\s*\|\|\s*", "||")
    sets = F.transform(F.split(joined, r"\|\|"), lambda s: F.transform(F.split(F.trim(s), r"\s+"), _bounds))
    # an upper bound without prerelease leaves out the prereleases of its own numbers, as they are below it
    inside = lambda b: ~b["none"] & F.coalesce(v >= b["low"], F.lit(True)) & F.coalesce(v > b["above"], F.lit(True)) & F.coalesce(v <= b["high"], F.lit(True)) & F.coalesce(v < b["below"], F.lit(True))
    same = lambda b: b["pre"] & (b["at"]["major"] == v["major"]) & (b["at"]["minor"] == v["minor"]) & (b["at"]["patch"] == v["patch"])
    valid = F.forall(sets, lambda s: F.forall(s, lambda b: b.isNotNull()))
    return F.coalesce(valid & F.exists(sets, lambda s: F.forall(s, inside) & (v["release"] | F.exists(s, same))), F.lit(False))


_SPEC = r"^\s*(===|==|!=|~=|>=|<=|>|<)\s*([^\s,]+?)(\.\*)?\s*$"


def satisfies_pypi(version: Column, range_: Column) -> Column:
    """Whether all comma-separated PEP 440 specifiers hold the version; prereleases only where one of them names a prerelease."""
    v = pep440(version)
    plain = F.struct(*(v[f].alias(f) for f in ("epoch", "release", "phase", "pre", "post", "final", "dev")))

    def holds(spec: Column) -> Column:
        sign, wanted, wild = (F.regexp_extract(spec, _SPEC, i) for i in (1, 2, 3))
        k = pep440(wanted)
        bare = F.struct(*(k[f].alias(f) for f in ("epoch", "release", "phase", "pre", "post", "final", "dev")))
        numbers = F.transform(F.split(F.regexp_extract(wanted, r"^v?(?:\d+!)?(\d+(?:\.\d+)*)", 1), r"\."), lambda x: x.try_cast("decimal(38,0)"))
        padded = F.concat(v["release"], F.transform(F.sequence(F.lit(0), F.lit(15)), lambda _: F.lit(0).cast("decimal(38,0)")))
        begins = lambda n: (v["epoch"] == k["epoch"]) & (F.slice(padded, F.lit(1), n) == F.slice(numbers, F.lit(1), n))
        equal = F.when(wild != "", begins(F.size(numbers))).when(F.size(k["local"]) > 0, v == k).otherwise(plain == bare)
        compatible = (plain >= bare) & begins(F.greatest(F.size(numbers) - 1, F.lit(1)))
        same_release = (v["epoch"] == k["epoch"]) & (v["release"] == k["release"])
        greater = (plain > bare) & ~(same_release & (v["post"] >= 0) & (k["post"] < 0))
        less = (plain < bare) & ~(same_release & (v["phase"] < 3) & (k["phase"] == 3))
        return F.when(sign == "===", F.lower(F.trim(version)) == F.lower(wanted)).when(sign == "==", equal).when(sign == "!=", ~equal).when(sign == "~=", compatible).when(sign == ">=", plain >= bare).when(sign == "<=", plain <= bare).when(sign == ">", greater).when(sign == "<", less)

    specs = F.filter(F.split(range_, ","), lambda s: F.trim(s) != "")
    pre = (v["phase"] < 3) | ~v["final"]
    names_pre = F.exists(specs, lambda s: (pep440(F.regexp_extract(s, _SPEC, 2))["phase"] < 3) & ~F.regexp_extract(s, _SPEC, 1).isin("!=", "<"))
    return F.coalesce(F.forall(specs, lambda s: s.rlike(_SPEC) & holds(s)) & (~pre | names_pre), F.lit(False))


def satisfies(ecosystem: Column, version: Column, range_: Column) -> Column:
    return F.when(ecosystem == "npm", satisfies_npm(version, range_)).otherwise(satisfies_pypi(version, range_))


def version_jump(ecosystem: Column, old: Column, new: Column) -> Column:
    """major, minor or patch between two versions; of npm's versions below 1.0 a minor step is major; null if one isn't valid."""
    number = lambda v, i: F.coalesce(F.get(v["release"], F.lit(i)), F.lit(0).cast("decimal(38,0)"))
    a, b, x, y = semver(old), semver(new), pep440(old), pep440(new)
    npm = F.when(a.isNull() | b.isNull(), None).when(a["major"] != b["major"], "major").when(a["minor"] != b["minor"], F.when(a["major"] == 0, "major").otherwise("minor")).otherwise("patch")
    python = F.when(x.isNull() | y.isNull(), None).when(number(x, 0) != number(y, 0), "major").when(number(x, 1) != number(y, 1), "minor").otherwise("patch")
    return F.when(ecosystem == "npm", npm).otherwise(python)

"""Advisories: OSV records as rows, the versions that they affect, and plans that fix them.

Advisory entries have one row for each advisory and package: advisory, ecosystem, name, ranges (RANGES), versions (null: no
list) and fixed (versions). A range begins at ``introduced`` ("0": from the first), and ends before ``fixed`` or at
``last_affected``, or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.text import basename, cvss3, cvss4, cvss_severity, normalize_pypi, semver
from sievegrid.functions.versions import compare, is_stable, is_valid, pep440, satisfies, version_jump
from sievegrid.sources.scratch import materialize

RANGES = "array<struct<introduced:string,fixed:string,last_affected:string>>"
_EVENT = "struct<introduced:string,fixed:string,last_affected:string,limit:string>"
_AFFECTS = "struct<functions:array<string>>"
OSV = (
    "id string, aliases array<string>, summary string, details string, published string, severity array<struct<type:string,score:string>>, references array<struct<type:string,url:string>>, "
    "database_specific struct<severity:string,cwe_ids:array<string>>, "
    f"affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,ranges:array<struct<type:string,events:array<{_EVENT}>>>,"
    f"ecosystem_specific:struct<imports:array<struct<symbols:array<string>>>,affects:{_AFFECTS}>,database_specific:struct<affects:{_AFFECTS}>>>"
)


def intervals(events: Column) -> Column:
    """RANGES of a range's events, in their order: each ``introduced`` begins one, what follows ends it."""
    one = "struct<introduced:string,fixed:string,last_affected:string>"
    blank = F.lit(None).cast("string")
    start = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("open"))
    made = lambda a, b, c: F.struct(a.alias("introduced"), b.alias("fixed"), c.alias("last_affected"))

    def step(acc: Column, e: Column) -> Column:
        begins = e["introduced"].isNotNull()
        done = F.when(begins & acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        end = F.coalesce(e["fixed"], acc["open"]["fixed"], e["limit"])
        goes_on = made(F.coalesce(acc["open"]["introduced"], F.lit("0")), end, F.coalesce(e["last_affected"], acc["open"]["last_affected"]))
        return F.struct(done.alias("done"), F.when(begins, made(e["introduced"], blank, blank)).otherwise(goes_on).alias("open"))

    return F.aggregate(events, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def severity_of(entries: Column, label: Column) -> Column:
    """struct<severity, cvss, vector>: the highest exact score, else the highest approximate one, else the database's label, else medium."""
    best = lambda kind, score: F.array_max(F.transform(F.filter(entries, lambda e: (e["type"] == kind) & score(e["score"]).isNotNull()), lambda e: F.struct(score(e["score"]).alias("cvss"), e["score"].alias("vector"))))
    top = F.coalesce(best("CVSS_V3", cvss3), best("CVSS_V4", cvss4))
    named = F.lower(label)
    by_label = F.when(named.isin("critical", "high", "low"), named).otherwise("medium")
    return F.struct(F.coalesce(cvss_severity(top["cvss"]), by_label).alias("severity"), top["cvss"].alias("cvss"), top["vector"].alias("vector"))


def package_name(ecosystem: Column, name: Column) -> Column:
    return F.when(ecosystem == "PyPI", normalize_pypi(name)).otherwise(name)


def parsed(records: DataFrame, text: str = "json") -> DataFrame:
    """One row for each record and package: the entry's columns and advisory, aliases, summary, severity, cvss, vector, symbols, cwes, url, malicious.

    Entries of one package in a record are one row. What isn't a record, and records without an id, give no row.
    """
    rows = records.select(F.from_json(text, OSV).alias("r")).where("r.id is not null and r.id <> ''")
    each = rows.select("r", F.explode("r.affected").alias("a")).where("a.package.ecosystem is not null and a.package.name is not null")
    none = F.array().cast("array<string>")
    usable = F.filter(F.coalesce("a.ranges", F.array().cast(f"array<struct<type:string,events:array<{_EVENT}>>>")), lambda x: x["type"].isin("SEMVER", "ECOSYSTEM"))
    everything = F.array(F.struct(F.lit("0").alias("introduced"), F.lit(None).cast("string").alias("fixed"), F.lit(None).cast("string").alias("last_affected"))).cast(RANGES)
    ranges = F.when((F.size(usable) == 0) & F.col("a.versions").isNull(), everything).otherwise(F.flatten(F.transform(usable, lambda x: intervals(x["events"]))))
    fixed = F.array_compact(F.flatten(F.transform(usable, lambda x: x["events"]["fixed"])))
    own = lambda c: F.coalesce(c, none)
    symbols = F.concat(F.flatten(F.coalesce(F.transform("a.ecosystem_specific.imports", lambda i: own(i["symbols"])), F.array().cast("array<array<string>>"))), own(F.col("a.ecosystem_specific.affects.functions")), own(F.col("a.database_specific.affects.functions")))
    eco = F.col("a.package.ecosystem")
    flat = each.select("r", eco.alias("ecosystem"), package_name(eco, F.col("a.package.name")).alias("name"), ranges.alias("ranges"), F.col("a.versions").alias("versions"), fixed.alias("fixed"), symbols.alias("symbols"))
    all_ = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    versions = F.when(F.count("versions") > 0, F.array_distinct(F.flatten(F.collect_list("versions")))).alias("versions")
    merged = flat.groupBy(F.col("r.id").alias("advisory"), "ecosystem", "name").agg(F.first("r").alias("r"), F.flatten(F.collect_list("ranges")).alias("ranges"), versions, all_("fixed"), all_("symbols"))
    url = lambda kind: F.get(F.filter("r.references", lambda x: x["type"] == kind), F.lit(0))["url"]
    scored = merged.withColumn("s", severity_of(F.col("r.severity"), F.col("r.database_specific.severity")))
    return scored.select(
        "advisory", "ecosystem", "name", "ranges", "versions", "fixed", "symbols", own(F.col("r.aliases")).alias("aliases"), F.coalesce("r.summary", F.lit("")).alias("summary"), "s.severity", "s.cvss", "s.vector",
        own(F.col("r.database_specific.cwe_ids")).alias("cwes"), F.coalesce(url("ADVISORY"), url("WEB")).alias("url"), F.startswith("advisory", F.lit("MAL-")).alias("malicious"),
    )


def is_affected(ecosystem: Column, version: Column, ranges: Column, versions: Column) -> Column:
    """Whether a version is affected; null (unknown) where an advisory has neither ranges nor a list. A bound that isn't a version holds nothing."""
    at_least = lambda r: (r["introduced"] == "0") | F.coalesce(compare(ecosystem, version, r["introduced"]) >= 0, F.lit(False))
    before = lambda r: r["fixed"].isNull() | F.coalesce(compare(ecosystem, version, r["fixed"]) < 0, F.lit(False))
    until = lambda r: r["last_affected"].isNull() | F.coalesce(compare(ecosystem, version, r["last_affected"]) <= 0, F.lit(False))
    listed = F.coalesce(F.array_contains(versions, version), F.lit(False))
    none = F.coalesce(F.size(ranges), F.lit(0)) <= 0
    inside = F.exists(ranges, lambda r: at_least(r) & before(r) & until(r))
    return F.when(listed, True).when(none & versions.isNull(), None).when(none, False).otherwise(inside)


def advisories_for(packages: DataFrame, entries: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Rows of ``packages`` (ecosystem, name, version and others) with the columns of the advisories that affect them.

    failed: ecosystem and name of packages that couldn't be asked for; each gets an advisory "unavailable" of medium severity,
    so that no package is taken as clean unseen.
    """
    rows = packages.withColumn("_sg_name", package_name(F.col("ecosystem"), F.col("name")))
    e = entries.withColumnsRenamed({"ecosystem": "_sg_eco", "name": "_sg_package"})
    met = rows.join(e, (F.col("ecosystem") == F.col("_sg_eco")) & (F.col("_sg_name") == F.col("_sg_package")))
    found = met.where(F.coalesce(is_affected(F.col("ecosystem"), F.col("version"), F.col("ranges"), F.col("versions")), F.lit(True)))
    found = found.select(*packages.columns, *(c for c in entries.columns if c not in ("ecosystem", "name")))
    if failed is None:
        return found
    lost = rows.join(failed.select("ecosystem", package_name(F.col("ecosystem"), F.col("name")).alias("_sg_name")).distinct(), ["ecosystem", "_sg_name"], "left_semi")
    blank = {f.name: F.lit(None).cast(f.dataType) for f in entries.schema.fields if f.name not in ("ecosystem", "name")}
    blank |= {"advisory": F.lit("unavailable"), "severity": F.lit("medium"), "malicious": F.lit(False)}
    return found.union(lost.select(*packages.columns, *(blank[c].alias(c) for c in entries.columns if c not in ("ecosystem", "name"))))


def smallest(df: DataFrame, keys: list[str], version: str, out: str, ecosystem: str = "ecosystem") -> DataFrame:
    """keys and the smallest version of each, where all are valid."""
    first = F.when(F.first(ecosystem) == "npm", F.min_by(version, semver(F.col(version)))).otherwise(F.min_by(version, pep440(F.col(version))))
    return df.groupBy(*keys).agg(first.alias(out))


def candidates(vulnerable: DataFrame, advisories: DataFrame, published: DataFrame) -> DataFrame:
    """finding_id, ecosystem, version, candidate and verified: versions above the installed one that may fix it.

    They are the published stable ones (verified), or, for a package that nothing is published of, those that advisories name as fixed.
    """
    v = vulnerable.select("finding_id", "ecosystem", "name", "version")
    known = published.select("ecosystem", "name").distinct()
    stable = published.where(is_stable(F.col("ecosystem"), F.col("published"))).select("ecosystem", "name", F.col("published").alias("candidate")).distinct()
    listed = v.join(stable, ["ecosystem", "name"]).withColumn("verified", F.lit(True))
    named = F.array_distinct(F.concat(F.coalesce("fixed", F.array().cast("array<string>")), F.coalesce(F.array_compact(F.transform("ranges", lambda r: r["fixed"])), F.array().cast("array<string>"))))
    told = v.join(known, ["ecosystem", "name"], "left_anti").join(advisories.select("finding_id", F.explode(named).alias("candidate")), "finding_id").distinct().withColumn("verified", F.lit(False))
    both = listed.unionByName(told)
    eco, version, new = F.col("ecosystem"), F.col("version"), F.col("candidate")
    above = is_valid(eco, new) & (~is_valid(eco, version) | (compare(eco, new, version) > 0))
    return both.where(above).select("finding_id", "ecosystem", "version", "candidate", "verified")


def cleanliness(tried: DataFrame, advisories: DataFrame) -> DataFrame:
    """finding_id, advisory, candidate, verified and clean: whether an advisory leaves a candidate alone.

    An advisory without ranges or versions does if the candidate is at or above its smallest fix above the installed version.
    """
    met = tried.join(advisories.select("finding_id", "advisory", "ranges", "versions", "fixed"), "finding_id")
    eco = F.col("ecosystem")
    hit = is_affected(eco, F.col("candidate"), F.col("ranges"), F.col("versions"))
    reached = F.exists("fixed", lambda f: (~is_valid(eco, F.col("version")) | (compare(eco, f, F.col("version")) > 0)) & (compare(eco, F.col("candidate"), f) >= 0))
    return met.select("finding_id", "ecosystem", "advisory", "candidate", "verified", F.coalesce(~hit, reached, F.lit(False)).alias("clean"))


def safe_upgrades(vulnerable: DataFrame, advisories: DataFrame, published: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables. finding_id, target and verified: the smallest version that all advisories that can be fixed leave alone.
    finding_id, advisory and reason: those that can't be.

    vulnerable: finding_id, ecosystem, name, version. advisories: finding_id, advisory, ranges, versions, fixed, and
    unavailable. published: ecosystem, name, published.
    """
    tried = materialize(cleanliness(candidates(vulnerable, advisories, published), advisories), "tried")
    fixable = tried.where("clean").select("finding_id", "advisory").distinct()
    asked = tried.join(fixable, ["finding_id", "advisory"], "left_semi")
    good = asked.groupBy("finding_id", "ecosystem", "candidate", "verified").agg(F.bool_and("clean").alias("clean")).where("clean")
    target = materialize(smallest(good, ["finding_id", "verified"], "candidate", "target").select("finding_id", "target", "verified"), "targets")
    known = published.select("ecosystem", "name").distinct().withColumn("listed", F.lit(True))
    all_ = advisories.join(vulnerable.select("finding_id", "ecosystem", "name"), "finding_id").join(known, ["ecosystem", "name"], "left")
    state = all_.join(fixable.withColumn("alone", F.lit(True)), ["finding_id", "advisory"], "left").join(target.select("finding_id", F.lit(True).alias("together")), "finding_id", "left")
    ends = (F.coalesce(F.size("fixed"), F.lit(0)) > 0) | F.coalesce(F.exists("ranges", lambda r: r["fixed"].isNotNull() | r["last_affected"].isNotNull()), F.lit(False))
    reason = (
        F.when(F.col("alone") & F.col("together").isNull(), "no single version is outside every affected range").when(F.col("alone"), None)
        .when(F.col("unavailable"), "advisory details unavailable").when(~ends, "no fixed version published")
        .when(F.col("listed"), "no published release outside the affected ranges").otherwise("no fixed version above the installed one")
    )
    return target, state.select("finding_id", "advisory", "unavailable", reason.alias("reason")).where("reason is not null")


def package_manager(ecosystem: Column, lockfile: Column) -> Column:
    base = F.lower(basename(lockfile))
    npm = F.when(base == "pnpm-lock.yaml", "pnpm").when(base == "yarn.lock", "yarn").otherwise("npm")
    python = F.when(base == "poetry.lock", "poetry").when(base == "uv.lock", "uv").when(base.isin("pipfile.lock", "pipfile"), "pipenv").when(base.rlike(r"^requirements.*\.txt$"), "requirements").when(base == "pyproject.toml", "pyproject").otherwise("pip")
    return F.when(ecosystem == "npm", npm).otherwise(python)


#: Commands by manager; {n} is the name, {v} the version, {d} the manager's mark of a development dependency, {f} the file.
_UPGRADE = {
    "npm": "npm install {d}{n}@{v}", "pnpm": "pnpm add {d}{n}@{v}", "yarn": "yarn add {d}{n}@{v}", "poetry": 'poetry add {d}"{n}>={v}"', "uv": 'uv add {d}"{n}>={v}"', "pipenv": 'pipenv install {d}"{n}>={v}"',
    "requirements": "set `{n}=={v}` in {f}", "pyproject": "set `{n}>={v}` in {f}", "pip": 'pip install "{n}>={v}"',
}
_REMOVE = {
    "npm": "npm uninstall {n}", "pnpm": "pnpm remove {n}", "yarn": "yarn remove {n}", "poetry": "poetry remove {n}", "uv": "uv remove {n}", "pipenv": "pipenv uninstall {n}",
    "requirements": "remove `{n}` from {f}", "pyproject": "remove `{n}` from {f}", "pip": "pip uninstall {n}",
}
_REFRESH = {
    "npm": "npm update {n}", "pnpm": "pnpm update {n}", "yarn": "yarn upgrade {n}", "poetry": "poetry update {n}", "uv": "uv lock --upgrade-package {n}", "pipenv": "pipenv update {n}",
    "requirements": "set `{n}=={v}` in {f}", "pyproject": 'pip install --upgrade "{n}>={v}"', "pip": 'pip install --upgrade "{n}>={v}"',
}
_OVERRIDE = {
    "npm": 'add to package.json: "overrides": { "{n}": "{v}" } — then run `npm install`', "yarn": 'add to package.json: "resolutions": { "{n}": "{v}" } — then run `yarn install`',
    "pnpm": 'add to package.json: "pnpm": { "overrides": { "{n}": "{v}" } } — then run `pnpm install`', "poetry": 'poetry add "{n}>={v}"',
    "uv": 'add to pyproject.toml: [tool.uv] constraint-dependencies = ["{n}>={v}"] — then run `uv lock`', "pipenv": 'pipenv install "{n}>={v}"',
    "requirements": "add `{n}>={v}` to {f} (or a constraints file used with `pip install -c`)", "pyproject": "add `{n}>={v}` to the dependencies in {f}",
    "pip": "add `{n}>={v}` to a constraints file and install with `pip install -c constraints.txt`",
}
_DEV = {"npm": "-D ", "pnpm": "-D ", "yarn": "-D ", "poetry": "--group dev ", "uv": "--dev ", "pipenv": "--dev "}


def command(kind: Column, refresh: Column, manager: Column, name: Column, version: Column, dev: Column, lockfile: Column) -> Column:
    """What to run or edit for an action."""
    pick = lambda table: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), manager)
    text = F.when((kind == "remove") | version.isNull(), pick(_REMOVE)).when((kind == "override") & refresh, pick(_REFRESH)).when(kind == "override", pick(_OVERRIDE)).otherwise(pick(_UPGRADE))
    for mark, value in (("{d}", F.when(dev, F.coalesce(pick(_DEV), F.lit(""))).otherwise("")), ("{f}", basename(lockfile)), ("{v}", F.coalesce(version, F.lit(""))), ("{n}", name)):
        text = F.replace(text, F.lit(mark), value)
    return text


def fix_plan(vulnerable: DataFrame, advisories: DataFrame, published: DataFrame, parents: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row for each action: merge_key, id, ecosystem, manifest_dir, kind, package, from, to, dev, refresh, jump, breaking, findings,
    advisories, risk, effort, priority and command; highest priority first is their order.

    vulnerable: scan_id, finding_id, ecosystem, manifest_dir, lockfile, name, version, direct, dev, risk. parents: finding_id,
    parent, parent_version, parent_dev and root (whether the project depends on the parent itself). ranges: ecosystem, parent,
    parent_version, child and range (null: the parent doesn't need the child any more). A direct package is upgraded, or
    removed if nothing fixes it. With one parent that is a root, the parent's smallest stable release from the installed one on
    whose range admits a fix is taken (the installed one: a refresh of the lockfile). With other parents a refresh is enough if
    all their ranges admit it. Else the package is overridden. A range admits a fix if what a fresh resolution takes of it (the
    highest stable release) is clean.
    """
    target, unfixed = (materialize(t, "fixes") for t in safe_upgrades(vulnerable, advisories, published))
    rows = vulnerable.join(target, "finding_id", "left")
    fixed = rows.where("target is not null")
    # which ranges admit a fix
    unfit = unfixed.select("finding_id", "advisory")
    concerned = advisories.join(unfit, ["finding_id", "advisory"], "left_anti")
    asked = fixed.where("not direct").join(parents, "finding_id").join(ranges.withColumnRenamed("child", "name"), ["ecosystem", "parent", "name"]).select("finding_id", "ecosystem", "name", "version", "parent", ranges["parent_version"].alias("release"), "range", "target")
    asked = materialize(asked.distinct(), "ranges_asked")
    stable = published.where(is_stable(F.col("ecosystem"), F.col("published"))).distinct()
    trivial = F.trim("range").isin("", "*")
    listed = asked.join(stable, ["ecosystem", "name"]).where("range is not null").where(trivial | satisfies(F.col("ecosystem"), F.col("published"), F.col("range")))
    top = F.when(F.first("ecosystem") == "npm", F.max_by("published", semver(F.col("published")))).otherwise(F.max_by("published", pep440(F.col("published"))))
    picked = listed.groupBy("finding_id", "ecosystem", "version", "parent", "release").agg(top.alias("candidate")).withColumn("verified", F.lit(True))
    clean = cleanliness(picked.drop("parent", "release").distinct(), concerned).groupBy("finding_id", "candidate").agg(F.bool_and("clean").alias("clean")).where("clean")
    by_release = picked.join(clean.select("finding_id", "candidate"), ["finding_id", "candidate"], "left_semi").select("finding_id", "parent", "release")
    unlisted = asked.join(stable.select("ecosystem", "name").distinct(), ["ecosystem", "name"], "left_anti").where(trivial | satisfies(F.col("ecosystem"), F.col("target"), F.col("range"))).select("finding_id", "parent", "release")
    dropped = asked.where("range is null").select("finding_id", "parent", "release", F.lit(True).alias("dropped"))
    admits = materialize(by_release.union(unlisted).withColumn("dropped", F.lit(False)).union(dropped), "admits")

    many = parents.groupBy("finding_id").agg(F.count("*").alias("parents"), F.bool_and("root").alias("root"), F.first("parent").alias("parent"), F.first("parent_version").alias("parent_version"), F.first("parent_dev").alias("parent_dev"))
    inner = fixed.where("not direct").join(many, "finding_id", "left")
    here = parents.join(admits, ["finding_id", "parent"]).where("parent_version = release").groupBy("finding_id").agg(F.count("*").alias("admitting"))
    lone = inner.where("parents = 1 and root").select("finding_id", "ecosystem", "parent", "parent_version").join(admits, ["finding_id", "parent"])
    eco, release, now = F.col("ecosystem"), F.col("release"), F.col("parent_version")
    onwards = lone.where((release == now) | is_stable(eco, release) & (compare(eco, release, now) > 0))
    step = smallest(onwards, ["finding_id"], "release", "step").join(onwards.select("finding_id", F.col("release").alias("step"), "dropped"), ["finding_id", "step"])
    met = inner.join(here, "finding_id", "left").join(step, "finding_id", "left")
    one = (F.col("parents") == 1) & F.col("root")
    refresh = F.when(one, (F.col("step") == now) & ~F.col("dropped")).otherwise(F.col("admitting") == F.col("parents"))
    refresh = F.coalesce(refresh, F.lit(False))
    upgrade = F.coalesce(one & (F.col("step") != now), F.lit(False))
    common = ["scan_id", "finding_id", "ecosystem", "manifest_dir", "lockfile", "risk"]
    draft = lambda df, kind, package, old, new, dev, again: df.select(*common, kind.alias("kind"), package.alias("package"), old.alias("from"), new.alias("to"), dev.alias("dev"), again.alias("refresh"))
    no = F.lit(False)
    through = draft(met, F.when(upgrade, "upgrade-parent").otherwise("override"), F.when(upgrade, F.col("parent")).otherwise(F.col("name")), F.when(upgrade, now).otherwise(F.col("version")), F.when(upgrade, F.col("step")).otherwise(F.col("target")), F.when(upgrade, F.col("parent_dev")).otherwise(F.col("dev")), refresh)
    direct = draft(fixed.where("direct"), F.lit("upgrade-direct"), F.col("name"), F.col("version"), F.col("target"), F.col("dev"), no)
    hopeless = rows.where("target is null and direct").join(unfixed.where("not unavailable").select("finding_id").distinct(), "finding_id", "left_semi")
    removed = draft(hopeless, F.lit("remove"), F.col("name"), F.col("version"), F.lit(None).cast("string"), F.col("dev"), no)
    drafts = through.union(direct).union(removed)

    manager = package_manager(F.col("ecosystem"), F.col("lockfile"))
    per_file = F.when(manager.isin("requirements", "pyproject"), F.concat(F.lit("|"), "lockfile")).otherwise("")
    drafts = drafts.withColumns({"manager": manager, "merge_key": F.concat(F.concat_ws("|", "ecosystem", "manifest_dir", "kind", "package"), per_file)})
    solved = advisories.select("finding_id", "advisory", "unavailable").join(unfixed.select("finding_id", "advisory", F.lit(True).alias("open")), ["finding_id", "advisory"], "left")
    solved = drafts.select("merge_key", "scan_id", "finding_id", "kind").join(solved, "finding_id").where(F.when(F.col("kind") == "remove", F.col("open") & ~F.col("unavailable")).otherwise(F.col("open").isNull()))
    counted = solved.groupBy("merge_key", "scan_id").agg(F.count_distinct("advisory").alias("advisories"))
    risks = drafts.select("merge_key", "scan_id", "finding_id", "risk").distinct().groupBy("merge_key", "scan_id").agg(F.count("*").alias("findings"), F.sum("risk").alias("risk"))
    lowest, highest = (F.when(F.first("ecosystem") == "npm", by(c, semver(F.col(c)))).otherwise(by(c, pep440(F.col(c)))) for by, c in ((F.min_by, "from"), (F.max_by, "to")))
    merged = drafts.groupBy("merge_key", "scan_id").agg(*(F.first(c).alias(c) for c in ("ecosystem", "manifest_dir", "lockfile", "kind", "package", "manager")), lowest.alias("from"), highest.alias("to"), F.bool_and("dev").alias("dev"), F.bool_and("refresh").alias("refresh"))
    merged = merged.join(risks, ["merge_key", "scan_id"]).join(counted, ["merge_key", "scan_id"], "left").withColumn("jump", version_jump(F.col("ecosystem"), F.col("from"), F.col("to")))
    effort = F.when(F.col("kind") == "remove", 5).when(F.col("kind") == "override", 3).when(F.col("jump") == "major", 5).when(F.col("jump") == "minor", 2).otherwise(1)
    id_ = F.concat(F.lit("fx_"), F.substring(F.sha2(F.concat("scan_id", F.lit("|"), "merge_key"), 256), 1, 20))
    done = merged.withColumns({"effort": effort, "id": id_, "breaking": (F.col("kind") == "remove") | F.coalesce(F.col("jump") == "major", no), "advisories": F.coalesce("advisories", F.lit(0))})
    done = done.withColumns({"priority": F.col("risk") / F.col("effort"), "command": command(F.col("kind"), F.col("refresh"), F.col("manager"), F.col("package"), F.col("to"), F.col("dev"), F.col("lockfile"))})
    return done.select("scan_id", "merge_key", "id", "ecosystem", "manifest_dir", "lockfile", "kind", "package", "from", "to", "dev", "refresh", "jump", "breaking", "findings", "advisories", "risk", "effort", "priority", "command")

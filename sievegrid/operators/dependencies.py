"""Dependency graphs from lockfiles, and signals over them.

Lockfiles are rows (path, text). JSON is read by from_json; TOML and YAML are first rewritten as JSON, file by file.
Nodes: lockfile, key, ecosystem, name, version, dev, source. Edges: lockfile, parent, child.
"""

from __future__ import annotations

import json
import tomllib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.text import basename, normalize_pypi, within_one_edit
from sievegrid.operators.imports import normal_path
from sievegrid.sources.scratch import materialize

#: Lockfiles of the npm family, first wins in a folder.
NPM_ORDER = ("npm-shrinkwrap.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock")
_PACKAGE = "struct<version:string,resolved:string,dev:boolean,link:boolean,hasInstallScript:boolean,dependencies:map<string,string>,optionalDependencies:map<string,string>,peerDependencies:map<string,string>>"


def discovered(files: DataFrame) -> DataFrame:
    """path and kind of the lockfiles to read: one of the npm family for each folder, and every Python one."""
    base = basename(F.col("path"))
    rows = files.select("path", F.regexp_extract("path", "^(.*/)?[^/]*$", 1).alias("folder"), base.alias("kind"))
    npm = F.array_position(F.array(*map(F.lit, NPM_ORDER)), F.col("kind"))
    first = rows.where(npm > 0).withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy(npm, "path"))).where("place = 1").select("path", "kind")
    python = rows.where(F.col("kind").isin("poetry.lock", "uv.lock", "Pipfile.lock")).select("path", "kind")
    pins = rows.where(F.col("kind").rlike(r"(?i)^requirements.*\.txt$")).select("path", F.lit("requirements").alias("kind"))
    return first.union(python).union(pins)


def npm_packages(files: DataFrame) -> DataFrame:
    """Nodes of npm lockfiles of version 2 and 3, keyed by their place in node_modules."""
    parsed = files.select("path", F.from_json("text", f"packages map<string,{_PACKAGE}>").alias("doc"))
    rows = parsed.select(F.col("path").alias("lockfile"), F.explode("doc.packages").alias("key", "p"))
    name = F.regexp_extract("key", "(?:^|.*/)node_modules/((?:@[^/]+/)?[^/]+)$", 1)
    needs = F.map_concat(*(F.coalesce(f"p.{m}", F.create_map().cast("map<string,string>")) for m in ("dependencies",)))
    other = F.concat(F.map_keys(needs), *(F.coalesce(F.map_keys(f"p.{m}"), F.array().cast("array<string>")) for m in ("optionalDependencies", "peerDependencies")))
    nodes = rows.select("lockfile", "key", F.lit("npm").alias("ecosystem"), name.alias("name"), F.col("p.version").alias("version"), F.coalesce("p.dev", F.lit(False)).alias("dev"), F.col("p.resolved").alias("source"), F.coalesce("p.hasInstallScript", F.lit(False)).alias("has_install_script"), F.array_distinct(other).alias("needs"))
    return nodes


def npm_edges(nodes: DataFrame) -> DataFrame:
    """Each need resolved as Node does: the nearest folder up from the package that has it.

    Every folder on the way up is a candidate; candidates are joined with the keys there are, and the deepest wins.
    """
    wanted = nodes.select("lockfile", F.col("key").alias("parent"), F.explode("needs").alias("need"))
    parts = F.split("parent", "/")
    ups = F.when(F.col("parent") == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))), F.array(F.lit(""))))
    tried = wanted.select("lockfile", "parent", "need", F.posexplode(ups).alias("up", "at")).where(~F.col("at").rlike("node_modules/$"))
    tried = tried.withColumn("key", F.concat("at", F.lit("node_modules/"), "need"))
    found = tried.join(nodes.select("lockfile", "key"), ["lockfile", "key"])
    return found.groupBy("lockfile", "parent", "need").agg(F.min_by("key", "up").alias("child")).select("lockfile", "parent", "child")


def requirements(files: DataFrame) -> DataFrame:
    """Pins of requirements files: lockfile, key, ecosystem, name, version (null without ==), dev by the file's name."""
    joined = F.regexp_replace("text", r"\\\r?\n", " ")
    rows = files.select(F.col("path").alias("lockfile"), F.explode(F.split(joined, r"\r?\n")).alias("line"))
    plain = F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    pattern = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:(===?)\s*([^;\s,]+))?"
    pins = rows.withColumn("plain", plain).where(F.col("plain").rlike("^[A-Za-z0-9]") & ~F.col("plain").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    name = normalize_pypi(F.regexp_extract("plain", pattern, 1))
    version = F.nullif(F.regexp_extract("plain", pattern, 3), F.lit(""))
    return pins.select("lockfile", name.alias("key"), F.lit("PyPI").alias("ecosystem"), name.alias("name"), version.alias("version"), F.lower(basename(F.col("lockfile"))).rlike("dev|test").alias("dev")).dropDuplicates(["lockfile", "key"])


def _toml_as_json(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return json.dumps(tomllib.loads(t or ""), default=str)
        except tomllib.TOMLDecodeError:
            return None

    return text.map(one)


def python_locks(files: DataFrame) -> DataFrame:
    """Packages of poetry.lock and uv.lock with what they need; a need named python is skipped; a broken file gives none."""
    as_json = F.pandas_udf(_toml_as_json, "string")(F.col("text"))
    parsed = files.select("path", F.from_json(as_json, "package array<struct<name:string,version:string,dependencies:string>>").alias("doc"))
    rows = parsed.select(F.col("path").alias("lockfile"), F.explode("doc.package").alias("p"))
    # poetry maps names to ranges, uv lists structs with a name
    mapped, listed = F.map_keys(F.from_json("p.dependencies", "map<string,string>")), F.transform(F.from_json("p.dependencies", "array<struct<name:string>>"), lambda d: d["name"])
    needs = F.transform(F.coalesce(F.when(F.startswith("p.dependencies", F.lit("[")), listed).otherwise(mapped), F.array().cast("array<string>")), normalize_pypi)
    name = normalize_pypi(F.col("p.name"))
    return rows.select("lockfile", name.alias("key"), F.lit("PyPI").alias("ecosystem"), name.alias("name"), F.col("p.version").alias("version"), F.filter(needs, lambda n: n != "python").alias("needs"))


def nested_npm_packages(files: DataFrame) -> DataFrame:
    """Nodes of npm lockfiles of version 1, keyed as those of later ones; a broken file, or one with packages, gives none."""

    def flat(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            try:
                doc = json.loads(t or "")
            except ValueError:
                return []
            if not isinstance(doc, dict) or "packages" in doc:
                return []
            out, open_ = [], [("", doc)]
            while open_:
                at, node = open_.pop()
                for name, child in (node.get("dependencies") or {}).items():
                    if isinstance(child, dict):
                        key = f"{at}/node_modules/{name}".lstrip("/")
                        out.append({"key": key, "name": name, "version": child.get("version"), "dev": bool(child.get("dev")), "source": child.get("resolved"), "needs": sorted(child.get("requires") or {})})
                        open_.append((key, child))
            return out

        return text.map(one)

    kind = "array<struct<key:string,name:string,version:string,dev:boolean,source:string,needs:array<string>>>"
    rows = files.select(F.col("path").alias("lockfile"), F.explode(F.pandas_udf(flat, kind)(F.col("text"))).alias("p"))
    return rows.select("lockfile", "p.key", F.lit("npm").alias("ecosystem"), "p.name", "p.version", "p.dev", "p.source", F.lit(False).alias("has_install_script"), "p.needs")


def manifest_direct(files: DataFrame) -> DataFrame:
    """path, name, range and scope (prod, dev, optional or peer) of what package.json files declare; broken files give none."""
    group = "map<string,string>"
    doc = files.select("path", F.from_json("text", f"dependencies {group}, devDependencies {group}, optionalDependencies {group}, peerDependencies {group}").alias("d"))
    scopes = {"dependencies": "prod", "devDependencies": "dev", "optionalDependencies": "optional", "peerDependencies": "peer"}
    groups = F.array(*(F.struct(F.lit(scope).alias("scope"), F.col(f"d.{name}").alias("deps")) for name, scope in scopes.items()))
    each = doc.select("path", F.explode(groups).alias("g")).where("g.deps is not null")
    return each.select("path", F.col("g.scope").alias("scope"), F.explode("g.deps").alias("name", "range")).select("path", "name", "range", "scope")


def requirement(entry: Column) -> Column:
    """struct<name, extras, range, marker> of a PEP 508 entry, with the name normal; null where it isn't one."""
    pattern = r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[([^\]]*)\])?\s*\(?((?:\s*(?:===|==|~=|!=|>=|<=|>|<)\s*[^\s,;()]+\s*,?)*)\)?\s*(?:;\s*(.*))?$"
    part = lambda i: F.regexp_extract(entry, pattern, i)
    return F.when(entry.rlike(pattern), F.struct(normalize_pypi(part(1)).alias("name"), F.nullif(F.trim(part(2)), F.lit("")).alias("extras"), F.regexp_replace(part(3), r"\s+|,\s*$", "").alias("range"), F.nullif(F.trim(part(4)), F.lit("")).alias("marker")))


def pyproject_direct(files: DataFrame) -> DataFrame:
    """path, name, range and scope of what pyproject.toml files declare, by the standard's fields and by poetry's; broken files give none."""
    listed, mapped = "array<string>", "map<string,string>"
    schema = f"project struct<dependencies:{listed},`optional-dependencies`:map<string,{listed}>>, `dependency-groups` map<string,{listed}>, tool struct<poetry:struct<dependencies:{mapped},`dev-dependencies`:{mapped},`group`:map<string,struct<dependencies:{mapped}>>>>"
    doc = files.select("path", F.from_json(F.pandas_udf(_toml_as_json, "string")(F.col("text")), schema).alias("d"))
    no_list, no_map = F.array().cast(listed), F.create_map().cast(mapped)
    entries = lambda groups: F.flatten(F.transform(F.coalesce(F.map_values(groups), F.array().cast(f"array<{listed}>")), lambda g: F.coalesce(g, no_list)))
    asked = lambda c, scope: F.transform(F.coalesce(c, no_list), lambda e: F.struct(requirement(e)["name"].alias("name"), requirement(e)["range"].alias("range"), F.lit(scope).alias("scope")))
    ranges = lambda m, scope: F.transform(F.map_entries(F.coalesce(m, no_map)), lambda e: F.struct(normalize_pypi(e["key"]).alias("name"), F.coalesce(F.get_json_object(e["value"], "$.version"), e["value"]).alias("range"), F.lit(scope).alias("scope")))
    of_groups = F.flatten(F.transform(F.coalesce(F.map_values("d.tool.poetry.group"), F.array().cast(f"array<struct<dependencies:{mapped}>>")), lambda g: ranges(g["dependencies"], "dev")))
    all_ = F.concat(
        asked(F.col("d.project.dependencies"), "prod"), asked(entries(F.col("d.project.`optional-dependencies`")), "optional"), asked(entries(F.col("d.`dependency-groups`")), "dev"),
        ranges(F.col("d.tool.poetry.dependencies"), "prod"), ranges(F.col("d.tool.poetry.`dev-dependencies`"), "dev"), of_groups,
    )
    return doc.select("path", F.explode(all_).alias("r")).where("r.name is not null and r.name <> 'python'").select("path", "r.name", "r.range", "r.scope").distinct()


def included(files: DataFrame) -> DataFrame:
    """path and file of the requirements files that each one includes (-r or --requirement), itself and those of included ones too; cycles end."""
    link = r"^\s*(?:-r|--requirement)[\s=]\s*(\S+)"
    lines = files.select("path", F.explode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line")).where(F.col("line").rlike(link))
    to = normal_path(F.concat(F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.regexp_extract("line", link, 1)))
    links = lines.select(F.col("path").alias("src"), to.alias("dst")).join(files.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    seen = materialize(files.select("path", F.col("path").alias("file")).distinct(), "included")
    parts, new = [seen], seen
    while True:
        step = new.join(links, F.col("file") == F.col("src")).select("path", F.col("dst").alias("file")).distinct()
        new = materialize(step.join(reduce(DataFrame.union, parts), ["path", "file"], "left_anti"), "included")
        if new.isEmpty():
            return reduce(DataFrame.union, parts)
        parts.append(new)


def requirements_with_includes(files: DataFrame) -> DataFrame:
    """Pins of requirements files as ``requirements`` gives them, with those of included files under each file that includes them."""
    pins = requirements(files).withColumnRenamed("lockfile", "file")
    met = included(files).join(pins, "file").withColumn("lockfile", F.col("path"))
    dev = F.lower(basename(F.col("lockfile"))).rlike("dev|test")
    return met.select("lockfile", "key", "ecosystem", "name", "version", dev.alias("dev")).dropDuplicates(["lockfile", "key"])


def pipfile_lock(files: DataFrame) -> DataFrame:
    """Pins of Pipfile.lock; the section says whether they are for development."""
    section = "map<string,struct<version:string>>"
    doc = files.select(F.col("path").alias("lockfile"), F.from_json("text", f"default {section}, develop {section}").alias("d"))
    rows = doc.select("lockfile", F.explode(F.array(F.struct(F.lit(False).alias("dev"), F.col("d.default").alias("pins")), F.struct(F.lit(True).alias("dev"), F.col("d.develop").alias("pins")))).alias("s"))
    pins = rows.select("lockfile", "s.dev", F.explode("s.pins").alias("raw", "p"))
    name = normalize_pypi(F.col("raw"))
    return pins.select("lockfile", name.alias("key"), F.lit("PyPI").alias("ecosystem"), name.alias("name"), F.regexp_replace("p.version", "^==", "").alias("version"), "dev")


def named_edges(nodes: DataFrame) -> DataFrame:
    """Edges where a need is a name and a lockfile has one version of it."""
    wanted = nodes.select("lockfile", F.col("key").alias("parent"), F.explode("needs").alias("child"))
    return wanted.join(nodes.select("lockfile", F.col("key").alias("child")), ["lockfile", "child"]).select("lockfile", "parent", "child")


def source_host(source: Column) -> Column:
    """Host of a url, of git@host:path, or of a forge shorthand; null for a plain version."""
    url = F.regexp_extract(source, r"^(?:git\+)?[a-z+]+://(?:[^/@]*@)?([^/:?#]+)", 1)
    scp = F.regexp_extract(source, r"^(?:[^@/\s]+@)([^:/\s]+):", 1)
    short = F.when(source.rlike(r"^(github:)?[\w.-]+/[\w.-]+(#.*)?$"), "github.com").when(source.rlike("^gitlab:"), "gitlab.com").when(source.rlike("^bitbucket:"), "bitbucket.org")
    return F.coalesce(F.nullif(F.lower(url), F.lit("")), F.nullif(F.lower(scp), F.lit("")), short)


def typosquats(names: DataFrame, popular: DataFrame, distinct_names: DataFrame) -> DataFrame:
    """name and target: names one edit from a popular one, or equal but for separators, and neither popular nor known to be distinct.

    Candidates share a key: a string with one character left out, or the name without separators. So the join is an
    equi join on deletion neighbourhoods and not a cross join.
    """
    bare = lambda c: F.regexp_replace(c, "[-_.]", "")

    def keys(c: Column) -> Column:
        left_out = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return F.array_distinct(F.concat(F.array(c, F.concat(F.lit("="), bare(c))), left_out))

    asked = names.select("name").distinct().join(popular.select("name"), "name", "left_anti").join(distinct_names.select("name"), "name", "left_anti").where("name <> ''")
    asked = asked.select("name", F.explode(keys(F.col("name"))).alias("key"))
    known = popular.select(F.col("name").alias("target"), F.explode(keys(F.col("name"))).alias("key"))
    near = within_one_edit(F.col("name"), F.col("target")) | ((bare(F.col("name")) == bare(F.col("target"))) & (F.col("name") != F.col("target")))
    return asked.join(known, "key").where(near).groupBy("name").agg(F.min("target").alias("target"))


def host_signals(nodes: DataFrame, registries: list[str], most: int = 8) -> DataFrame:
    """One row for each host outside the registries: how many packages come from it, and the first few names."""
    outside = nodes.withColumn("host", source_host(F.col("source"))).where(F.col("host").isNotNull() & ~F.col("host").isin(*registries))
    firsts = outside.select("host", "name").distinct().withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("name")))
    return firsts.groupBy("host").agg(F.count("*").alias("packages"), F.sort_array(F.collect_list(F.when(F.col("place") <= most, F.col("name")))).alias("names"))


def safe_upgrade(current: DataFrame, versions: DataFrame, affected: DataFrame) -> DataFrame:
    """package and next: the smallest version above the current one that no advisory affects.

    current: package, key. versions: package, version, key. affected: package, version.
    """
    clean = versions.join(affected.select("package", "version").distinct(), ["package", "version"], "left_anti")
    above = clean.join(current.select("package", F.col("key").alias("now")), "package").where(F.col("key") > F.col("now"))
    return above.groupBy("package").agg(F.min_by("version", "key").alias("next"))


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """Package URL."""
    kind = F.when(ecosystem == "PyPI", "pypi").otherwise(F.lower(ecosystem))
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), F.replace(name, F.lit("@"), F.lit("%40")), F.lit("@"), F.replace(F.url_encode(version), F.lit("+"), F.lit("%20")))


def vex_analysis(triage: Column, reachability: Column) -> Column:
    """struct<state, justification> of a vulnerability: by a decision in force, then by how it is reached."""
    state = F.when(triage == "false_positive", "false_positive").when(triage == "accepted", "exploitable").when(reachability == "reachable", "exploitable").when(reachability == "unreachable", "not_affected").otherwise("in_triage")
    return F.struct(state.alias("state"), F.when(state == "not_affected", "code_not_reachable").alias("justification"))


def rating(severity: Column, cvss: Column, vector: Column) -> Column:
    """struct<severity, score, method, vector>; score, method and vector only for an exact vector of CVSS 3.1."""
    exact = F.coalesce(vector.startswith("CVSS:3.1/"), F.lit(False)) & cvss.isNotNull()
    return F.struct(severity.alias("severity"), F.when(exact, cvss).alias("score"), F.when(exact, "CVSSv31").alias("method"), F.when(exact, vector).alias("vector"))


def cyclonedx(nodes: DataFrame, advisories: DataFrame) -> DataFrame:
    """lockfile and document: CycloneDX components and vulnerabilities as JSON text, one for each lockfile.

    advisories: lockfile, advisory, key, severity, and if there are such columns cvss and vector, triage and reachability. A
    vulnerability lists each affected component once; the first analysis by key counts.
    """
    has = lambda c, kind: F.col(c) if c in advisories.columns else F.lit(None).cast(kind)
    rows = advisories.select("lockfile", "advisory", "key", rating(F.col("severity"), has("cvss", "double"), has("vector", "string")).alias("rating"), vex_analysis(has("triage", "string"), has("reachability", "string")).alias("analysis"))
    parts = nodes.select("lockfile", "key", F.struct(purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("bom-ref"), F.lit("library").alias("type"), "name", "version").alias("c"))
    refs = rows.join(parts, ["lockfile", "key"]).groupBy("lockfile", "advisory").agg(F.min_by("rating", "key").alias("rating"), F.min_by("analysis", "key").alias("analysis"), F.sort_array(F.collect_set("c.bom-ref")).alias("refs"))
    vulnerable = F.struct(F.col("advisory").alias("id"), F.array("rating").alias("ratings"), "analysis", F.transform("refs", lambda r: F.struct(r.alias("ref"))).alias("affects"))
    vulns = refs.groupBy("lockfile").agg(F.sort_array(F.collect_list(vulnerable)).alias("vulnerabilities"))
    comps = parts.groupBy("lockfile").agg(F.sort_array(F.collect_set("c")).alias("components"))
    doc = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), "components", F.coalesce("vulnerabilities", F.array().cast(vulns.schema["vulnerabilities"].dataType)).alias("vulnerabilities")))
    return comps.join(vulns, "lockfile", "left").select("lockfile", doc.alias("document"))


def yarn_packages(files: DataFrame) -> DataFrame:
    """Nodes of yarn.lock files: key (name@version), name, version, source, specs (what asks for it) and needs (specs).

    Blocks are parted by empty lines; both forms of the file name the version and dependencies by indented lines.
    """
    blocks = files.select(F.col("path").alias("lockfile"), F.explode(F.split(F.coalesce("text", F.lit("")), r"\r?\n(?:[ \t]*\r?\n)+")).alias("block"))
    head = F.regexp_extract("block", r"(?m)^([^\s#][^\n]*):[ \t]*\r?$", 1)
    spec = lambda s: F.regexp_replace(F.trim(F.replace(s, F.lit('"'), F.lit(""))), r"(?<=.)@npm:", "@")
    rows = blocks.withColumn("specs", F.transform(F.split(head, r"\s*,\s*"), spec)).withColumn("version", F.regexp_extract("block", r'(?m)^  "?version"?:?\s+"?([^"\s]+)"?', 1))
    name = F.regexp_extract(F.get("specs", F.lit(0)), "^(@?[^@]+)@", 1)
    section = F.regexp_extract("block", r"(?m)^  dependencies:[ \t]*\r?\n((?:    [^\n]*(?:\n|$))+)", 1)
    one = r'(?m)^    "?(@?[^"\s:]+)"?:?\s+"?([^"\r\n]+?)"?[ \t]*\r?$'
    names, ranges = F.regexp_extract_all(section, F.lit(one), F.lit(1)), F.regexp_extract_all(section, F.lit(one), F.lit(2))
    needs = F.zip_with(names, ranges, lambda n, r: F.concat(n, F.lit("@"), F.regexp_replace(r, "^npm:", "")))
    source = F.nullif(F.regexp_extract("block", r'(?m)^  "?(?:resolved|resolution)"?:?\s+"?([^"\s]+)"?', 1), F.lit(""))
    real = rows.where((F.col("version") != "") & (name != "") & (F.col("version") != "0.0.0-use.local"))
    return real.select("lockfile", F.concat(name, F.lit("@"), "version").alias("key"), F.lit("npm").alias("ecosystem"), name.alias("name"), "version", source.alias("source"), "specs", needs.alias("needs"))


def yarn_edges(nodes: DataFrame) -> DataFrame:
    """lockfile, parent and child: each need joined with the node that lists it among its specs."""
    wanted = nodes.select("lockfile", F.col("key").alias("parent"), F.explode("needs").alias("spec"))
    return wanted.join(nodes.select("lockfile", F.col("key").alias("child"), F.explode("specs").alias("spec")), ["lockfile", "spec"]).select("lockfile", "parent", "child").distinct()


def pnpm_packages(files: DataFrame) -> DataFrame:
    """Nodes of pnpm-lock.yaml files: key (name@version), name, version, dev and needs (keys), from packages and snapshots.

    Blocks are told by their indentation; what follows a version in brackets (peers) is left out, so a package that is
    there with several peers is one node that needs what each of them needs.
    """
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"\r?\n(?=\S)"), lambda s: s.rlike(r"^(packages|snapshots):"))
    blocks = files.select(F.col("path").alias("lockfile"), F.explode(F.flatten(F.transform(parts, lambda s: F.split(s, r"\r?\n(?=  \S)")))).alias("block"))
    head = F.regexp_extract("block", r"^  ['\"]?/?([^'\"\n]+?)['\"]?:[ \t]*(?:\{\})?[ \t]*(?:\r?\n|$)", 1)
    bare = lambda s: F.regexp_extract(s, r"^(@?[^@(]+@[^@(]+)", 1)
    section = F.concat(*(F.regexp_extract("block", rf"(?m)^    {s}:[ \t]*\r?\n((?:      [^\n]*(?:\n|$))+)", 1) for s in ("dependencies", "optionalDependencies")))
    one = r"(?m)^      ['\"]?(@?[^'\":\s]+)['\"]?:\s+['\"]?/?([^'\"\s]+)['\"]?"
    names, versions = F.regexp_extract_all(section, F.lit(one), F.lit(1)), F.regexp_extract_all(section, F.lit(one), F.lit(2))
    # an alias names the package that it stands for
    needs = F.zip_with(names, versions, lambda n, v: F.when(F.regexp_replace(v, r"\(.*$", "").rlike(".@"), bare(v)).otherwise(bare(F.concat(n, F.lit("@"), v))))
    rows = blocks.select("lockfile", bare(head).alias("key"), F.col("block").rlike(r"(?m)^    dev: true[ \t]*\r?$").alias("dev"), needs.alias("needs")).where("key <> ''")
    nodes = rows.groupBy("lockfile", "key").agg(F.bool_or("dev").alias("dev"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("needs")))).alias("needs"))
    cut = r"^(@?[^@]+)@(.+)$"
    return nodes.select("lockfile", "key", F.lit("npm").alias("ecosystem"), F.regexp_extract("key", cut, 1).alias("name"), F.regexp_extract("key", cut, 2).alias("version"), "dev", "needs")


def pnpm_edges(nodes: DataFrame) -> DataFrame:
    """lockfile, parent and child; needs that no node has (links to folders) give none."""
    wanted = nodes.select("lockfile", F.col("key").alias("parent"), F.explode("needs").alias("child"))
    return wanted.join(nodes.select("lockfile", F.col("key").alias("child")), ["lockfile", "child"]).select("lockfile", "parent", "child")

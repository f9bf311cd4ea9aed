"""Imports of source files: extraction, resolution to files, and owning packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modules of the runtime, and what may follow an import's path, first wins.
BUILTINS = (
    "assert", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks",
    "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def js_imports(file_lines: DataFrame) -> DataFrame:
    """file, line and spec of static imports, re-exports, require() and import(); lines that are comments are skipped.

    file_lines: file, line, content.
    """
    code = file_lines.where(~F.col("content").rlike(r"^\s*(//|\*|/\*)"))
    pattern = r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)['"]([^'"\n]+)['"]"""
    return code.select("file", "line", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("spec"))


def py_imports(file_lines: DataFrame) -> DataFrame:
    """file, line and spec (dotted, with leading dots where relative) of Python imports that begin on a line."""
    named = F.regexp_extract("content", r"^\s*from\s+(\.*[\w.]*)\s+import\b", 1)
    listed = F.regexp_extract("content", r"^\s*import\s+([\w., ]+?)\s*(?:#.*|;.*)?$", 1)
    plain = F.transform(F.split(listed, r"\s*,\s*"), lambda x: F.regexp_extract(x, r"^\s*([\w.]+)", 1))
    specs = F.filter(F.concat(F.array(named), plain), lambda x: x != "")
    return file_lines.select("file", "line", F.explode(specs).alias("spec"))


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and target of each different link of a page to a path of its own site."""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('<a href="(/[^"]*)"'), F.lit(1))).alias("target")).distinct()


def normal_path(path: Column) -> Column:
    """Path without ``.`` and ``..``; null if it leaves the root."""
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(x.isin("", "."), acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file, line, spec and target of relative imports: the first ending that gives a known file.

    Candidates are joined with the files, so no import is looked up one by one.
    """
    base = normal_path(F.concat(F.regexp_extract("file", "^(.*/)?[^/]*$", 1), "spec"))
    asked = imports.where(F.col("spec").startswith(".")).withColumn("base", base).where("base is not null")
    tried = asked.select("file", "line", "spec", "base", F.posexplode(F.array(*map(F.lit, ENDINGS))).alias("place", "ending"))
    tried = tried.withColumn("path", F.concat("base", "ending"))
    return tried.join(files.select("path"), "path").groupBy("file", "line", "spec").agg(F.min_by("path", "place").alias("target"))


#: Strings (group 1) and comments of a script.
_STRING_OR_COMMENT = r"""(?s)("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?(?:\*/|\z)"""


def without_js_comments(text: Column) -> Column:
    """Text of a script without comments; line ends inside them stay, so that lines keep their numbers, and so do strings."""
    found = F.regexp_extract_all(text, F.lit(_STRING_OR_COMMENT), F.lit(0))
    between = F.split(F.regexp_replace(text, _STRING_OR_COMMENT, "\0"), "\0", -1)
    ends = lambda c: F.repeat(F.lit("\n"), F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))))
    kept = F.transform(found, lambda c: F.when(c.rlike("^[\"'`]"), c).otherwise(ends(c)))
    return F.array_join(F.zip_with(between, F.concat(kept, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def path_configs(files: DataFrame) -> DataFrame:
    """folder, base (null: none) and paths (array of pattern and targets) of tsconfig and jsconfig files, which may have comments and closing commas."""
    plain = F.regexp_replace(without_js_comments(F.col("text")), r",(\s*[}\]])", "$1")
    doc = F.from_json(plain, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")
    where = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    rows = files.where(F.col("path").rlike(r"(^|/)[tj]sconfig\.json$")).select(where.alias("folder"), doc["compilerOptions"].alias("o")).where("o.baseUrl is not null or o.paths is not null")
    join = lambda a, b: normal_path(F.concat_ws("/", F.nullif(a, F.lit("")), b))
    base = F.when(F.col("o.baseUrl").isNotNull(), join(F.col("folder"), F.col("o.baseUrl")))
    root = F.coalesce(base, F.col("folder"))
    rows = rows.withColumn("root", root)
    paths = F.transform(F.map_entries(F.coalesce("o.paths", F.create_map().cast("map<string,array<string>>"))), lambda e: F.struct(e["key"].alias("pattern"), F.transform(e["value"], lambda t: join(F.col("root"), t)).alias("targets")))
    return rows.select("folder", base.alias("base"), paths.alias("paths"))


def resolved_js(imports: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """file, line, spec, kind (builtin, local, package or unresolved), target and package of imports.

    Relative ones are looked for beside the file, others by the patterns and the base of the nearest configuration above it;
    what isn't found there is a package. All places that an import may be at are joined with the files, the first one wins.
    """
    up = F.split(F.regexp_extract("file", "^(.*)/[^/]*$", 1), "/")
    ways = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(up)), lambda n: F.array_join(F.slice(up, F.lit(1), n), "/"))))
    rows = imports.withColumn("_sg_id", F.struct("file", "line", "spec"))
    above = rows.where(~F.col("spec").rlike("^[./]")).select("_sg_id", F.explode(ways).alias("folder")).join(configs, "folder")
    near = above.groupBy("_sg_id").agg(F.max_by(F.struct("base", "paths"), F.length("folder")).alias("c"))
    spec, none = F.col("spec"), F.array().cast("array<string>")

    def starred(p: Column) -> Column:
        before, after = F.split_part(p["pattern"], F.lit("*"), F.lit(1)), F.split_part(p["pattern"], F.lit("*"), F.lit(2))
        wild = F.startswith(spec, before) & F.endswith(spec, after) & (F.length(spec) >= F.length(before) + F.length(after))
        middle = F.substr(spec, F.length(before) + 1, F.length(spec) - F.length(before) - F.length(after))
        fits = F.when(F.contains(p["pattern"], F.lit("*")), wild).otherwise(p["pattern"] == spec)
        return F.when(fits, F.transform(p["targets"], lambda t: F.replace(t, F.lit("*"), middle))).otherwise(none)

    own = F.array(normal_path(F.concat(F.regexp_extract("file", "^(.*/)?[^/]*$", 1), spec)))
    patterns = F.flatten(F.transform(F.coalesce("c.paths", F.array().cast("array<struct<pattern:string,targets:array<string>>>")), starred))
    under_base = F.when(F.col("c.base").isNotNull(), F.array(normal_path(F.concat_ws("/", F.nullif(F.col("c.base"), F.lit("")), spec)))).otherwise(none)
    places = F.when(spec.startswith("."), own).when(spec.startswith("/"), none).otherwise(F.concat(patterns, under_base))
    asked = rows.join(near, "_sg_id", "left").withColumn("_sg_bases", F.array_compact(places))
    tried = asked.select("_sg_id", F.posexplode("_sg_bases").alias("which", "base")).select("_sg_id", "which", "base", F.posexplode(F.array(*map(F.lit, ENDINGS))).alias("place", "ending"))
    hits = tried.withColumn("path", F.concat("base", "ending")).join(files.select("path"), "path").groupBy("_sg_id").agg(F.min_by("path", F.struct("which", "place")).alias("target"))
    builtin = spec.startswith("node:") | spec.isin(*BUILTINS)
    kind = F.when(builtin, "builtin").when(F.col("target").isNotNull(), "local").when(spec.rlike("^[./]"), "unresolved").otherwise("package")
    done = rows.join(hits, "_sg_id", "left").withColumn("kind", kind)
    package = F.when(F.col("kind") == "package", F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^/]+)", 1))
    return done.select("file", "line", "spec", "kind", F.when(F.col("kind") == "local", F.col("target")).alias("target"), package.alias("package"))


def owners(names: DataFrame, packages: DataFrame, separator: str = "/") -> DataFrame:
    """id and package: the longest package that is the name or a leading part of it, cut at a separator.

    names: id, name. Every leading part is a key of an equi join.
    """
    parts = F.split("name", "\\Q" + separator + "\\E")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    asked = names.select("id", F.explode(keys).alias("package")).where("package <> ''")
    return asked.join(packages.select("package").distinct(), "package").groupBy("id").agg(F.max_by("package", F.length("package")).alias("package"))

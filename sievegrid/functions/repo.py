"""Names, paths, references and texts of repositories as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def repo_of_url(url: Column) -> Column:
    """struct<owner, name> of a repository's url; null where it isn't one."""
    pattern = r"^https://github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)/([A-Za-z0-9._-]{1,100}?)(?:\.git)?/?$"
    name = F.regexp_extract(url, pattern, 2)
    return F.when(url.rlike(pattern) & ~name.isin(".", ".."), F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), name.alias("name")))


def valid_ref(ref: Column) -> Column:
    """Whether a branch or tag name can't be taken for an option or a way out of its folder."""
    return ref.rlike(r"^[\w./-]+$") & ~ref.startswith("-") & ~F.contains(ref, F.lit("..")) & ~F.contains(ref, F.lit("//")) & ~ref.endswith("/") & ~ref.endswith(".lock")


def confined_path(path: Column) -> Column:
    """A path below the repository's root without empty and "." parts; null where it is absolute, leaves the root, or meets .git."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    bad = (F.length(path) > 1024) | F.contains(path, F.lit("\0")) | F.contains(path, F.lit("\\")) | path.rlike("^/|^[A-Za-z]:") | F.exists(parts, lambda s: (s == "..") | (F.lower(s) == ".git"))
    return F.when(~bad, F.array_join(parts, "/"))


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob with ``**`` (any depth), ``*`` and ``?`` (inside a part) and ``{a,b}``."""
    signs = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}
    tokens = re.findall(r"\*\*/|\*\*|[*?{},]|[^*?{},]+", glob)
    inside, out = False, ""
    for t in tokens:
        if t == "," and inside:
            out += "|"
        elif t in signs and not (t == "{" and inside) and not (t == "}" and not inside):
            out += signs[t]
            inside = t == "{" or inside and t != "}"
        else:
            out += re.escape(t)
    return f"^{out}{')' if inside else ''}$"


def estimated_tokens(chars: Column) -> Column:
    return F.ceil(chars / 3.5)


def kebab(text: Column) -> Column:
    """Lower-case words with dashes between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def config_rule_id(name: Column) -> Column:
    return F.when(name.startswith("config/"), name).otherwise(F.concat(F.lit("config/"), F.coalesce(F.nullif(kebab(name), F.lit("")), F.lit("issue"))))


def taint_rule_id(name: Column) -> Column:
    """taint/ and the last part of a flow's name, of at most 60 characters."""
    tail = F.coalesce(F.try_element_at(F.filter(F.split(name, "/"), lambda x: x != ""), F.lit(-1)), F.lit(""))
    plain = F.substring(kebab(F.regexp_replace(tail, "([a-z0-9])([A-Z])", "$1-$2")), 1, 60)
    return F.concat(F.lit("taint/"), F.coalesce(F.nullif(plain, F.lit("")), F.lit("tainted-flow")))


def redacted_env(text: Column) -> Column:
    """Text of an environment file of whose values two characters at most are left."""
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$"

    def line(x: Column) -> Column:
        raw = F.trim(F.regexp_extract(x, pattern, 2))
        value = F.when(raw.rlike("^(\".*\"|'.*')$") & (F.length(raw) >= 2), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        shown = F.when(F.length(value) <= 2, "…").otherwise(F.concat(F.substring(value, 1, 2), F.lit("…")))
        return F.when(~x.rlike(r"^\s*#") & x.rlike(pattern) & (value != ""), F.concat(F.regexp_extract(x, pattern, 1), F.lit("="), shown)).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def is_kubernetes_manifest(text: Column) -> Column:
    """Whether a YAML text has apiVersion and kind with values at its top level."""
    has = lambda key: text.rlike(rf"(?m)^['\"]?{key}['\"]?\s*:\s*['\"]?[A-Za-z]")
    return has("apiVersion") & has("kind")


def mentioned_functions(text: Column) -> Column:
    """Different names that a text writes as calls or in backticks."""
    called, quoted = F.regexp_extract_all(text, F.lit(r"([A-Za-z_$][\w$.]*)\s*\(\)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"`([A-Za-z_$][\w$.]*)`"), F.lit(1))
    return F.array_distinct(F.concat(called, quoted))


def permalink(owner: Column, name: Column, sha: Column, file: Column, start: Column, end: Column) -> Column:
    """Address of lines of a file at a commit; parts of the path are encoded, and parts of dots alone can't lead upwards."""
    part = lambda s: F.when(s.rlike(r"^\.+$"), F.replace(s, F.lit("."), F.lit("%2E"))).otherwise(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")))
    lines = F.when(end > start, F.concat(F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))).otherwise(F.concat(F.lit("#L"), start.cast("string")))
    return F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit("/blob/"), sha, F.lit("/"), F.array_join(F.transform(F.split(file, "/"), part), "/"), lines)


def package_root(spec: Column) -> Column:
    """npm package of a module's name."""
    return F.regexp_extract(spec, r"^(@[^/]+(?:/[^/]+)?|[^/]*)", 1)


def module_name(distribution: Column) -> Column:
    """Module that a PyPI distribution most often installs."""
    return F.regexp_replace(F.lower(F.trim(distribution)), "[-_.]+", "_")


def canonical_map(values: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def merged_factors(first: Column, second: Column) -> Column:
    """Factors (array of structs of factor, effect, reason) of two lists, once each: the effect of the second and the reason of the first count."""
    of = lambda arr, name: F.get(F.filter(arr, lambda f: f["factor"] == name), F.lit(0))
    names = F.array_distinct(F.concat(F.transform(first, lambda f: f["factor"]), F.transform(second, lambda f: f["factor"])))
    return F.transform(names, lambda n: F.struct(n.alias("factor"), F.coalesce(of(second, n)["effect"], of(first, n)["effect"]).alias("effect"), F.coalesce(of(first, n)["reason"], of(second, n)["reason"]).alias("reason")))

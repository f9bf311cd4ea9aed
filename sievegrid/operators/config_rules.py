"""Rules over Dockerfiles and environment files, as columns over whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions import yaml_tree

_SECRET_NAME = r"(?i)(secret|token|passw(?:or)?d|api_?key|private_?key|credential)"


def _lines(files: DataFrame) -> DataFrame:
    """path, pos (from 0) and content of every line."""
    return files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)).alias("pos", "content"))


def _instructions(files: DataFrame) -> DataFrame:
    """path, line, op and rest of every instruction; a line that ends in a backslash goes on in the next one."""
    w = Window.partitionBy("path").orderBy("pos")
    rows = _lines(files).withColumn("goes_on", F.col("content").rlike(r"\\\s*$") & ~F.col("content").rlike(r"^\s*#"))
    block = F.sum(F.when(F.lag("goes_on", 1, False).over(w), 0).otherwise(1)).over(w)
    piece = F.struct("pos", F.regexp_replace("content", r"\\\s*$", " ").alias("content"))
    blocks = rows.withColumn("block", block).groupBy("path", "block").agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda x: x["content"]), "")
    logical = blocks.select("path", (F.col("pos") + 1).alias("line"), text.alias("content")).where(F.col("content").rlike(r"^\s*[A-Za-z]+\s") & ~F.col("content").rlike(r"^\s*#"))
    return logical.select("path", "line", F.upper(F.regexp_extract("content", r"^\s*([A-Za-z]+)", 1)).alias("op"), F.trim(F.regexp_extract("content", r"(?s)^\s*[A-Za-z]+\s+(.*)$", 1)).alias("rest"))


def dockerfile_issues(files: DataFrame) -> DataFrame:
    """path, line and rule: secrets in ARG or ENV, downloads piped to a shell, final user root, base without fixed tag."""
    each = _instructions(files)
    told = each.where(F.col("op").isin("FROM", "USER")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "op", "rest"))).alias("steps"))
    secret = F.col("op").isin("ARG", "ENV") & F.col("rest").rlike(r"(?i)\b\w*" + _SECRET_NAME[4:] + r"\w*(=|\s+)[\"']?[^\s\"'$]{3,}")
    piped = (F.col("op") == "RUN") & F.col("rest").rlike(r"\b(curl|wget)\b[^|;&]*\|\s*(sudo\s+)?(ba|z|da)?sh\b")
    stage = lambda s: F.lower(F.regexp_extract(s["rest"], r"(?i)\sAS\s+(\S+)\s*$", 1))
    image = F.regexp_extract("rest", r"^(?:--\S+\s+)*(\S+)", 1)
    stages = told.select("path", F.transform(F.filter("steps", lambda s: s["op"] == "FROM"), stage).alias("stages"))
    loose = each.where("op = 'FROM'").join(stages, "path").where(~F.array_contains("stages", F.lower(image)) & (image != "scratch") & ~image.rlike("[$@]") & (image.rlike(":latest$") | ~F.substring_index(image, "/", -1).contains(":")))

    # a fold over instructions: the user of each named stage, and of the one being built
    none = F.create_map().cast("map<string,string>")

    def follow(acc: Column, s: Column) -> Column:
        base = F.lower(F.regexp_extract(s["rest"], r"^(?:--\S+\s+)*(\S+)", 1))
        named = F.map_concat(F.map_filter(acc["users"], lambda k, _: k != acc["stage"]), F.create_map(acc["stage"], acc["user"]))
        from_ = F.struct(named.alias("users"), stage(s).alias("stage"), F.coalesce(F.element_at(named, base), F.lit("")).alias("user"), s["line"].alias("line"))
        user = F.struct(acc["users"].alias("users"), acc["stage"].alias("stage"), F.regexp_extract(s["rest"], r"^([^\s:]+)", 1).alias("user"), acc["line"].alias("line"))
        return F.when(s["op"] == "FROM", from_).when(s["op"] == "USER", user).otherwise(acc)

    start = F.struct(none.alias("users"), F.lit("").alias("stage"), F.lit("").alias("user"), F.lit(0).alias("line"))
    last = told.select("path", F.aggregate("steps", start, follow).alias("end")).where("end.line > 0 and end.user in ('', 'root', '0')")
    return (
        each.where(secret).select("path", "line", F.lit("config/docker-secret-in-arg-env").alias("rule"))
        .union(each.where(piped).select("path", "line", F.lit("config/docker-curl-pipe-shell")))
        .union(loose.select("path", "line", F.lit("config/docker-latest-tag")))
        .union(last.select("path", "end.line", F.lit("config/docker-root-user")))
    )


def env_issues(files: DataFrame) -> DataFrame:
    """path, line, rule and name: values in committed environment files (not templates), and secret-like names with a public prefix."""
    rows = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("at", "content")).withColumn("line", F.col("at") + 1)
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*[\"']?([^\s\"'#]+)"
    rows = rows.withColumns({"name": F.regexp_extract("content", pattern, 1), "value": F.regexp_extract("content", pattern, 2)}).where("name <> '' and value <> ''")
    env = F.col("path").rlike(r"(^|/)\.env(\.[^/]*)?$") & ~F.col("path").rlike(r"(?i)\.(example|sample|template|dist)$")
    public = F.col("name").rlike(r"^(NEXT_PUBLIC|VITE|REACT_APP|NUXT_PUBLIC|EXPO_PUBLIC|GATSBY)_") & F.col("name").rlike(_SECRET_NAME) & ~F.col("name").rlike(r"(?i)(PUBLIC_?KEY|PUBLISHABLE_?KEY|ANON_?KEY|SITE_?KEY)$")
    first = rows.where(env).groupBy("path").agg(F.min("line").alias("line")).select("path", "line", F.lit("config/env-file-committed").alias("rule"), F.lit(None).cast("string").alias("name"))
    return first.union(rows.where(public).select("path", "line", F.lit("config/client-exposed-credential"), "name"))


#: Expressions that an outsider's event can fill.
UNTRUSTED = (
    "github.event.issue.title", "github.event.issue.body", "github.event.pull_request.title", "github.event.pull_request.body",
    "github.event.pull_request.head.ref", "github.event.pull_request.head.label", "github.event.comment.body", "github.event.review.body",
    "github.event.review_comment.body", "github.event.discussion.title", "github.event.discussion.body", "github.event.head_commit.message", "github.head_ref",
)


#: Fixed value: depth of the deepest node that a rule looks at: an entry of a step's ``with``.
DEEPEST = 6


def yaml_nodes(files: DataFrame) -> DataFrame:
    """path, id, parent, key, at, value, line and value_line of each node of YAML files (path, text), as ``functions.yaml_tree`` reads them.

    trail has the keys from the root down to the node (null for an item), above the ids of these nodes; both are null below ``DEEPEST``.
    """
    schema = "path string, id int, parent int, key string, at int, value string, line int, value_line int, trail array<string>, above array<int>"
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())]

    def placed(rows: list[list]) -> list[list]:
        ways: dict[int, tuple[list, list]] = {0: ([], [])}
        for row in rows:
            way = ways.get(row[1])
            if way and len(way[0]) < DEEPEST:
                ways[row[0]] = ([*way[0], row[2]], [*way[1], row[0]])
            row += ways.get(row[0], (None, None))
        return rows

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=[part.split()[0] for part in schema.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held += ([path, *row] for row in placed(list(yaml_tree.nodes(text or ""))))
                if len(held) >= 8192:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)

    return files.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema)


def workflow_issues(files: DataFrame) -> DataFrame:
    """path, line and rule of workflow files (path, text), from their nodes.

    Actions of others that aren't pinned to a commit; values that an outsider's event fills in scripts, a row for each; a checkout step
    whose own ``ref`` is a pull request's head, in a workflow with the target's rights; and permissions to write everything, of a
    workflow or a job, or none stated anywhere with such a trigger. Files of other paths and files that aren't maps give nothing.

    A node's trail tells what it is, so nodes that no rule asks for are dropped where they are read; the others are dealt out by path
    once, and what a rule asks of a step or a file is told by windows over them.
    """
    # a small table makes many texts: they are dealt out before they are read
    n = yaml_nodes(files.where(F.col("path").rlike(r"(?i)(^|/)\.github/workflows/[^/]+\.ya?ml$")).repartition("path"))
    key = lambda i: F.get("trail", F.lit(i))
    deep = F.size("trail")
    item = key(3).isNull() & F.coalesce((key(0) == "jobs") & key(1).isNotNull() & (key(2) == "steps"), F.lit(False))
    kind = (
        F.when((key(0) == "on") & (deep == 1), "trigger").when((key(0) == "on") & (deep == 2), "trigger").when((deep == 1) & (key(0) == "permissions"), "stated")
        .when((deep == 3) & (key(0) == "jobs") & key(1).isNotNull() & (key(2) == "permissions"), "stated").when(item & (deep == 4), "step").when(item & (deep == 5) & (key(4) == "uses") & F.col("value").isNotNull(), "uses")
        .when(item & (deep == 5) & (key(4) == "run"), "run").when(item & (deep == 6) & (key(4) == "with") & (key(5) == "ref"), "ref")
    )
    # a trigger is the value of `on` or of an item of it, or a key of it
    name = F.when((F.col("trail")[0] == "on") & (deep == 2) & key(1).isNotNull(), key(1)).otherwise(F.col("value"))
    of_pull = F.contains("value", F.lit("github.event.pull_request.head")) | F.contains("value", F.lit("github.head_ref"))
    found = n.select("path", "line", "value_line", kind.alias("kind"), F.get("above", F.lit(3)).alias("step"), name.alias("value"))
    found = found.where(F.col("kind").isin("uses", "run", "stated", "step") | ((F.col("kind") == "trigger") & (F.col("value") == "pull_request_target")) | ((F.col("kind") == "ref") & of_pull))
    # scripts go as lines and values that an outsider's event fills
    lines = F.transform(F.split("value", "\n", -1), lambda x, i: F.struct((F.col("value_line") + i).alias("line"), F.regexp_extract_all(x, F.lit(r"\$\{\{([^}]{0,500})\}\}"), F.lit(1)).alias("values")))

    def untrusted(v: Column) -> Column:
        has = lambda x: F.contains(v, F.lit(x))
        return F.coalesce(*(F.when(has(x), True) for x in UNTRUSTED), F.when(has("github.event.commits.") & has(".message"), True), F.when(has("github.event.pages.") & has(".page_name"), True), F.lit(False))

    injected = F.flatten(F.transform(lines, lambda x: F.transform(F.filter(x["values"], untrusted), lambda _: x["line"])))
    none = F.array().cast("array<int>")
    spec, ref = F.regexp_extract("value", r"^(.*?)(?:@([^@]*))?$", 1), F.regexp_extract("value", r"^(.*?)(?:@([^@]*))?$", 2)
    own = F.col("value").rlike(r"^(\./|\.\\|docker://)") | F.split(spec, "/")[0].isin("actions", "github")
    is_ = lambda k: F.col("kind") == k
    told = found.select(
        "path", "line", "kind", "step", F.coalesce(F.when(is_("run"), injected), none).alias("injected"), F.coalesce(is_("uses") & ~own & ~ref.rlike("^[0-9a-fA-F]{40}$"), F.lit(False)).alias("loose"),
        F.coalesce(is_("uses") & F.col("value").rlike(r"^actions/checkout(@|$)"), F.lit(False)).alias("checkout"), F.coalesce(is_("stated") & (F.col("value") == "write-all"), F.lit(False)).alias("broad"),
    ).where(~is_("run") | (F.size("injected") > 0)).repartition("path")

    file, step = Window.partitionBy("path"), Window.partitionBy("path", "step")
    first = F.row_number().over(Window.partitionBy("path", "kind").orderBy("line")) == 1
    any_ = lambda c, w: F.coalesce(F.max(c).over(w), F.lit(False))
    seen = told.withColumns({
        "target": any_(is_("trigger"), file), "states": any_(is_("stated"), file), "pulls": any_(is_("ref"), step), "step_line": F.max(F.when(is_("step"), F.col("line"))).over(step), "first": first,
        "alone": F.row_number().over(Window.partitionBy("path", "line", "loose").orderBy("step")) == 1,
    })
    issue = lambda when, line, rule: F.when(when, F.struct(line.alias("line"), F.lit(f"config/gha-{rule}").alias("rule")))
    issues = F.array_compact(F.array(
        issue(F.col("loose") & F.col("alone"), F.col("line"), "unpinned-action"), issue(F.col("checkout") & F.col("pulls") & F.col("target"), F.col("step_line"), "pull-request-target-checkout"),
        issue(F.col("broad"), F.col("line"), "excessive-permissions"), issue(is_("trigger") & F.col("first") & ~F.col("states"), F.lit(1), "excessive-permissions"),
    ))
    scripts = F.transform("injected", lambda x: F.struct(x.alias("line"), F.lit("config/gha-script-injection").alias("rule")))
    return seen.select("path", F.explode(F.concat(issues, scripts)).alias("i")).select("path", "i.line", "i.rule")

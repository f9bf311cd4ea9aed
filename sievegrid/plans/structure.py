"""Structure of files whose shape comes from rows: functions of scripts and Python files, and workflow rules over nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.operators import config_rules, function_metrics, python_imports
from sievegrid.plans.registry import query
from sievegrid.sources.tables import table


def _repeat(text: str, times: Column) -> Column:
    return F.repeat(F.lit(text), times.cast("int"))


_SHAPE = "s AS (SELECT p_partkey, CAST(p_partkey % 6 AS INTEGER) AS d, CAST(p_size % 4 AS INTEGER) AS k, CAST(p_size AS INTEGER) AS z FROM part)"


@query(f"""
    WITH {_SHAPE}
    SELECT p_partkey, NULL AS name, CAST(NULL AS INTEGER) AS start_line, CAST(NULL AS INTEGER) AS end_line, CAST(NULL AS INTEGER) AS length, CAST(0 AS INTEGER) AS nesting, CAST(0 AS INTEGER) AS branches FROM s
    UNION ALL SELECT p_partkey, 'f' || p_partkey, 2, 2 * d + z + 5, 2 * d + z + 4, d, d FROM s
    UNION ALL SELECT p_partkey, 'g', 2 * d + z + 7, 2 * d + z + 11 + 2 * k, 5 + 2 * k, k + 2, k + 2 FROM s
    UNION ALL SELECT p_partkey, 'anonymous', 2 * d + z + 10 + 2 * k, 2 * d + z + 10 + 2 * k, 1, 0, 0 FROM s""")
def script_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each part, as deep, long and branched as the part says, with brackets in comments and strings."""
    d, k, z = F.col("p_partkey") % 6, F.col("p_size") % 4, F.col("p_size")
    text = F.concat(
        F.lit("/* { if ( */ // function no() {\nexport async function f"), F.col("p_partkey").cast("string"), F.lit("(a = {}, b) {\n"), _repeat("if (a) {\n", d), F.lit("go('{ for (', `}`); // }\n"), _repeat("}\n", d), _repeat("go(a);\n", z), F.lit("return /[{(]/;\n}\n\n"),
        F.lit("const g = (x, { y }) => {\nfor (const q of x) if (x) {\n"), _repeat("  y = q;\n} else if (y) {\n", k), F.lit("}\nreturn x.map((v) => v + 1);\n};\n"),
    )
    return function_metrics.script_functions(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


@query(f"""
    WITH {_SHAPE}
    SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, NULL AS name, CAST(NULL AS INTEGER) AS start_line, CAST(NULL AS INTEGER) AS end_line, CAST(NULL AS INTEGER) AS length, k AS nesting, k AS branches FROM s
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'outer', 3 + 2 * k, 6 + 2 * k + d + z, 4 + d + z, d, d FROM s
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'inner', 5 + 2 * k + d, 6 + 2 * k + d + z - 1, z + 1, CASE WHEN z % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN z % 2 = 0 THEN 1 ELSE 0 END FROM s""")
def python_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each part, with an indented function in a function and branches outside of both."""
    d, k, z = (F.col("p_partkey") % 6).cast("int"), (F.col("p_size") % 4).cast("int"), F.col("p_size").cast("int")
    deep = lambda n, line: F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.repeat(F.lit("  "), i), F.lit(line))), "")).otherwise("")
    under = lambda n: F.concat(F.repeat(F.lit("  "), n), F.lit("pass\n"))
    nested = F.when(d > 0, F.array_join(F.transform(F.sequence(F.lit(1), d), lambda i: F.concat(F.repeat(F.lit("  "), i), F.lit("while a:\n"))), "")).otherwise("")
    body = F.when(z % 2 == 0, F.concat(F.lit("    if x:\n"), _repeat("      y()\n", z - 1))).otherwise(_repeat("    y()\n", z))
    text = F.concat(deep(k, "if top:\n"), F.when(k > 0, under(k)).otherwise("pass\n"), _repeat("# comment: def no():\n", k), F.lit("class Thing:\nasync def outer(a):\n"), nested, under(d + 1), F.lit("  def inner(x):\n"), body, F.lit("  return a\n\n"))
    return function_metrics.python_functions(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("""
    WITH s AS (SELECT c_custkey, c_nationkey % 2 = 0 AS target, CASE c_custkey % 3 WHEN 2 THEN 3 ELSE 1 END AS o, c_custkey % 5 = 0 AS head, c_custkey % 7 = 0 AS broad, c_custkey % 4 = 0 AS pinned, c_mktsegment = 'BUILDING' AS bad FROM customer),
    r AS (SELECT *, o + CASE WHEN broad THEN 1 ELSE 0 END AS b FROM s)
    SELECT CAST(c_custkey AS VARCHAR) AS customer, CAST(line AS INTEGER) AS line, rule FROM (
        SELECT c_custkey, b + 8 AS line, 'config/gha-unpinned-action' AS rule FROM r WHERE NOT pinned
        UNION ALL SELECT c_custkey, b + 4, 'config/gha-pull-request-target-checkout' FROM r WHERE target AND head
        UNION ALL SELECT c_custkey, b + 14, 'config/gha-script-injection' FROM r WHERE bad
        UNION ALL SELECT c_custkey, b + 14, 'config/gha-script-injection' FROM r WHERE bad
        UNION ALL SELECT c_custkey, o + 3, 'config/gha-excessive-permissions' FROM r WHERE broad
        UNION ALL SELECT c_custkey, 1, 'config/gha-excessive-permissions' FROM r WHERE target AND NOT broad)""")
def workflow_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workflow for each customer: another step's ``ref``, a safe variable and a step's name must not count."""
    key = F.col("c_custkey")
    trigger = F.when(F.col("c_nationkey") % 2 == 0, "pull_request_target").otherwise("pull_request")
    on = F.when(key % 3 == 0, F.concat(F.lit("on: "), trigger)).when(key % 3 == 1, F.concat(F.lit("'on': [push, "), trigger, F.lit("] # when"))).otherwise(F.concat(F.lit('"on":\n  '), trigger, F.lit(":\n    types: [opened]")))
    ref = F.when(key % 5 == 0, "ref: ${{ github.event.pull_request.head.sha }}").otherwise("fetch-depth: 0")
    said = F.when(F.col("c_mktsegment") == "BUILDING", "'${{ github.event.issue.title }}' ${{github.head_ref}}").otherwise("$TITLE ${{ github.sha }}")
    action = F.concat(F.lit("other/thing@"), F.when(key % 4 == 0, F.repeat(F.lit("a1"), 20)).otherwise("v1"))
    text = F.concat(
        on, F.lit("\njobs:\n  build:\n"), F.when(key % 7 == 0, "    permissions: 'write-all'\n").otherwise(""), F.lit("    steps:\n      - uses: actions/checkout@v4\n        with:\n          "), ref,
        F.lit("\n      - name: ${{ github.head_ref }}\n        uses: "), action, F.lit("\n        with: {ref: '${{ github.head_ref }}'}\n      - env:\n          TITLE: ${{ github.event.issue.title }}\n        run: |\n          # a: b\n          echo "), said, F.lit("\n      - uses: ./local\n      - run: echo done"),
    )
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("r/"), key.cast("string"), F.lit("/.github/workflows/ci.yml")).alias("path"), text.alias("text"))
    found = config_rules.workflow_issues(files)
    return found.select(F.split("path", "/")[1].alias("customer"), "line", "rule")


@query("""
    WITH s AS (SELECT p_partkey AS k, 'b' || CAST(p_size % 7 AS INTEGER) AS x, 'b' || CAST((p_size + 1) % 7 AS INTEGER) AS y FROM part), own AS (SELECT *, x || '/m' || k || '.py' AS path FROM s)
    SELECT path, CAST(line AS INTEGER) AS line, spec, kind, target, package FROM (
        SELECT path, 1 AS line, 'os' AS spec, 'builtin' AS kind, NULL AS target, NULL AS package FROM own UNION ALL SELECT path, 1, x, 'local', x || '/__init__.py', NULL FROM own
        UNION ALL SELECT path, 2, y, 'local', y || '/__init__.py', NULL FROM own UNION ALL SELECT path, 6, '.', 'local', x || '/__init__.py', NULL FROM own UNION ALL SELECT path, 6, '.m' || k, 'local', path, NULL FROM own
        UNION ALL SELECT path, 7, '...', 'unresolved', NULL, NULL FROM own UNION ALL SELECT path, 8, 'p' || k || '_lib.sub', 'package', NULL, 'p' || k || '-lib' FROM own UNION ALL SELECT path, 8, 'json', 'builtin', NULL, NULL FROM own)""")
def python_import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with a module for each part in seven packages: imports over several lines, relative ones, and ones that leave the tree."""
    k = F.col("p_partkey").cast("string")
    pack = lambda more: F.concat(F.lit("b"), ((F.col("p_size") + more) % 7).cast("int").cast("string"))
    text = F.concat(
        F.lit("import os, "), pack(0), F.lit("  # not: import x\nfrom "), pack(1), F.lit(" import (\n    m"), k, F.lit(",\n    gone\n)\nfrom . import m"), k,
        F.lit(" as me\nfrom ... import up\nimport p"), k, F.lit("_lib.sub \\\n    , json\ns = 'import no'\n"),
    )
    parts = table(spark, sf_dir, "part")
    files = parts.select(F.concat(pack(0), F.lit("/m"), k, F.lit(".py")).alias("path"), text.alias("text"))
    packages = parts.select(F.concat(pack(0), F.lit("/__init__.py")).alias("path"), F.lit("").alias("text")).distinct()
    return python_imports.resolved(files.union(packages))

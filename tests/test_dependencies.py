"""Dedupe, dependency and configuration operators."""

import json

from pyspark.sql import functions as F

from sievegrid.functions import text as tx
from sievegrid.operators import config_rules, dedupe, dependencies as dep


def test_absorption_is_best_first_and_not_transitive(spark):
    schema = "id string, category string, rule_id string, file string, start int, end int, trace array<struct<file:string,line:int,kind:string>>, rank int"
    rows = [("a", "taint", "taint/sqli", "f", 10, 12, [("f", 30, "sink")], 1), ("b", "sast", "sast/sql-injection", "f", 12, 14, None, 2), ("c", "sast", "sast/sql-injection", "f", 14, 16, None, 3), ("d", "sast", "sast/sql-injection", "f", 30, 30, [], 4), ("e", "sast", "sast/xss", "f", 12, 12, None, 5), ("g", "secret", "x/sqli", "f", 10, 10, None, 6)]
    got = {(r.id, r.winner_id) for r in dedupe.absorbed(spark.createDataFrame(rows, schema).withColumn("cwe", F.lit(None).cast("string"))).collect()}
    assert got == {("b", "a"), ("d", "a")}


def test_absorption_holds_no_component_and_no_square_of_findings(spark, monkeypatch):
    import random

    from pyspark.sql import GroupedData

    rng = random.Random(4)
    rows = []
    for k in range(1500):
        file, start = ("hot" if k % 3 else f"f{k % 40}"), rng.randrange(40)
        trace = [(f"f{rng.randrange(40)}", rng.randrange(40), None)] if k % 50 == 0 else None
        rows.append((f"i{k}", "sast", f"sast/{'xss' if k % 4 else 'sqli'}", None if k % 97 == 0 else file, start, start + rng.randrange(-1, 3), trace, 7 * k + 1))
    rows += [(f"c{k}", "sast", "sast/xss", "chain", 2 * k, 2 * k + 2, None, 20_000 + k) for k in range(9)]  # ranks ascend: several rounds
    rows += [("p1", "sast", "sast/xss", "late", 5, 6, None, 31_002), ("p2", "sast", "sast/xss", "late", 6, 7, None, 31_001), ("p3", "sast", "sast/xss", "late", 1, 2, None, 31_000), ("p4", "sast", "sast/xss", "late", 2, 5, None, 31_003)]
    # q5 meets two winners of different rounds: the one of the later round is better
    rows += [(n, "sast", "sast/xss", "two", a, b, None, r) for n, a, b, r in (("q1", 1, 2, 40_000), ("q2", 2, 4, 40_001), ("q3", 4, 6, 40_002), ("q4", 8, 9, 40_003), ("q5", 6, 8, 40_004))]
    rng.shuffle(rows)
    schema = "id string, category string, rule_id string, file string, start int, end int, trace array<struct<file:string,line:int,kind:string>>, rank long"

    def meet(x, y):
        reach = lambda p, q: any(f == q[3] and q[4] <= n <= q[5] for f, n, _ in p[6] or ())
        end = lambda p: p[6][-1][:2] if p[6] else None
        inside = lambda p, q: end(p)[0] == q[3] and q[4] <= end(p)[1] <= q[5]
        if end(x) and end(y) and not (end(x)[0] == end(y)[0] and (end(x)[1] == end(y)[1] or inside(x, y) or inside(y, x))):
            return False
        return x[2] == y[2] and (x[3] is not None and x[3] == y[3] and x[4] <= y[5] and y[4] <= x[5] or reach(x, y) or reach(y, x))

    order, taken, want = sorted(rows, key=lambda r: r[7]), set(), set()
    for i, x in enumerate(order):
        if x[0] not in taken:
            for y in order[i + 1 :]:
                if y[0] not in taken and meet(x, y):
                    taken.add(y[0])
                    want.add((y[0], x[0]))
    made, pairs = [], dedupe.candidate_pairs
    monkeypatch.setattr(dedupe, "candidate_pairs", lambda f: made.append(pairs(f)) or made[-1])
    monkeypatch.setattr(GroupedData, "applyInPandas", None)  # no group goes to one task
    got = [(r.id, r.winner_id) for r in dedupe.absorbed(spark.createDataFrame(rows, schema).withColumn("cwe", F.lit(None).cast("string"))).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ("q5", "q3") in want and ("p4", "p3") in want
    n, square = made[0].count(), pairs(spark.createDataFrame(rows, schema).withColumn("cwe", F.lit(None).cast("string"))).count()
    assert 2 * n < square, (n, square)


def test_families_sinks_and_merged_winners(spark):
    names = {"sast/sql_injection": "sql-injection", "taint/SQLi ": "sql-injection", "config/Missing  Authentication": "missing-authn", "x": "x", "a/": ""}
    got = spark.createDataFrame([(n,) for n in names], "r string").select("r", dedupe.family(F.col("r")).alias("x")).collect()
    assert {r.r: r.x for r in got} == names
    schema = f"id string, category string, rule_id string, cwe string, file string, start int, end int, trace {dedupe.TRACE}, rank int, analyzer string, produced_by array<string>, fingerprint string, merged array<string>"
    flow = lambda line: [("f", 1, "source"), ("f", line, "sink"), ("g", 9, "step")]
    rows = [
        ("a", "taint", "taint/sqli", "CWE-89", "f", 1, 60, flow(50), 1, "taint", None, "fa", None),
        ("b", "taint", "taint/sqli", "CWE-89", "h", 1, 1, [("f", 1, "source"), ("f", 80, "sink")], 2, "taint", None, "fb", None),  # another sink
        ("c", "sast", "sast/other", " cwe-89", "f", 48, 52, None, 3, "code", ["sast:llm"], "fc", ["old"]),  # by CWE
        ("d", "sast", "sast/other", None, "f", 48, 52, None, 4, "code", None, "fd", None),  # generic and without CWE
        ("e", "quality", "quality/sql injection", None, "f", 50, 50, None, 5, "quality", ["taint", "q"], "fe", ["fa"]),
    ]
    findings = spark.createDataFrame(rows, schema)
    taken = dedupe.absorbed(findings)
    assert {(r.id, r.winner_id) for r in taken.collect()} == {("c", "a"), ("e", "a")}
    merged = [tuple(r) for r in dedupe.merged_winners(findings, taken).collect()]
    assert merged == [("a", ["taint", "sast:llm", "q"], ["fc", "old", "fe"], "Also reported by: code (sast/other at f:48); quality (quality/sql injection at f:50).")]


def test_npm_graph_resolves_upwards(spark):
    lock = {"lockfileVersion": 3, "packages": {"": {"dependencies": {"a": "^1", "b": "1"}}, "node_modules/a": {"version": "1.0.0", "dependencies": {"b": "^2", "c": "1"}}, "node_modules/a/node_modules/b": {"version": "2.0.0", "dependencies": {"c": "1"}}, "node_modules/b": {"version": "1.0.0", "dev": True}, "node_modules/@s/c": {"version": "3.0.0"}, "node_modules/c": {"version": "1.1.0", "resolved": "git+ssh://git@Example.com/x.git"}}}
    nodes = dep.npm_packages(spark.createDataFrame([("package-lock.json", json.dumps(lock)), ("x/package-lock.json", "{broken")], "path string, text string"))
    assert {(r.name, r.version, r.dev) for r in nodes.where("key <> ''").collect()} == {("a", "1.0.0", False), ("b", "2.0.0", False), ("b", "1.0.0", True), ("@s/c", "3.0.0", False), ("c", "1.1.0", False)}
    edges = {(r.parent, r.child) for r in dep.npm_edges(nodes).collect()}
    assert edges == {("", "node_modules/a"), ("", "node_modules/b"), ("node_modules/a", "node_modules/a/node_modules/b"), ("node_modules/a", "node_modules/c"), ("node_modules/a/node_modules/b", "node_modules/c")}
    assert [tuple(r) for r in dep.host_signals(nodes, ["registry.npmjs.org"]).collect()] == [("example.com", 1, ["c"])]
    doc = json.loads(dep.cyclonedx(nodes.where("key <> ''"), spark.createDataFrame([("package-lock.json", "ADV-1", "node_modules/c", "high")], "lockfile string, advisory string, key string, severity string")).first()["document"])
    assert len(doc["components"]) == 5 and doc["vulnerabilities"][0]["affects"] == [{"ref": "pkg:npm/c@1.1.0"}]


def test_python_locks(spark):
    poetry = '[[package]]\nname = "Flask_App"\nversion = "1.0"\n[package.dependencies]\npython = ">=3"\nWerkzeug = ">=2"\n[[package]]\nname = "werkzeug"\nversion = "2.1"\n'
    uv = '[[package]]\nname = "a"\nversion = "1"\ndependencies = [{ name = "b.c" }]\n[[package]]\nname = "b-c"\nversion = "2"\n'
    nodes = dep.python_locks(spark.createDataFrame([("poetry.lock", poetry), ("uv.lock", uv), ("bad/uv.lock", "= ="), ("n/uv.lock", None)], "path string, text string"))
    assert {(r.lockfile, r.name, r.version) for r in nodes.collect()} == {("poetry.lock", "flask-app", "1.0"), ("poetry.lock", "werkzeug", "2.1"), ("uv.lock", "a", "1"), ("uv.lock", "b-c", "2")}
    assert {(r.parent, r.child) for r in dep.named_edges(nodes).collect()} == {("flask-app", "werkzeug"), ("a", "b-c")}
    pins = dep.requirements(spark.createDataFrame([("requirements-dev.txt", "# c\nDjango==4.2 ; python_version > '3'\n-r base.txt\nrequests[socks] \\\n  ==2.0  # why\nflask>=2\nhttps://x/y.whl\n")], "path string, text string"))
    assert {(r.name, r.version, r.dev) for r in pins.collect()} == {("django", "4.2", True), ("requests", "2.0", True), ("flask", None, True)}
    pip = dep.pipfile_lock(spark.createDataFrame([("Pipfile.lock", json.dumps({"default": {"A_b": {"version": "==1.0"}}, "develop": {"c": {"version": "==2"}}}))], "path string, text string"))
    assert {(r.name, r.version, r.dev) for r in pip.collect()} == {("a-b", "1.0", False), ("c", "2", True)}


def test_discovery_takes_one_of_a_family(spark):
    files = spark.createDataFrame([(p,) for p in ("package-lock.json", "npm-shrinkwrap.json", "a/yarn.lock", "a/package.json", "requirements.txt", "b/requirements-dev.txt", "uv.lock")], "path string")
    assert {(r.path, r.kind) for r in dep.discovered(files).collect()} == {("npm-shrinkwrap.json", "npm-shrinkwrap.json"), ("a/yarn.lock", "yarn.lock"), ("uv.lock", "uv.lock"), ("requirements.txt", "requirements"), ("b/requirements-dev.txt", "requirements")}


def test_typosquats_and_upgrades(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = {(r.name, r.target) for r in dep.typosquats(names("lodahs", "lodash", "reac-t", "expres", "expresss", "preact", "zzz", "chal"), names("lodash", "react", "express", "chalk"), names("preact")).collect()}
    assert got == {("lodahs", "lodash"), ("reac-t", "react"), ("expres", "express"), ("expresss", "express"), ("chal", "chalk")}
    v = spark.createDataFrame([("p", x) for x in ("1.0.0", "1.1.0", "1.2.0", "2.0.0")], "package string, version string").withColumn("key", tx.semver(F.col("version")))
    bad = spark.createDataFrame([("p", "1.1.0")], "package string, version string")
    assert [tuple(r) for r in dep.safe_upgrade(v.where("version = '1.0.0'"), v, bad).collect()] == [("p", "1.2.0")]


def test_dockerfiles(spark):
    text = "FROM node:20 AS build\nUSER node\nENV API_TOKEN=abc123\nRUN apt-get update && \\\n  curl -s http://x/y \\\n  | sh\nFROM build\nRUN ls\nFROM alpine AS last\nARG PASSWORD\n# USER app\nFROM build AS end\n"
    rooted = "FROM ubuntu:latest\nRUN ls\n"
    got = {(r.path, r.line, r.rule.removeprefix("config/docker-")) for r in config_rules.dockerfile_issues(spark.createDataFrame([("a", text), ("b", rooted), ("c", None), ("d", "")], "path string, text string")).collect()}
    assert got == {("a", 3, "secret-in-arg-env"), ("a", 4, "curl-pipe-shell"), ("a", 9, "latest-tag"), ("b", 1, "latest-tag"), ("b", 1, "root-user")}


def test_env_files(spark):
    files = spark.createDataFrame([(".env", "# c\nA=1\nB=2"), (".env.example", "A=1"), ("x/.env.local", "A=\n"), ("src/.env.prod", "VITE_API_SECRET=abc\nVITE_PUBLIC_KEY=abc")], "path string, text string")
    got = {(r.path, r.line, r.rule.split("/")[1], r.name) for r in config_rules.env_issues(files).collect()}
    assert got == {(".env", 2, "env-file-committed", None), ("src/.env.prod", 1, "env-file-committed", None), ("src/.env.prod", 1, "client-exposed-credential", "VITE_API_SECRET")}


def test_npm_of_version_one(spark):
    lock = {"dependencies": {"a": {"version": "1.0.0", "requires": {"b": "^2", "c": "1"}, "dependencies": {"b": {"version": "2.0.0", "dev": True}}}, "b": {"version": "1.0.0"}, "@s/c": {"version": "3.0.0", "resolved": "https://x/y"}}}
    nodes = dep.nested_npm_packages(spark.createDataFrame([("l", json.dumps(lock)), ("new", json.dumps({"packages": {}, **lock})), ("bad", "{"), ("none", None), ("list", "[]")], "path string, text string"))
    assert {(r.lockfile, r.key, r.version, r.dev) for r in nodes.collect()} == {("l", "node_modules/a", "1.0.0", False), ("l", "node_modules/a/node_modules/b", "2.0.0", True), ("l", "node_modules/b", "1.0.0", False), ("l", "node_modules/@s/c", "3.0.0", False)}
    assert {(r.parent, r.child) for r in dep.npm_edges(nodes).collect()} == {("node_modules/a", "node_modules/a/node_modules/b")}


def test_manifests(spark):
    package = json.dumps({"dependencies": {"a": "^1"}, "devDependencies": {"b": "*"}, "peerDependencies": {"c": ">=1"}})
    got = {tuple(r) for r in dep.manifest_direct(spark.createDataFrame([("package.json", package), ("bad", "{"), ("none", None)], "path string, text string")).collect()}
    assert got == {("package.json", "a", "^1", "prod"), ("package.json", "b", "*", "dev"), ("package.json", "c", ">=1", "peer")}
    toml = '[project]\ndependencies = ["Foo_Bar[x] >= 1.0, <2 ; python_version > \'3\'", "b"]\n[project.optional-dependencies]\nextra = ["c~=1.0"]\n[dependency-groups]\nlint = ["d==1"]\n[tool.poetry.dependencies]\npython = "^3"\ne = "^2.0"\nf = { version = "1.*", extras = ["z"] }\n[tool.poetry.group.test.dependencies]\ng = "*"\n'
    got = {tuple(r) for r in dep.pyproject_direct(spark.createDataFrame([("pyproject.toml", toml), ("bad", "= ="), ("none", None)], "path string, text string")).collect()}
    p = "pyproject.toml"
    assert got == {(p, "foo-bar", ">=1.0,<2", "prod"), (p, "b", "", "prod"), (p, "c", "~=1.0", "optional"), (p, "d", "==1", "dev"), (p, "e", "^2.0", "prod"), (p, "f", "1.*", "prod"), (p, "g", "*", "dev")}


def test_requirements_include_others(spark):
    files = [("a/requirements.txt", "-r base.txt\nx==1\n-r gone.txt"), ("a/base.txt", "y==2\n--requirement=../common.txt\n-r requirements.txt"), ("common.txt", "z==3"), ("requirements-dev.txt", "-r common.txt\nw")]
    got = {(r.lockfile, r.name, r.version, r.dev) for r in dep.requirements_with_includes(spark.createDataFrame(files, "path string, text string")).collect()}
    a, b, d = "a/requirements.txt", "a/base.txt", "requirements-dev.txt"
    assert got == {(a, "x", "1", False), (a, "y", "2", False), (a, "z", "3", False), (b, "x", "1", False), (b, "y", "2", False), (b, "z", "3", False), ("common.txt", "z", "3", False), (d, "z", "3", True), (d, "w", None, True)}

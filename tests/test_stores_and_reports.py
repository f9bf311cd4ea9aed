"""Store writes, repository index, verification, imports by configuration, exports and scrubbing."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from sievegrid.functions import scrub
from sievegrid.operators import code_text, dependencies, imports, repo_index, reports, stores, verification


def test_scans_and_their_tables(spark):
    scans = spark.createDataFrame([("a", "r1", "RUNNING", None, None, None, None, 1.0), ("b", "r1", "FAILED", "E0", None, None, "a", 2.0), ("c", "r2", "QUEUED", None, None, None, "b", 3.0)], "id string, repo_id string, state string, error_code string, started_at timestamp, finished_at timestamp, base_scan_id string, cost_usd double")
    now = datetime(2024, 1, 1)
    asked = spark.createDataFrame([("a", "COMPLETED", "X"), ("b", "RUNNING", None), ("c", "QUEUED", None), ("zz", "FAILED", "E")], "id string, to_state string, code string")
    after = {r.id: (r.state, r.error_code, r.started_at, r.finished_at) for r in stores.transitioned(scans, asked, F.lit(now)).collect()}
    assert after == {"a": ("COMPLETED", None, now, now), "b": ("FAILED", "E0", None, None), "c": ("QUEUED", None, None, None)}
    assert {r.id: r.state for r in stores.transitioned(scans, asked, F.lit(now), once=False).collect()}["b"] == "RUNNING"
    calls = spark.createDataFrame([("a", 0.5), ("a", 0.25), ("zz", 9.0)], "scan_id string, cost_usd double")
    assert {r.id: r.cost_usd for r in stores.with_cost(scans, calls).collect()} == {"a": 1.75, "b": 2.0, "c": 3.0}
    tables = {"findings": spark.createDataFrame([("a", 1), ("c", 2)], "scan_id string, n int"), "suppressions": spark.createDataFrame([("r1", 1), ("r2", 2)], "repo_id string, n int")}
    left = stores.without_repos(tables, scans, spark.createDataFrame([("r1",)], "repo_id string"))
    assert [r.n for r in left["findings"].collect()] == [2] and [r.n for r in left["suppressions"].collect()] == [2]
    assert [(r.id, r.base_scan_id) for r in left["scans"].collect()] == [("c", None)]


def test_warnings_and_cache_sources(spark):
    warning = "struct<code:string,level:string,stage:string>"
    rows = [("a", "r", "c1", "o", "v", "COMPLETED_WITH_WARNINGS", "none", 5, [("W", "info", "S1")]), ("b", "r", "c1", "o", "v", "COMPLETED_WITH_WARNINGS", "none", 6, [("W", None, None)]), ("c", "r", "c1", "o", "v", "COMPLETED", "full", 7, []), ("d", "r", "c2", "o", "v", "COMPLETED", "none", 1, [])]
    scans = spark.createDataFrame(rows, f"id string, repo_id string, commit string, options string, versions string, state string, cache_hit string, finished_at int, warnings array<{warning}>")
    assert {(r.commit, r.id) for r in stores.cache_sources(scans).collect()} == {("c1", "a"), ("c2", "d")}
    added = spark.createDataFrame([("a", 2, ("Y", None, "S2")), ("a", 1, ("X", None, "S1"))], f"scan_id string, at int, warning {warning}")
    assert {r.id: [w.code for w in r.warnings] for r in stores.with_warnings(scans, added, "at").collect()} == {"a": ["W", "X", "Y"], "b": ["W"], "c": [], "d": []}
    assert {r.id: [w.code for w in r.warnings] for r in stores.with_warnings(scans, added, "at", ["S1"]).collect()} == {"a": ["X", "Y"], "b": ["W"], "c": [], "d": []}


def test_tree_diff_finds_renames(spark):
    tree = lambda **files: spark.createDataFrame(list(files.items()), "path string, blob string")
    got = {tuple(r) for r in stores.diff_status(tree(a="1", b="2", c="3", e="5"), tree(a="1", b="9", d="3", f="6")).collect()}
    assert got == {("b", "M", None), ("d", "R", "c"), ("e", "D", None), ("f", "A", None)}


def test_entrypoints_and_bins(spark):
    files = [
        ("app/users/route.ts", "// c\nexport async function GET() {}\nexport const POST = 1"), ("pages/api/x.js", ""), ("supabase/functions/f/index.ts", ""), ("a.ts", "/* c */\n'use server'\nfoo"), ("r.py", "@app.get('/p')\ndef f(): pass\n@bp.route(\"/q\")\nif __name__ == '__main__':\n"),
        ("h.py", "async def lambda_handler(event, c):"), ("x/urls.py", "urlpatterns = [path('a', b)]"), ("z.md", "app.get('/no')"), ("package.json", '{"name":"one","bin":"./cli.js"}'), ("sub/package.json", '{"bin":{"a":"bin/a.js","b":"../b.js"}}'), ("bad/package.json", "{"), ("n.ts", None),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    got = {tuple(r) for r in repo_index.entrypoints(df).collect()}
    assert got == {
        ("app/users/route.ts", "next-route", None, "GET,POST"), ("pages/api/x.js", "next-api", None, None), ("supabase/functions/f/index.ts", "edge-function", None, None), ("a.ts", "server-action", None, None), ("r.py", "http-route", 1, "GET /p"),
        ("r.py", "http-route", 3, "ROUTE /q"), ("r.py", "script", 4, None), ("h.py", "serverless", 1, None), ("x/urls.py", "django-urls", None, None),
    }
    assert {tuple(r) for r in repo_index.package_bins(df).collect()} == {("cli.js", "cli", "one"), ("sub/bin/a.js", "cli", "a"), ("b.js", "cli", "b")}


def test_file_limit_and_skips(spark):
    tree = spark.createDataFrame([("r", p, "100644", "blob", p) for p in ("a.py", "b.py", "c.py", "yarn.lock", "big.sql", "bin.txt")] + [("r", "sub", "160000", "commit", "s")], "repo string, path string, mode string, kind string, blob string")
    contents = spark.createDataFrame([("a.py", 10, "x"), ("b.py", 10, "x"), ("c.py", 10, "x"), ("yarn.lock", 10**9, "x"), ("big.sql", 2 << 20, "x"), ("bin.txt", 5, "a\0b")], "blob string, size long, head string")
    skips = lambda **how: {r.path: r.skip for r in repo_index.indexed(tree, contents, **how).collect()}
    assert skips() == {"a.py": None, "b.py": None, "c.py": None, "yarn.lock": None, "big.sql": "too_large", "bin.txt": "binary", "sub": "submodule"}
    assert skips(most_files=3)["c.py"] == "file_limit" and skips(most_files=3)["yarn.lock"] is None
    stats = repo_index.index_stats(repo_index.indexed(tree, contents)).first()
    assert (stats.files, stats["read"], stats.by_skip) == (7, 4, {"binary": 1, "submodule": 1, "too_large": 1}) and stats.by_language == {"other": 1, "python": 3}


def test_batches(spark):
    rows = spark.createDataFrame([("a", i, c) for i, c in enumerate([50, 60, 300, 10, 10, 90])] + [(None, 0, 5), (None, 1, 5)], "k string, n int, cost int")
    got = {(r.k, r.n): r.batch for r in repo_index.packed_batches(rows, "k", ["n"], "cost", 100).collect()}
    assert got == {("a", 0): 0, ("a", 1): 1, ("a", 2): 2, ("a", 3): 3, ("a", 4): 3, ("a", 5): 4, (None, 0): 0, (None, 1): 0}
    fixed = {(r.k, r.n): r.batch for r in repo_index.fixed_batches(rows, "k", ["n"], 4).collect()}
    assert fixed["a", 3] == 0 and fixed["a", 4] == 1 and fixed[None, 1] == 0


def test_places_of_snippets(spark):
    text = "import os\n\ndef run(cmd):\n    x = clean(cmd)\n    os.system(x)\n    return x\n"
    files = spark.createDataFrame([("f", text), ("gone", None)], "file string, text string")
    rows = [("same", "f", 4, 5, "4: x = clean(cmd)\n5: os.system(x)"), ("near", "f", 3, 4, "x = clean(cmd)\nos.system(x)"), ("far", "f", 1, 1, "return   x"), ("no", "f", 1, 1, "subprocess.run(y, shell=True)"), ("empty", "f", 1, 1, "  "), ("lost", "gone", 1, 1, "x"), ("out", "f", 90, 91, "x = clean(cmd)\nos.system(x)"), ("swap", "f", 5, 5, "system(x) os.")]
    got = {r.id: (r.status, r.new_start, r.new_end) for r in verification.placed(spark.createDataFrame(rows, "id string, file string, start int, end int, snippet string"), files).collect()}
    assert got == {"same": ("verified", 4, 5), "near": ("verified", 4, 5), "far": ("relocated", 6, 6), "no": ("dropped", None, None), "empty": ("dropped", None, None), "lost": ("dropped", None, None), "out": ("relocated", 4, 5), "swap": ("dropped", None, None)}
    tokens = spark.createDataFrame([("a b b", "b a b", 1.0), ("a b", "a c", 1 / 3), ("", " ", 1.0), ("a", "", 0.0)], "a string, b string, want double").withColumn("got", verification.token_similarity(F.col("a"), F.col("b"))).collect()
    assert all(abs(r.got - r.want) < 1e-9 for r in tokens)
    steps = [("t1", 0, "f", 3, "source", "def run(cmd):"), ("t1", 1, "f", 1, "step", "nothing like it at all here"), ("t1", 2, "f", 1, "sink", "os.system(x)"), ("t2", 0, "f", 3, "source", "def run(cmd):"), ("t2", 1, "f", 1, "sink", "nothing like it at all here")]
    traces = {r.flow: (r.ok, [(s.pos, s.line) for s in r.steps or []]) for r in verification.verified_traces(spark.createDataFrame(steps, "flow string, pos int, file string, line int, kind string, code string"), files).collect()}
    assert traces == {"t1": (True, [(0, 3), (2, 5)]), "t2": (False, [])}


def test_shown_lines_and_flows(spark):
    lines = spark.createDataFrame([("f", i, f"line {i}") for i in range(1, 101)] + [("g", i, f"// {i}") for i in range(1, 31)], "file string, line int, content string")
    findings = spark.createDataFrame([("a", "f", 50, 50, [("g", 5, "source")]), ("b", "f", 1, 2, None)], "id string, file string, start int, end int, trace array<struct<file:string,line:int,kind:string>>")
    shown = verification.shown_lines(findings, lines)
    assert {(r.id, r.file): (r.a, r.b) for r in shown.groupBy("id", "file").agg(F.min("line").alias("a"), F.max("line").alias("b")).collect()} == {("a", "f"): (10, 90), ("a", "g"): (1, 15), ("b", "f"): (1, 42)}
    said = spark.createDataFrame([("a", "refuted", [10, 11]), ("b", "refuted", [60])], "id string, verdict string, lines array<int>")
    assert {r.id: r.evidenced for r in verification.evidenced(said, shown).collect()} == {"a": True, "b": False}
    flow = lambda i, note, *steps: (i, "taint/x", [("f", n, k) for n, k in steps], note)
    flows = spark.createDataFrame([flow("1", "n1", (1, "source"), (3, "step"), (9, "sink")), flow("2", "n2", (2, "source"), (9, "sink")), flow("3", "n1", (2, "source"), (8, "sink"))], "id string, rule_id string, trace array<struct<file:string,line:int,kind:string>>, note string")
    assert {(r.id, r.sink.line, r.flows, tuple(r.notes)) for r in verification.distinct_flows(flows).collect()} == {("2", 9, 2, ("n1", "n2")), ("3", 8, 1, ("n1",))}


def test_imports_by_configuration(spark):
    text = "const a = 'http://x'; // import 'no1'\n/* import 'no2'\n import 'no3' */ import '@/lib/u'\nimport fs from 'fs'\nimport q from 'node:path'\nimport z from '@s/pkg/deep'\nimport w from 'shared/w'\nimport './gone'\nimport y from '#one'"
    clean = spark.createDataFrame([(text,)], "t string").select(imports.without_js_comments(F.col("t")).alias("t")).first()["t"]
    assert clean.split("\n")[0] == "const a = 'http://x'; " and len(clean.split("\n")) == len(text.split("\n")) and not any(f"no{k}" in clean for k in (1, 2, 3))
    configs = imports.path_configs(spark.createDataFrame([("web/tsconfig.json", '{ // c\n "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./*", "../other/*"], "#one": ["one.ts"],}, } }'), ("tsconfig.json", '{"compilerOptions":{"baseUrl":"."}}'), ("x/tsconfig.json", "{}")], "path string, text string"))
    found = imports.js_imports(code_text.lines(spark.createDataFrame([("web/src/app/m.ts", clean)], "file string, text string"), "file", "text"))
    files = spark.createDataFrame([(p,) for p in ("web/other/lib/u.ts", "web/src/shared/w/index.ts", "shared/w.ts", "web/src/one.ts")], "path string")
    got = {r.spec: (r.kind, r.target, r.package) for r in imports.resolved_js(found, files, configs).collect()}
    assert got == {
        "@/lib/u": ("local", "web/other/lib/u.ts", None), "fs": ("builtin", None, None), "node:path": ("builtin", None, None), "@s/pkg/deep": ("package", None, "@s/pkg"), "shared/w": ("local", "web/src/shared/w/index.ts", None),
        "./gone": ("unresolved", None, None), "#one": ("local", "web/src/one.ts", None),
    }


def test_exports_with_flows_and_analysis(spark):
    f = spark.createDataFrame([("s", 0, "r", "t", "high", "a.py", 1, 2, "x", [("a.py", 1, "from"), ("b.py", 2, "to")]), ("s", 1, "r", "t", "low", "a.py", 1, 2, "y", None)], "scan_id string, ord int, rule_id string, title string, severity string, file string, start int, end int, fingerprint string, trace array<struct<file:string,line:int,note:string>>")
    results = json.loads(code_text.sarif(f).first()["document"])["runs"][0]["results"]
    steps = results[0]["codeFlows"][0]["threadFlows"][0]["locations"]
    assert [(s["location"]["physicalLocation"]["artifactLocation"]["uri"], s["location"]["message"]["text"]) for s in steps] == [("a.py", "from"), ("b.py", "to")] and "codeFlows" not in results[1]
    nodes = spark.createDataFrame([("l", "k1", "npm", "a", "1.0.0"), ("l", "k2", "npm", "a", "2.0.0")], "lockfile string, key string, ecosystem string, name string, version string")
    advisories = spark.createDataFrame([("l", "A", "k2", "high", 9.8, "CVSS:3.1/x", None, "unreachable"), ("l", "A", "k1", "high", 9.8, "CVSS:3.0/x", None, "reachable"), ("l", "B", "k1", "low", None, None, "false_positive", "reachable")], "lockfile string, advisory string, key string, severity string, cvss double, vector string, triage string, reachability string")
    vulns = {v["id"]: v for v in json.loads(dependencies.cyclonedx(nodes, advisories).first()["document"])["vulnerabilities"]}
    assert vulns["A"]["analysis"] == {"state": "exploitable"} and vulns["A"]["ratings"] == [{"severity": "high"}] and len(vulns["A"]["affects"]) == 2 and vulns["B"]["analysis"] == {"state": "false_positive"}


def test_scrubbing(spark):
    token = "ghp" + "_" + "a1B2" * 9
    cases = {f"x {token} y": "x [REDACTED] y", "Authorization: Bearer abc.def": "Authorization: [REDACTED]", "authorization required": "authorization required", "Authorization='0123456789abcdef0'": "Authorization='[REDACTED]'", "plain": "plain"}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", scrub.scrub_log(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases
    m = spark.createDataFrame([({"apiKey": "v", "tokenCount": "3", "note": token},)], "m map<string,string>").select(scrub.scrub_map(F.col("m")).alias("m")).first()["m"]
    assert m == {"apiKey": "[REDACTED]", "tokenCount": "3", "note": "[REDACTED]"}
    path = spark.range(1).select(scrub.scrub_path(F.lit("src/" + "a1" * 10 + "/authentication-bypass/x.ts")).alias("p")).first()["p"]
    assert path == "src/[redacted]/authentication-bypass/x.ts"


def test_hunted_files_and_steps(spark):
    rows = [("a/.env.local", 5, "config", [], None, False), ("ci.yml", 5, "config", ["ci"], None, False), ("src/a.ts", 5, "source", [], None, True), ("src/b.ts", 5, "source", [], None, False), ("yarn.lock", 5, "lockfile", [], None, True), ("v.ts", 5, "source", [], "vendor", True), ("big.json", 10**7, "config", [], None, False)]
    got = {r.path: r.tier for r in reports.hunted_files(spark.createDataFrame(rows, "path string, size long, category string, tags array<string>, skip string, risky boolean")).collect()}
    assert got == {"a/.env.local": 0, "ci.yml": 1, "src/a.ts": 2}
    step = spark.range(1).select(reports.action_step(*(F.lit(x) for x in ("p", "1.0.0", "2.0.0", "upgrade-direct", "major", "npm install p@2.0.0", 2, True))).alias("s")).first()["s"]
    assert step.title == "Upgrade p 1.0.0 → 2.0.0" and step.effort == "hours" and step.detail == "Run `npm install p@2.0.0`. Resolves 2 advisories; may include breaking changes, so run your tests."
    counts = reports.zero_filled(spark.createDataFrame([("s", "high"), ("s", "high")], "scan string, severity string"), "scan", "severity", ("high", "low")).collect()
    assert {(r.severity, r.n) for r in counts} == {("high", 2), ("low", 0)}


def test_likeness_within_bounds(spark):
    import random

    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["ab", "abc", "b", "f(x)", "é"]) for _ in range(rng.randrange(0, 9)))
    pairs = [(a := text(), rng.choice([text(), a, a[:-1] + "z", " ".join(reversed(a.split(" ")))])) for _ in range(300)]
    a, b = F.col("a"), F.col("b")
    got = verification._likeness(a, b, verification._words(a), 0.8, F.lit(False))
    rows = spark.createDataFrame(pairs, "a string, b string").select(verification.similarity(a, b).alias("want"), got.alias("got")).collect()
    assert all(r.got == r.want if r.want >= 0.8 else r.got < 0.8 for r in rows) and sum(r.want >= 0.8 for r in rows) > 50

"""Operators on small tables with the shape of findings, dependencies and events."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievegrid.functions import severity as sev
from sievegrid.functions import text as tx
from sievegrid.operators import code_text, credentials, events, graph, matching, ranking, rollups, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_risk_and_visible_factors(spark):
    flags, none = {"is_live": F.lit(True), "is_low_confidence": F.lit(True)}, F.lit(None).cast("double")
    assert one(spark, sev.risk(F.lit("high"), none, flags)) == 68
    assert [(f["factor"], f["effect"]) for f in one(spark, sev.risk_factors(F.lit("high"), none, flags))] == [("live_credential", 23), ("low_confidence", -29)]
    assert one(spark, sev.risk(F.lit("low"), F.lit(9.8), {})) == 98
    assert one(spark, sev.risk(F.lit("critical"), none, {"is_live": F.lit(True)})) == 100
    both = lambda *names: one(spark, sev.risk(F.lit("medium"), none, {n: F.lit(True) for n in names}))
    assert both("is_public_route", "is_entrypoint") == 62 and both("is_entrypoint") == 57
    assert both("is_non_production", "is_generated") == 21 and both("is_live", "is_history_only") == 68 and both("is_history_only") == 39


def test_risk_flags(spark):
    schema = "file string, confidence string, liveness string, history_only boolean, reachability string, scope string, direct boolean, factors array<string>, want array<string>"
    rows = [
        ("src/tests/../test/a.ts", "low", "live", True, None, None, None, ["client_exposed", "x"], ["is_client_exposed", "is_history_only", "is_live", "is_low_confidence", "is_non_production"]),
        ("vendor/a.go", "medium", "revoked", False, "unknown", "dev", False, ["ai_unreviewed"], ["is_ai_unreviewed", "is_dev", "is_generated", "is_medium_confidence", "is_revoked", "is_transitive_unknown"]),
        ("a.ts", "high", None, False, "reachable", "prod", True, None, ["is_entrypoint", "is_reachable"]),
    ]
    df = spark.createDataFrame(rows, schema)
    flags = sev.risk_flags(F.struct(*(F.col(c) for c in df.columns[:7])), F.col("factors"), F.col("file") == "a.ts", F.lit(False))
    held = F.array_sort(F.array_compact(F.array(*(F.when(c, n) for n, c in flags.items()))))
    assert [r.held for r in df.select(held.alias("held"), "want").collect()] == [r[-1] for r in rows]
    contexts = {"a/fixtures/x.py": "test", "test/README.md": "test", "Example/a.py": "example", "a.MD": "docs", "docs/a.py": "docs", "a/vendor/b.js": "generated", "a/b.ts": "source", "latest/b.ts": "source"}
    got = spark.createDataFrame([(p,) for p in contexts], "p string").select("p", sev.file_context(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in got} == contexts


@pytest.mark.parametrize(("score", "malicious", "refuted", "live", "want"), [(120.0, 0, 0, 0, 100), (10.0, 1, 1, 0, 85), (50.0, 0, 1, 0, 14), (50.0, 0, 1, 1, 65), (-3.0, 0, 0, 0, 0), (70.0, 0, 0, 1, 70)])
def test_guards(spark, score, malicious, refuted, live, want):
    assert one(spark, sev.guarded(F.lit(score), F.lit(bool(malicious)), F.lit(bool(refuted)), F.lit(bool(live)))) == want


def test_severity_and_grade(spark):
    rows = spark.createDataFrame([(s,) for s in (85.0, 84.0, 65.0, 40.0, 15.0, 14.0)], "s double").select(sev.severity_from_score(F.col("s")).alias("x")).collect()
    assert [r.x for r in rows] == ["critical", "high", "high", "medium", "low", "info"]
    assert one(spark, sev.bump_severity(F.lit("critical"), 2)) == "medium" and one(spark, sev.bump_severity(F.lit("medium"), 2)) == "low" and one(spark, sev.bump_severity(F.lit("info"), 1)) == "info"
    grades = spark.createDataFrame([("a", "critical", True), ("b", "high", True), ("c", "high", False), ("d", "medium", True), ("e", "low", True)], "k string, s string, e boolean")
    assert {r.k: r.g for r in grades.groupBy("k").agg(sev.grade(F.col("s"), F.col("e")).alias("g")).collect()} == dict(a="F", b="D", c="C", d="B", e="A")


def test_cvss(spark):
    known = {"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1, "CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H": 10.0, "CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:N/I:N/A:N": 0.0, "CVSS:3.1/AV:N": None, "CVSS:2.0/AV:N/AC:L/Au:N": None, "": None}
    rows = spark.createDataFrame([(v,) for v in known], "v string").select("v", tx.cvss3(F.col("v")).alias("x")).collect()
    assert {r.v: r.x for r in rows} == known


def test_semver_order(spark):
    order = ["0.9.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.10", "1.2.0", "10.0.0"]
    rows = spark.createDataFrame([(v,) for v in reversed(order)] + [("x",)], "v string").withColumn("key", tx.semver(F.col("v")))
    assert [r.v for r in rows.where("key is not null").orderBy("key").collect()] == order
    jump = lambda a, b: one(spark, tx.semver_jump(tx.semver(F.lit(a)), tx.semver(F.lit(b))))
    assert (jump("1.0.0", "2.0.0"), jump("1.0.0", "1.1.0"), jump("0.1.0", "0.2.0"), jump("1.0.0", "1.0.1")) == ("major", "minor", "major", "patch")


def test_one_edit(spark):
    cases = {("lodash", "lodahs"): True, ("lodash", "lodas"): True, ("lodash", "lodaash"): True, ("lodash", "lodish"): True, ("lodash", "lodash"): False, ("lodash", "dolash"): False, ("ab", "ba"): True}
    rows = spark.createDataFrame(list(cases), "a string, b string").select("a", "b", tx.within_one_edit(F.col("a"), F.col("b")).alias("x")).collect()
    assert {(r.a, r.b): r.x for r in rows} == cases


def test_paths_and_redaction(spark):
    paths = {"src/a.tsx": "typescript", "Dockerfile.dev": "dockerfile", ".env.local": "env", "x/.gitignore": "other", "a/b.PY": "python"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", tx.language_of(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in rows} == paths
    assert one(spark, tx.tags_of(F.lit(".github/workflows/ci.yml"))) == ["ci"] and one(spark, tx.tags_of(F.lit("infra/tests/main.tf"))) == ["infra", "test"]
    for value in ("", "abc", "abcdefgh", "a" * 60):
        shown = one(spark, tx.redact(F.lit(value)))[1:]
        assert len(shown) <= len(value) / 4 and value.endswith(shown)
    assert one(spark, tx.entropy(F.lit("aabb"))) == 1.0 and one(spark, tx.entropy(F.lit(""))) == 0.0


def test_search(spark):
    rows = spark.createDataFrame([(1, "src/a.py", "SQL injection", "high"), (2, "src/b%c.py", "x", "low"), (3, "lib/a.py", "xss_sql", "high")], "id int, file string, title string, severity string")
    ids = lambda c: sorted(r.id for r in rows.where(c).collect())
    assert ids(search.match_clauses(equal={"severity": ["high"]}, file=("file", "src/"))) == [1]
    assert ids(search.match_clauses(text=(["title", "file"], "sql"))) == [1, 3]
    assert ids(search.match_clauses(file=("file", "*%*"))) == [2] and ids(search.match_clauses(text=(["title"], "_"))) == [3]
    assert search.decode_cursor(search.encode_cursor(250)) == 250
    for bad in ("!!", search.encode_cursor(-1), search.encode_cursor(2_000_000)):
        with pytest.raises(ValueError):
            search.decode_cursor(bad)
    counts = {(r.facet, r.value): r.n for r in search.facet_counts(rows, ["severity"]).collect()}
    assert counts == {("total", None): 3, ("severity", "high"): 2, ("severity", "low"): 1}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "d"), ("a", "d")], "src string, dst string")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    assert {(r.node, r.depth) for r in graph.closure(edges, node("a")).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 1)}
    assert {r.node for r in graph.ancestors(edges, node("d"), 1).collect()} == {"d", "c", "x", "a"}
    assert {(r.node, r.scope) for r in graph.scopes(node("a", "d", "x"), edges, node("x")).collect()} == {("a", "dev"), ("d", "prod"), ("x", "prod")}
    assert [r.path for r in graph.paths(edges, node("a"), node("d")).orderBy(F.size("path")).collect()] == [["a", "d"], ["a", "b", "c", "d"]]
    assert {r.node for r in graph.affected(node("d"), edges, node("b")).collect()} == {"d", "c", "x", "a", "b"}


FINDING = "id string, ord int, keys array<string>, category string, file string, start int, end int, cwe string, tail string, title string"


def test_matching(spark):
    base = spark.createDataFrame([("b1", 0, ["k1"], "sast", "f", 10, 10, "CWE-89", "sql-injection", "SQL injection in login"), ("b2", 1, ["k2"], "sast", "f", 12, 12, None, "sql-injection", "SQL injection in query"), ("b3", 2, ["k3", "k9"], "secret", "g", 1, 1, None, "aws", "key"), ("b4", 3, ["k4"], "sast", "gone", 1, 1, None, "xss", "t")], FINDING)
    head = spark.createDataFrame([("h1", 0, ["n1"], "sast", "f", 11, 11, "cwe-89 ", "sql-injection", "SQL injection in login form"), ("h2", 1, ["n2"], "sast", "f", 13, 13, None, "sql-injection", "other"), ("h3", 2, ["n3", "k9"], "secret", "g", 5, 5, None, "aws", "key"), ("h4", 3, ["n4"], "secret", "g", 1, 1, None, "aws", "key")], FINDING)
    got = {(r.head_id, r.base_id, r.how) for r in matching.matches(base, head).collect()}
    assert got == {("h3", "b3", "exact"), ("h1", "b1", "fuzzy"), ("h2", "b2", "fuzzy")}
    looked = spark.createDataFrame([("gone",)], "file string")
    assert {(r.id, r.status) for r in matching.scan_status(base, head, looked).collect()} == {("h1", "existing"), ("h2", "existing"), ("h3", "existing"), ("h4", "new"), ("b4", "fixed")}


def test_suppressions(spark):
    now = datetime(2024, 1, 2)
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), ("c", ["w"])], "id string, keys array<string>")
    sup = spark.createDataFrame([("y", "false_positive", None), ("x", "accepted", now), ("z", "accepted", datetime(2025, 1, 1))], "fingerprint string, status string, expires_at timestamp")
    assert {(r.id, r.status) for r in matching.suppressed(rows, sup, F.lit(now)).collect()} == {("a", "false_positive"), ("b", "accepted")}


def test_versions_and_recall(spark):
    v = spark.createDataFrame([("p", x) for x in ("1.0.0", "1.5.0", "2.0.0", "2.0.0-rc.1")], "package string, version string").withColumn("key", tx.semver(F.col("version")))
    i = spark.createDataFrame([("p", "A", None, "1.5.0", None), ("p", "B", "1.5.0", None, "2.0.0-rc.1")], "package string, advisory string, f string, t string, l string").select("package", "advisory", tx.semver(F.col("f")).alias("from_key"), tx.semver(F.col("t")).alias("to_key"), tx.semver(F.col("l")).alias("last_key"))
    assert {(r.version, r.advisory) for r in matching.affected_versions(v, i).collect()} == {("1.0.0", "A"), ("1.5.0", "B"), ("2.0.0-rc.1", "B")}
    want = spark.createDataFrame([("e1", "sast", "f", 10, 2, "CWE-89", "sql"), ("e2", "sast", "f", 90, 2, "CWE-1", "zz")], "expected_id string, category string, file string, line int, line_tolerance int, cwe string, rule_hint string")
    f = spark.createDataFrame([("f", 12, 12, None, "sql-injection")], "file string, start int, end int, cwe string, tail string")
    assert {(r.expected_id, r.found) for r in matching.recall(want, f).collect()} == {("e1", True), ("e2", False)}


def test_events(spark):
    rows = spark.createDataFrame([("s", i, t, i * 400) for i, t in enumerate(["run", "run", "done", "run"], 1)], "scan string, seq long, type string, at long")
    assert [r.seq for r in events.until_terminal(rows, "scan", "seq", F.col("type") == "done").orderBy("seq").collect()] == [1, 2, 3]
    assert [(r.type, r.started, r.ended) for r in events.timeline(rows, "scan", "seq", "type", "at").orderBy("seq").collect()] == [("run", 400, 1200), ("done", 1200, 1600), ("run", 1600, None)]
    near = spark.createDataFrame([("s", 1, 0, False), ("s", 2, 999, False), ("s", 3, 1000, False), ("s", 4, 1500, False), ("s", 5, 1600, True), ("s", 6, 2100, False), ("t", 1, 1700, False), (None, 1, 5, False)], "scan string, seq long, at long, final boolean")
    assert [(r.scan, r.seq) for r in events.throttled(near, "scan", "at", 1000, final="final").orderBy("scan", "seq").collect()] == [(None, 1), ("s", 1), ("s", 3), ("s", 5), ("t", 1)]
    import hashlib

    chain, prev = [], "0" * 64
    for i in range(6):
        h = hashlib.sha256((prev + f"p{i}").encode()).hexdigest()
        chain.append((i, prev, h, f"p{i}" if i != 4 else "forged"))
        prev = h
    log = spark.createDataFrame(chain, "seq int, prev string, hash string, payload string")
    breaks = lambda df, *by: sorted(r.seq for r in events.chain_breaks(df, "seq", "prev", "hash", "payload", "0" * 64, *by).collect())
    assert breaks(log) == [4] and breaks(log.where("seq <> 2")) == [3, 4] and breaks(log.where("seq > 0")) == [1, 4]
    two = log.withColumn("log", F.lit("a")).union(log.where("seq < 3").withColumn("log", F.lit(None)))
    assert breaks(two, "log") == [4] and breaks(log.limit(0)) == []
    own = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, "z")], "log string, seq long, payload string")
    sealed = events.chained(own, "log", "seq", "payload", "0" * 64).withColumnsRenamed({"prev_hash": "prev"})
    assert sealed.count() == 3 and breaks(sealed, "log") == []
    said = spark.createDataFrame([("s", 1, "c", "m", "x"), ("s", 2, "c", "m", "y"), ("s", 3, "c", "n", "z")], "scan string, seq int, code string, message string, stage string")
    assert {(r.message, r.stage) for r in events.warnings_once(said, "scan", "seq").collect()} == {("m", "x"), ("n", "z")}


def test_rollups(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 9, 9), ("b", 1, 1)], "f string, s int, e int")
    assert {tuple(r) for r in rollups.merged_ranges(rows, "f", "s", "e").collect()} == {("a", 1, 5), ("a", 9, 9), ("b", 1, 1)}
    table = {r.f: r.asDict() for r in rollups.crosstab(rows.withColumn("s", F.col("s").cast("string")), "f", "s", ["1", "4", "7"]).collect()}
    assert table["a"] == {"f": "a", "1": 1, "4": 1, "7": 0}


def test_duplicate_blocks(spark):
    block = "\n".join(f"statement number {i};" for i in range(8))
    files = spark.createDataFrame([("a", "head\n" + block), ("b", block + "\n\ntail"), ("c", "nothing"), ("d", None)], "path string, text string")
    assert [tuple(r) for r in code_text.duplicate_blocks(files, "path", "text").collect()] == [("a", 2, "b", 1, 8)]


def test_located(spark):
    lines = spark.createDataFrame([("f", i, c) for i, c in enumerate(["import os", "def run(cmd):", "    os.system(cmd)", "x = 1", "y = eval(data)"], 1)], "file string, line int, content string")
    issues = spark.createDataFrame([("near", "f", 2, "os.system( cmd)"), ("moved", "f", 1, "y = eval(data)"), ("absent", "f", 1, "subprocess.run(x)")], "issue string, file string, line int, snippet string")
    assert {(r.issue, r.line, r.status) for r in code_text.located(issues, lines).collect()} == {("near", 3, "verified"), ("moved", 5, "relocated")}


def test_credentials_never_leave(spark):
    import random

    rng = random.Random(1)
    letters = "abcdefghjkmnpqrstuvwyzABCDEFGHJKMNPQRSTUVWYZ23456789"
    token = "ghp" + "_" + "".join(rng.choice(letters) for _ in range(36))
    key = "AK" + "IA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVW234567") for _ in range(16))
    files = spark.createDataFrame([("a", f"x = '{token}'\n\nk = {key}"), ("b", "ghp" + "_" + "x" * 36), ("c", None)], "path string, text string")
    rows = credentials.credentials(files, "path", "text").collect()
    assert {(r.path, r.line, r.type) for r in rows} == {("a", 1, "github-token"), ("a", 3, "aws-access-key")}
    assert not any(token in str(r) or key in str(r) for r in rows)


def test_sarif(spark):
    f = spark.createDataFrame([("s", 0, "r1", "first", "high", "a.py", 1, 2, "x"), ("s", 1, "r1", "second", "low", "b.py", 3, 3, "y")], "scan_id string, ord int, rule_id string, title string, severity string, file string, start int, end int, fingerprint string")
    run = json.loads(code_text.sarif(f).first()["document"])["runs"][0]
    assert [r["level"] for r in run["results"]] == ["error", "note"] and run["tool"]["driver"]["rules"] == [{"id": "r1", "shortDescription": {"text": "first"}}]


def test_ranks_of_a_hot_group(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise(F.lit(None)).alias("g"), F.pmod(F.col("id") * 7, F.lit(500)).alias("v"))
    got = ranking.ranked(rows, ["g"], ["v"]).collect()
    for g in ("hot", None):
        own = sorted((r.v, r["rank"]) for r in got if r.g == g)
        assert [x for _, x in own] == list(range(len(own)))


def test_streaming_fold(spark, tmp_path):
    from sievegrid.streaming import folds

    schema = "scan_id string, seq long, type string, payload string, at timestamp"
    at = datetime(2024, 1, 1)
    spark.createDataFrame([("s", 1, "stage", "a", at), ("s", 2, "stage", "b", at), ("s", 2, "stage", "b", at), ("t", 1, "done", "z", at)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = folds.latest(live).writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select scan_id, type, seq, taken, payload from folded").collect()} == {("s", "stage", 2, 2, "b"), ("t", "done", 1, 1, "z")}
    q = folds.once(live).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from once").count() == 3

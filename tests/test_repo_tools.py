"""Names, paths and looks into repositories."""

import random
import re

import pytest

from pyspark.sql import functions as F

from sievegrid.functions import repo
from sievegrid.operators import repo_tools as tools


def values(spark, cases, f):
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select("v", f(F.col("v")).alias("x")).collect()
    return {r.v: r.x for r in rows}


def test_names_and_paths(spark):
    urls = {"https://github.com/a-b/c.d.git": ("a-b", "c.d"), "https://github.com/a/b/": ("a", "b"), "https://github.com/-a/b": None, "https://github.com/a/..": None, "http://github.com/a/b": None, "https://github.com/a/b/c": None}
    assert {k: tuple(v) if v else None for k, v in values(spark, urls, repo.repo_of_url).items()} == urls
    refs = {"main": True, "feature/x-1": True, "-u./evil": False, "a..b": False, "a//b": False, "a/": False, "a.lock": False, "a b": False, "@{x}": False}
    assert values(spark, refs, repo.valid_ref) == refs
    paths = {"a/./b//c": "a/b/c", "": "", "/a": None, "a/../b": None, "C:/x": None, "a\\b": None, ".GIT/config": None, "a.git/x": "a.git/x"}
    assert values(spark, paths, repo.confined_path) == paths
    ids = {"SQL Injection": "taint/sql-injection", "sast/sqlInjection": "taint/sql-injection", "//": "taint/tainted-flow", "taint/x_y": "taint/x-y"}
    assert values(spark, ids, repo.taint_rule_id) == ids
    assert values(spark, ["config/a", "Open Port!", "--"], repo.config_rule_id) == {"config/a": "config/a", "Open Port!": "config/open-port", "--": "config/issue"}
    roots = {"@s/p/x": "@s/p", "p/x/y": "p", "p": "p", "@s": "@s"}
    assert values(spark, roots, repo.package_root) == roots
    env = "# c\nA=secret\nexport B = 'quoted'\nC=\nD=ab\nnothing\n"
    assert values(spark, [env], repo.redacted_env)[env] == "# c\nA=se…\nB=qu…\nC=\nD=…\nnothing\n"
    yaml = {"apiVersion: v1\nkind: Pod\n": True, "a:\n  apiVersion: v1\n  kind: x": False, "kind: x": False}
    assert values(spark, yaml, repo.is_kubernetes_manifest) == yaml
    assert values(spark, ["call foo.bar() or `baz` and foo.bar()"], repo.mentioned_functions) == {"call foo.bar() or `baz` and foo.bar()": ["foo.bar", "baz"]}
    maps = spark.createDataFrame([({"b": "1", "a": "2"},)], "m map<string,string>").select(repo.canonical_map(F.col("m")).alias("x")).first()["x"]
    assert maps == '{"a":"2","b":"1"}'
    factor = "array<struct<factor:string,effect:int,reason:string>>"
    merged = spark.createDataFrame([([("a", 1, "own"), ("b", 2, "own")], [("b", 5, "score"), ("c", 3, "score")])], f"x {factor}, y {factor}").select(repo.merged_factors(F.col("x"), F.col("y")).alias("m")).first()["m"]
    assert [tuple(f) for f in merged] == [("a", 1, "own"), ("b", 5, "own"), ("c", 3, "score")]


def test_globs():
    cases = {"**/*.ts": (["a.ts", "x/y/a.ts"], ["a.tsx"]), "src/*": (["src/a"], ["src/a/b"]), "a?.{js,ts}": (["ab.js", "ab.ts"], ["a.js", "a/.js", "ab.tsx"]), "src/**": (["src/a/b"], ["srcx"]), "a+b(c)": (["a+b(c)"], ["aab"])}
    for glob, (yes, no) in cases.items():
        pattern = re.compile(repo.glob_pattern(glob))
        assert all(pattern.search(p) for p in yes) and not any(pattern.search(p) for p in no), glob


def test_looks_into_files(spark):
    files = spark.createDataFrame([(p,) for p in ("a/b.ts", "a/c/d.ts", "a/c/e.ts", "ab/x", "r.md")], "path string")
    assert {tuple(r) for r in tools.children(files, "a").collect()} == {("b.ts", False), ("c", True)} and {tuple(r) for r in tools.children(files, "").collect()} == {("a", True), ("ab", True), ("r.md", False)}
    rows = [("a.ts", 1, "import run from 'x'"), ("a.ts", 2, "lib.run(1); rerun()"), ("b.py", 1, "run (2)"), ("c.py", 1, "go(run)")]
    lines = spark.createDataFrame(rows, "file string, line int, content string")
    places = lambda df: {(r.file, r.line) for r in df.collect()}
    assert places(tools.grep(lines, "run(", "*.ts")) == {("a.ts", 2)} and places(tools.grep(lines, r"^run\s", regex=True)) == {("b.py", 1)}
    assert places(tools.line_slice(lines, spark.createDataFrame([("a.ts", 2, 9), ("b.py", 3, 1)], "file string, start int, end int"))) == {("a.ts", 2)}
    assert places(tools.references(lines, spark.createDataFrame([("run",)], "name string"))) == {("a.ts", 1), ("a.ts", 2), ("b.py", 1), ("c.py", 1)}
    symbols = spark.createDataFrame([("f", "pkg.run"), ("f", "run")], "finding_id string, symbol string")
    assert places(tools.call_sites(lines, symbols)) == {("a.ts", 2), ("b.py", 1)} and places(tools.call_sites(lines, symbols, most_files=1)) == {("a.ts", 2)}
    edges = spark.createDataFrame([("a", "local", "b", None), ("a", "package", None, "p"), ("c", "local", "b", None)], "file string, kind string, target string, package string")
    assert {r.file: (r.imports, r.packages, r.importers) for r in tools.import_table(edges).collect()} == {"a": (["b"], ["p"], []), "b": ([], [], ["a", "c"]), "c": (["b"], [], [])}


def test_commits_usages_and_reasons(spark):
    commits = spark.createDataFrame([("m", "a"), ("m", "b"), ("a", "r"), ("b", "r"), ("r", None), ("z", None)], "commit string, parent string")
    pairs = spark.createDataFrame([("r", "m"), ("a", "m"), ("a", "b"), ("z", "m"), ("m", "m"), ("gone", "m")], "base string, head string")
    got = {(r.base, r.head): r.ancestor for r in tools.is_ancestor(commits, pairs).collect()}
    assert got == {("r", "m"): True, ("a", "m"): True, ("a", "b"): False, ("z", "m"): False, ("m", "m"): True, ("gone", "m"): None}
    usages = spark.createDataFrame([("r", "b", 1, "p", None, "call"), ("r", "a", 2, "p", "s", "call"), ("r", "a", 2, "p", "s", "call")], "repo string, file string, line int, package string, symbol string, kind string")
    assert [(r.file, r.place) for r in tools.usages_once(usages).orderBy("place").collect()] == [("a", 1), ("b", 2)] and tools.usages_once(usages, 1).count() == 1
    failures = spark.createDataFrame([("s", "other"), ("s", "budget"), ("s", "timeout"), ("s", "timeout")], "scan string, reason string")
    assert tools.failure_reasons(failures, ("timeout", "budget")).first()["said"] == "2 timeout, 1 budget, 1 other"


def test_ancestors_of_random_histories(spark):
    rng, commits, above = random.Random(6), [], {}
    for i in range(120):
        parents = rng.sample(range(max(0, i - 9), i), min(i, rng.choice([0, 1, 1, 1, 2, 3])))
        commits += [(i, p) for p in parents] or [(i, None)]
        above[i] = {i}.union(*(above[p] for p in parents))
    pairs = [(rng.randrange(-2, 122), rng.randrange(-2, 122)) for _ in range(400)]
    got = {(r.base, r.head): r.ancestor for r in tools.is_ancestor(spark.createDataFrame(commits, "commit long, parent long"), spark.createDataFrame([*pairs, *pairs[:5]], "base long, head long")).collect()}
    assert got == {(b, h): (b in above[h]) if b in above and h in above else None for b, h in pairs}


def test_a_long_line_takes_few_rounds(spark, monkeypatch):
    rounds, write = [], tools.materialize
    monkeypatch.setattr(tools, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    n = 100_000
    commits = spark.range(n).selectExpr("id as commit", "nullif(id - 1, -1L) as parent")
    pairs = spark.createDataFrame([(0, n - 1), (n - 1, 0), (5, n // 2)], "base long, head long")
    assert {(r.base, r.ancestor) for r in tools.is_ancestor(commits, pairs).collect()} == {(0, True), (n - 1, False), (5, True)}
    assert rounds.count("lines") < 20 and rounds.count("walk") <= 2


@pytest.mark.parametrize("most", [32 << 20, 300])
def test_names_in_texts(spark, monkeypatch, most):
    monkeypatch.setattr(tools, "AUTOMATON_BYTES", most)
    rng = random.Random(2)
    names = ["a", "ab", "@s/a", "left-pad", "ba", "a.b", "é", "aa", "", None, "ab"]
    texts = [(i, "".join(rng.choice(["a", "b", "@s/a", " ", "left-pad", ".", "_", "é", "1"]) for _ in range(30))) for i in range(40)] + [(99, None), (100, "")]
    frame, asked = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    for whole in (True, False):
        want = {}
        for i, t in texts:
            for n in {x for x in names if x}:
                left, right = (r"(?<![\w$])" if whole and re.match(r"[\w$]", n[0]) else ""), (r"(?![\w$])" if whole and re.match(r"[\w$]", n[-1]) else "")
                if count := len(re.findall(f"{left}(?={re.escape(n)}{right})", t or "")):
                    want[n, i] = count
        assert {(r["name"], r["id"]): r["n"] for r in tools.names_in(frame, asked, "id", "text", whole).collect()} == want

"""Functions of files, node tables of YAML, and what rests on them."""

import random

from sievegrid.functions import yaml_tree
from sievegrid.operators import config_rules, function_metrics

SCRIPTS = {
    "a": ("function add(a, b) {\n  return a + b;\n}\n", {("add", 1, 3, 0, 0)}),
    "b": ('const handler = (req, res) => {\n  res.send("ok");\n};\n\nconst obj = {\n  method() {\n    return 1;\n  },\n};', {("handler", 1, 3, 0, 0), ("method", 6, 8, 0, 0)}),
    "c": ("class A extends B {\n  constructor(x) { super(x); }\n  get size() { return 1; }\n  static async run(a: string): Promise<void> {\n    if (a) return;\n    a.b = function () {\n switch (x) { case 1: break; }\n };\n  }\n}\n", {("constructor", 2, 2, 0, 0), ("get size", 3, 3, 0, 0), ("run", 4, 9, 1, 1), ("b", 6, 8, 1, 1)}),
    "d": ("const t = async (a) => { try { go(); } catch (e) { if (e) { no(); } } finally { end(); } };", {("t", 1, 1, 3, 3)}),
    "e": ('let s = "if (x) { \\" }"; // if (\n/* function no() {\n} */ foo(`a ${b} {`, /[/{]\\//g);\r\nx.if = { while: 1 };\n', set()),
    "f": ("", set()), "g": (None, set()), "h": ("}}} ((( {", set()),
}


def test_functions_of_scripts(spark):
    made = function_metrics.script_functions(spark.createDataFrame([(k, t) for k, (t, _) in SCRIPTS.items()], "path string, text string"), "path", "text").collect()
    for path, (_, want) in SCRIPTS.items():
        assert {(r.name, r.start_line, r.end_line, r.nesting, r.branches) for r in made if r.path == path and r.name} == want, path
    assert all(r.length == r.end_line - r.start_line + 1 for r in made if r.name)
    assert function_metrics.script_functions(spark.createDataFrame([], "path string, text string"), "path", "text").count() == 0


def test_long_strings_of_escapes(spark):
    text = 'x = "' + '\\"{' * 200_000 + '";\nfunction f() { if (y) { z(); } }\n/*' + "{ " * 300_000 + "*/"
    made = function_metrics.script_functions(spark.createDataFrame([("a", text)], "path string, text string"), "path", "text").collect()
    assert {(r.name, r.start_line, r.nesting) for r in made if r.name} == {("f", 2, 1)}


def plain_python(text):
    """Functions by ends that are looked up line by line."""
    rows = [(i, len(x) - len(x.lstrip()), x.strip()) for i, x in enumerate(text.split("\n"), 1) if x.strip() and not x.strip().startswith("#")]
    last = {}
    for at, (line, indent, _) in enumerate(rows):
        under = [r[0] for r in rows[at + 1 :]]
        stop = next((k for k, r in enumerate(rows[at + 1 :]) if r[1] <= indent), len(under))
        last[line] = under[stop - 1] if stop else line
    functions = [(line, last[line], c.split("def ")[1].split("(")[0]) for line, _, c in rows if c.startswith(("def ", "async def "))]
    out = set()
    for start, end, name in functions:
        own = [(line, last[line]) for line, _, c in rows if c.split(" ")[0].rstrip(":") in ("if", "for", "else", "try") and start < line <= end and max((s for s, e, _ in functions if s < line <= e), default=0) == start]
        out.add((name, start, end, max((sum(a <= line <= b for a, b in own) for line, _ in own), default=0), len(own)))
    return out


def test_functions_of_python_files(spark):
    rng, files = random.Random(3), []
    for k in range(40):
        lines, depth = [], 0
        for i in range(rng.randrange(1, 40)):
            head = rng.choice([f"def f{i}():", f"async def g{i}(a):", "if x:", "for y in z:", "else:", "try:", "call()", "# def no():", "", "class C:"])
            lines.append("    " * depth + head if head else "")
            depth = depth + 1 if head.endswith(":") and not head.startswith("#") else rng.randrange(depth + 1)
        files.append((f"p{k}", "\n".join(lines)))
    made = function_metrics.python_functions(spark.createDataFrame([*files, ("n", None)], "path string, text string"), "path", "text").collect()
    for path, text in files:
        assert {(r.name, r.start_line, r.end_line, r.nesting, r.branches) for r in made if r.path == path and r.name} == plain_python(text), text


def test_yaml_nodes():
    text = "a:\n- x: 1 # c\n  y: 'it''s'\n-\n  - deep\n- |\n  b: c\n\n  d\nb: {p: [1, {q: \"r, s\"}], t: }\nc: >-\n   folded\n   more\n? odd\nd: [1, # c\n  2]\ne: plain\n  goes on\n---\nf: http://u/v:1\n'g@1': {}\n"
    got = [(n[1], n[2], n[3], n[4]) for n in yaml_tree.nodes(text)]
    assert got == [
        (0, "a", None, None), (1, None, 0, None), (2, "x", None, "1"), (2, "y", None, "it's"), (1, None, 1, None), (5, None, 0, "deep"), (1, None, 2, "b: c\n\nd"),
        (0, "b", None, None), (8, "p", None, None), (9, None, 0, "1"), (9, None, 1, None), (11, "q", None, "r, s"), (8, "t", None, None), (0, "c", None, "folded\nmore"),
        (0, "d", None, None), (15, None, 0, "1"), (15, None, 1, "2"), (0, "e", None, "plain goes on"), (0, "f", None, "http://u/v:1"), (0, "g@1", None, None),
    ]


def test_workflows_of_other_shapes(spark):
    head = "on:\n  - pull_request_target\njobs:\n  a:\n    steps:\n"
    texts = {
        "own": head + "      - name: x\n        with: {ref: '${{ github.head_ref }}', b: c}\n        uses: actions/checkout@v4\n",
        "other": head + "      - uses: actions/checkout@v4\n      - uses: ./x\n        with:\n          ref: ${{ github.head_ref }}\n",
        "safe": head.replace("_target", "") + "      - uses: actions/checkout@v4\n        with:\n          ref: ${{ github.head_ref }}\n",
        "scoped": head.replace("  a:\n", "  a:\n    permissions:\n      contents: read\n") + "      - uses: docker://x\n      - uses: github/codeql@v1\n",
        "broken": "on: [pull_request_target\n{{{ : :\n- - -\n\t\x00", "list": "- a\n- b\n", "huge": "a: [" * 20_000 + "\n" + "- " * 20_000 + "x",
    }
    files = spark.createDataFrame([(f"r/.github/workflows/{k}.yaml", t) for k, t in texts.items()], "path string, text string")
    got = {(r.path.split("/")[-1][:-5], r.line, r.rule.removeprefix("config/gha-")) for r in config_rules.workflow_issues(files).collect()}
    assert {g for g in got if g[0] not in ("broken", "huge")} == {("own", 6, "pull-request-target-checkout"), ("own", 1, "excessive-permissions"), ("other", 1, "excessive-permissions")}


def test_functions_of_scripts_move_no_tokens(spark):
    files = spark.createDataFrame([(k, t) for k, (t, _) in SCRIPTS.items()], "path string, text string")
    made = function_metrics.script_functions(files, "path", "text")
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Union" not in plan  # the texts alone are dealt out
    first = spark.createDataFrame([("x", "x => x + 1;"), ("y", "(a) => { if (a) b(); }")], "path string, text string")
    assert {(r.path, r.nesting, r.branches) for r in function_metrics.script_functions(first, "path", "text").collect() if r.name} == {("x", 0, 0), ("y", 1, 1)}


def test_workflow_rules_broadcast_and_join_nothing(spark):
    text = "on:\n  pull_request_target:\njobs:\n  a:\n    permissions: write-all\n    steps:\n      - uses: actions/checkout@v4\n        with:\n          ref: ${{ github.head_ref }}\n      - uses: x/y@v1\n      - run: |\n          echo ${{ github.head_ref }} ${{ github.head_ref }}\n"
    files = spark.createDataFrame([("r/.github/workflows/a.yml", text), ("r/a.yml", text)], "path string, text string")
    made = config_rules.workflow_issues(files)
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange") == 2  # texts, and the nodes that rules ask for
    assert sorted((r.line, r.rule.removeprefix("config/gha-")) for r in made.collect()) == [(5, "excessive-permissions"), (7, "pull-request-target-checkout"), (10, "unpinned-action"), (12, "script-injection"), (12, "script-injection")]

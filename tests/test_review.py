"""Imports, line rules, carried findings, workflow rules, private keys and yarn lockfiles."""

from sievegrid.operators import config_rules, credentials, dependencies as dep, imports, review


def lines(spark, **files):
    rows = [(f, k + 1, c) for f, text in files.items() for k, c in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line int, content string")


def test_imports(spark):
    js = "import a from './b'\nimport '../x/./c.js';\n// import z from './no'\nconst q = require(\"pkg/sub\"), r = await import('../../../out')\nexport * from './d'"
    found = imports.js_imports(lines(spark, **{"src/app/main.ts": js}))
    assert {(r.line, r.spec) for r in found.collect()} == {(1, "./b"), (2, "../x/./c.js"), (4, "pkg/sub"), (4, "../../../out"), (5, "./d")}
    files = spark.createDataFrame([("src/app/b.js",), ("src/app/b.tsx",), ("src/x/c.js",), ("src/app/d/index.ts",), ("out.ts",)], "path string")
    assert {(r.spec, r.target) for r in imports.resolved(found, files).collect()} == {("./b", "src/app/b.tsx"), ("../x/./c.js", "src/x/c.js"), ("./d", "src/app/d/index.ts")}
    py = "from .a.b import c\nimport os, x.y as z  # why\nfrom .. import d\nimporting = 1\nfrom json import loads"
    assert {(r.line, r.spec) for r in imports.py_imports(lines(spark, f=py)).collect()} == {(1, ".a.b"), (2, "os"), (2, "x.y"), (3, ".."), (5, "json")}
    names = spark.createDataFrame([(1, "a.b.c"), (2, "a.bc"), (3, "zz"), (4, None), (5, "")], "id long, name string")
    packages = spark.createDataFrame([("a",), ("a.b",), ("a.b",), (None,)], "package string")
    assert {tuple(r) for r in imports.owners(names, packages, ".").collect()} == {(1, "a.b"), (2, "a")}


def test_line_rules(spark):
    cases = {
        "x = eval(y)": "code-injection", "re.eval(y)": None, "eval('1')": None, "ok": None, "exec(cmd); el.innerHTML = 1": "command-injection", "exec('ls')": None, "os.system('rm ' + path)": "command-injection",
        "yaml.load(f, Loader=yaml.SafeLoader)": None, "yaml.load(f)": "unsafe-yaml", "pickle.loads(data)": "unsafe-deserialization", "hashlib.md5(x)": "weak-crypto", "createHash('sha1')": "weak-crypto", "md5": None,
        "db.query('select ' + name)": "sql-injection", "db.query(`select ${name}`)": "sql-injection", "db.query('select ?', [name])": None, "cur.execute(f'select {x}')": "sql-injection",
        "el.innerHTML == 1": None, "el.innerHTML = html": "xss", "res.redirect(req.query.next)": "open-redirect", "res.redirect('/home')": None, "await fetch(req.body.url)": "ssrf", "requests.get(request.args['u'])": "ssrf",
    }
    made = {r.line: r.rule_id for r in review.rule_hits(lines(spark, f="\n".join(cases))).collect()}
    assert {c: made.get(i, "/").split("/")[1] or None for i, c in enumerate(cases, 1)} == cases
    some = review.rule_hits(lines(spark, f="eval(x)\n" * 20, g="eval(x)"), most=3).collect()
    assert {(r.file, r.line, r.truncated) for r in some} == {("f", 1, True), ("f", 2, True), ("f", 3, True), ("g", 1, False)}


def test_upsert_takes_nulls_of_changes(spark):
    base = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "k int, v string, w int")
    made = review.upserted(base, spark.createDataFrame([(2, None, None), (3, "c", 1)], "k int, v string, w int"), ["k"])
    assert {tuple(r) for r in made.collect()} == {(1, "a", 2), (2, None, None), (3, "c", 1)}


def test_workflows(spark):
    W = ".github/workflows/"
    bad = "on: [pull_request_target]\njobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n        with:\n          ref: ${{ github.event.pull_request.head.sha }}\n      - uses: some/thing@v1\n      - uses: other/thing@" + "a" * 40 + "\n      - run: |\n          echo ${{ github.event.issue.title }}\n\n          echo ${{ github.sha }}\n      - name: ${{ github.head_ref }}\n      - run: echo ${{ github.event.commits.x.message }}"
    files = spark.createDataFrame([(W + "bad.yml", bad), (W + "all.yml", "on: push\npermissions: write-all\n"), (W + "good.yml", "on: push\njobs: {}"), (W + "none.yml", None)], "path string, text string")
    got = {(r.path, r.line, r.rule.removeprefix("config/gha-")) for r in config_rules.workflow_issues(files).collect()}
    assert got == {(W + "bad.yml", 8, "unpinned-action"), (W + "bad.yml", 11, "script-injection"), (W + "bad.yml", 15, "script-injection"), (W + "bad.yml", 5, "pull-request-target-checkout"), (W + "bad.yml", 1, "excessive-permissions"), (W + "all.yml", 2, "excessive-permissions")}


def test_private_keys(spark):
    body = "\n".join(["QUJD" * 16] * 3)
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    rows = [(1, f"a\nb {key}\n{key}\n"), (2, key.replace("END RSA", "END EC")), (3, "-----BEGIN PRIVATE KEY-----\nshort\n-----END PRIVATE KEY-----"), (4, None), (5, key.replace("RSA ", ""))]
    got = {(r.id, r.line) for r in credentials.private_keys(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {(1, 2), (5, 1)}


def test_yarn_lock(spark):
    first = '# yarn lockfile v1\n\n\n"@s/a@^1.0", "@s/a@1.x":\n  version "1.2.0"\n  resolved "https://registry.yarnpkg.com/a.tgz#x"\n  dependencies:\n    b "^2"\n    "@s/c" ">=1"\n  optionalDependencies:\n    z "1"\n\nb@^2:\n  version "2.1.0"\n'
    berry = '__metadata:\n  version: 6\n\n"a@npm:^1":\n  version: 1.0.0\n  resolution: "a@npm:1.0.0"\n  dependencies:\n    b: ^2\n  languageName: node\n\n"b@npm:^2, b@npm:^2.1":\n  version: 2.1.0\n\n"root@workspace:.":\n  version: 0.0.0-use.local\n'
    nodes = dep.yarn_packages(spark.createDataFrame([("yarn.lock", first), ("x/yarn.lock", berry), ("n/yarn.lock", None)], "path string, text string"))
    assert {(r.lockfile, r.key) for r in nodes.collect()} == {("yarn.lock", "@s/a@1.2.0"), ("yarn.lock", "b@2.1.0"), ("x/yarn.lock", "a@1.0.0"), ("x/yarn.lock", "b@2.1.0")}
    assert {tuple(r) for r in dep.yarn_edges(nodes).collect()} == {("yarn.lock", "@s/a@1.2.0", "b@2.1.0"), ("x/yarn.lock", "a@1.0.0", "b@2.1.0")}


def test_pnpm_lock(spark):
    nine = "lockfileVersion: '9.0'\n\nimporters:\n  .:\n    dependencies:\n      a:\n        specifier: ^1\n        version: 1.0.0\n\npackages:\n\n  '@s/c@2.0.0':\n    resolution: {integrity: x}\n\n  a@1.0.0:\n    resolution: {integrity: y}\n    engines: {node: '>=8'}\n\nsnapshots:\n\n  '@s/c@2.0.0': {}\n\n  a@1.0.0(p@3.0.0):\n    dependencies:\n      '@s/c': 2.0.0\n      alias: '@s/c@2.0.0'\n      away: link:../away\n    optionalDependencies:\n      gone: 1.0.0\n"
    six = "lockfileVersion: '6.0'\npackages:\n\n  /a@1.0.0(p@3.0.0):\n    resolution: {integrity: y}\n    dependencies:\n      b: 2.0.0\n    dev: true\n\n  /b@2.0.0:\n    dev: false\n"
    nodes = dep.pnpm_packages(spark.createDataFrame([("pnpm-lock.yaml", nine), ("x/pnpm-lock.yaml", six), ("n/pnpm-lock.yaml", None)], "path string, text string"))
    assert {(r.lockfile, r.name, r.version, r.dev) for r in nodes.collect()} == {("pnpm-lock.yaml", "@s/c", "2.0.0", False), ("pnpm-lock.yaml", "a", "1.0.0", False), ("x/pnpm-lock.yaml", "a", "1.0.0", True), ("x/pnpm-lock.yaml", "b", "2.0.0", False)}
    assert {tuple(r) for r in dep.pnpm_edges(nodes).collect()} == {("pnpm-lock.yaml", "a@1.0.0", "@s/c@2.0.0"), ("x/pnpm-lock.yaml", "a@1.0.0", "b@2.0.0")}


def test_verdicts(spark):
    text = "p = path.basename(x)\n" + "\n" * 5 + "send(p)\nsend(q)\nif (u.startsWith('/')) go(u)\n"
    safe = "if (u.startsWith('/') && !u.startsWith('//')) go(u)\nx = escapeHtml(y)"
    files = lines(spark, **{"a.js": text, "tests/a.js": "send(q)", "b.js": safe})
    rows = [("near", "a.js", 7, 7), ("far", "a.js", 8, 8), ("half", "a.js", 9, 9), ("tested", "tests/a.js", 1, 1), ("both", "b.js", 1, 2), ("gone", "c.js", 1, 1)]
    got = {r.id: (r.verdict, r.evidence) for r in review.verdicts(spark.createDataFrame(rows, "id string, file string, start int, end int"), files).collect()}
    assert got == {"near": ("refuted", 1), "far": ("upheld", None), "half": ("upheld", None), "tested": ("weakened", None), "both": ("refuted", 1), "gone": ("upheld", None)}

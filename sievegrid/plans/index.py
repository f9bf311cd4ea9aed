"""Repository index and review queries: parts as trees of files, orders and line items as findings to review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegrid.functions import repo
from sievegrid.operators import code_text, config_rules, dependencies, imports, repo_index, repo_tools, review, verification
from sievegrid.plans.registry import query
from sievegrid.sources.tables import table

#: Paths by p_partkey % 14, their category and why they are skipped (null: they are read). A package.json stands in "web", so "web/dist" is vendored.
_PATHS = (
    ("src/a.ts", "source", None), ("web/dist/a.js", "source", "vendor"), ("lib/dist/a.py", "source", None), ("node_modules/x/i.js", "source", "vendor"), ("img/logo.PNG", "other", "binary"), ("web/package.json", "config", None),
    ("yarn.lock", "lockfile", None), ("requirements-dev.txt", "lockfile", None), ("static/app.min.js", "source", "minified"), ("docs/read.md", "doc", None), ("apps/one/build/b.js", "source", "vendor"), ("Makefile", "config", None),
    ("gen/made.ts", "source", "generated"), ("link.txt", "doc", "symlink"),
)


def _case(i: int) -> str:
    return "CASE p_partkey % 14 " + " ".join(f"WHEN {k} THEN '{row[i]}'" for k, row in enumerate(_PATHS) if row[i]) + " END"


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    made = part.selectExpr("p_brand AS repo", f"{_case(0)} AS path").distinct()
    # each repository has web's manifest
    made = made.union(made.select("repo", F.lit("web/package.json"))).distinct()
    tree = made.select("repo", "path", F.when(F.col("path") == "link.txt", "120000").otherwise("100644").alias("mode"), F.lit("blob").alias("kind"), F.concat("repo", F.lit(":"), "path").alias("blob"))
    head = F.when(F.col("path") == "gen/made.ts", "// Code generated by x. DO NOT EDIT\nlet a").otherwise("text\n")
    return tree, tree.select("blob", F.length("path").cast("long").alias("size"), head.alias("head")).distinct()


_FILES = f"SELECT p_brand AS repo, {_case(0)} AS path, {_case(1)} AS category, {_case(2)} AS skip FROM part UNION SELECT p_brand, 'web/package.json', 'config', NULL FROM part"


@query(_FILES)
def indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_index.indexed(*_tree(spark, sf_dir)).select("repo", "path", "category", "skip")


@query(f"""
    WITH f AS ({_FILES})
    SELECT repo, count(*) AS files, count(*) FILTER (skip IS NULL) AS read, CAST(coalesce(sum(length(path)) FILTER (skip IS NULL OR skip = 'generated'), 0) AS BIGINT) AS bytes FROM f GROUP BY repo""")
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_index.index_stats(repo_index.indexed(*_tree(spark, sf_dir))).select("repo", "files", "read", "bytes")


_ROUTES = "CASE WHEN p_size % 4 = 0 THEN 'get' WHEN p_size % 4 = 1 THEN 'POST' WHEN p_size % 4 = 2 THEN 'all' END"


@query(f"""
    SELECT p_partkey || '.ts' AS path, 'http-route' AS kind, CAST(2 AS INTEGER) AS line, upper({_ROUTES}) || ' /p/' || p_size AS detail FROM part WHERE p_size % 4 < 3
    UNION ALL SELECT p_partkey || '.ts', 'serverless', 3, NULL FROM part WHERE p_size % 5 = 0""")
def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    verb = F.when(size % 4 == 0, "get").when(size % 4 == 1, "POST").when(size % 4 == 2, "all")
    route = F.when(verb.isNotNull(), F.concat(F.lit("userRouter."), verb, F.lit("('/p/"), size.cast("string"), F.lit("', f)"))).otherwise("other.get('/x')")
    text = F.concat(F.lit("import x\n"), route, F.when(size % 5 == 0, "\nexports.handler = f").otherwise("\nf()"))
    return repo_index.entrypoints(table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), text.alias("text")))


@query("""
    SELECT l_orderkey, l_linenumber, count(*) AS n, CASE WHEN (l_returnflag = 'R' AND l_discount > 0.05) OR (l_quantity >= 25 AND l_tax > 0.04) THEN 'deep' WHEN l_quantity >= 25 OR l_tax > 0.04 OR l_returnflag = 'R' THEN 'fast' ELSE 'not-relevant' END AS mode
    FROM lineitem GROUP BY ALL""")
def review_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.struct("l_orderkey", "l_linenumber").alias("path")
    files = table(spark, sf_dir, "lineitem").select(path, F.when(F.col("l_quantity") >= 25, 2).otherwise(1).alias("relevance"), (F.col("l_tax") > 0.04).cast("int").alias("sinks"), (F.col("l_discount") > 0.05).cast("int").alias("sources"), (F.col("l_returnflag") == "R").alias("entrypoint"))
    return repo_index.review_plan(files).groupBy("path", "mode").agg(F.count("*").alias("n")).select("path.l_orderkey", "path.l_linenumber", "n", "mode")


@query("""
    WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders)
    SELECT o_custkey, o_orderkey, CAST(place // 4 AS BIGINT) AS batch, place FROM o""")
def plan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_index.fixed_batches(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 4)


@query("""
    WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)),
    p AS (SELECT conv_id, turn, n, tokens, CAST(0 AS BIGINT) AS batch, tokens AS spent FROM t WHERE n = 1
          UNION ALL SELECT t.conv_id, t.turn, t.n, t.tokens, p.batch + CASE WHEN p.spent + t.tokens > 200 THEN 1 ELSE 0 END, CASE WHEN p.spent + t.tokens > 200 THEN t.tokens ELSE p.spent + t.tokens END FROM p JOIN t ON t.conv_id = p.conv_id AND t.n = p.n + 1)
    SELECT conv_id, turn, tokens, batch FROM p""")
def turns_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations in order, in batches of at most 200 estimated tokens."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    rows = turns.select("conv_id", "turn", F.ceil(F.length("text") / 3.5).alias("tokens"))
    return repo_index.packed_batches(rows, "conv_id", ["turn"], "tokens", 200)


@query("""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS rows FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'verified' WHEN doc_id % 3 = 1 THEN 'relocated' ELSE 'dropped' END AS status FROM l WHERE len(rows) >= 8 AND len(list_distinct(rows[1:8])) = 8
          AND len(list_filter(rows[1:8], lambda x: length(trim(x)) < 12)) = 0)
    SELECT doc_id, status FROM s""")
def snippet_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth line of documents as a snippet that is said to be at line 5, at line 8, or that is of another text."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.split("text", "\n", -1).alias("rows"))
    first = F.slice("rows", 1, 8)
    usable = docs.where((F.size("rows") >= 8) & (F.size(F.array_distinct(first)) == 8) & F.forall(first, lambda x: F.length(F.trim(x)) >= 12))
    kind = F.col("doc_id") % 3
    snippet = F.when(kind < 2, F.concat(F.lit("  "), F.get("rows", F.lit(3)))).otherwise("qzx0 jvw1 kkq2 wzx3 qqj4 zzx5 vvk6 0jq7")
    at = F.when(kind == 1, 8).otherwise(5)
    issues = usable.select("doc_id", F.col("doc_id").alias("file"), at.alias("start"), at.alias("end"), snippet.alias("snippet"))
    found = verification.placed(issues, usable.select(F.col("doc_id").alias("file"), F.array_join(first, "\n").alias("text")))
    return found.select("doc_id", "status")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '3' THEN 'info' ELSE 'high' END AS severity,
           CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '3' THEN 'low' WHEN o_orderstatus IN ('F', 'O') THEN 'medium' ELSE 'high' END AS confidence,
           CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '3' THEN 5.0 ELSE 75.0 END::DOUBLE AS risk_score FROM orders""")
def verdicts_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as high findings; status F refutes (with evidence below priority 3), O weakens, P upholds."""
    none = F.lit(None).cast("array<string>")
    orders = table(spark, sf_dir, "orders")
    findings = orders.select(F.col("o_orderkey").alias("id"), F.lit("high").alias("severity"), F.lit("high").alias("confidence"), F.lit(75.0).alias("risk_score"), none.alias("factors"), none.alias("produced_by"))
    said = F.when(F.col("o_orderstatus") == "F", "refuted").when(F.col("o_orderstatus") == "O", "weakened").otherwise("upheld")
    line = F.when(F.col("o_orderpriority") < "3", 2).when(F.col("o_orderpriority") < "4", 1).otherwise(9)
    verdicts = orders.select(F.col("o_orderkey").alias("id"), said.alias("verdict"), F.array(line).alias("lines"))
    shown = orders.select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.struct(F.lit(1).alias("line"), F.lit("// checked above").alias("code")), F.struct(F.lit(2).alias("line"), F.lit("check(x)").alias("code")))).alias("l")).select("id", "l.line", "l.code")
    done = verification.with_verdicts(findings, verification.evidenced(verdicts, shown))
    return done.select(F.col("id").alias("o_orderkey"), "severity", "confidence", "risk_score")


_CODE = (
    ("let rows = db.query('select ' + name)", "sast/sql-injection"), ("os.system('rm ' + path)", "sast/command-injection"), ("eval(input)", "sast/code-injection"), ("el.innerHTML = html", "sast/xss"),
    ("res.redirect(req.query.next)", "sast/open-redirect"), ("requests.get(request.url)", "sast/ssrf"), ("pickle.loads(data)", "sast/unsafe-deserialization"), ("yaml.load(f)", "sast/unsafe-yaml"),
    ("hashlib.md5(x)", "sast/weak-crypto"), ("yaml.load(f, Loader=yaml.SafeLoader)", None), ("db.query('select ?', [name])", None), ("el.innerHTML == html", None),
)


@query(f"SELECT o_orderkey AS file, CAST(2 AS INTEGER) AS line, CASE o_orderkey % {len(_CODE)} {' '.join(f'''WHEN {k} THEN '{r}' ''' for k, (_, r) in enumerate(_CODE) if r)} END AS rule_id FROM orders WHERE o_orderkey % {len(_CODE)} < 9")
def code_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of three lines for each order, of which the second may be dangerous."""
    line = F.get(F.array(*(F.lit(c) for c, _ in _CODE)), (F.col("o_orderkey") % len(_CODE)).cast("int"))
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.concat(F.lit("start()\n"), line, F.lit("\nend()")).alias("text"))
    return review.rule_hits(code_text.lines(files, "file", "text")).select("file", "line", "rule_id")


_DOCKER = (
    ("FROM node:20\nENV API_TOKEN=abc123\nUSER app", "secret-in-arg-env", 2), ("FROM node:20\nRUN curl http://x | sh\nUSER app", "curl-pipe-shell", 2), ("FROM node:20\nRUN ls", "root-user", 1),
    ("FROM node:latest\nUSER app", "latest-tag", 1), ("FROM node:20\nUSER app", None, None),
)


@query(f"""SELECT p_partkey AS path, CAST(CASE p_partkey % 5 {' '.join(f'WHEN {k} THEN {n}' for k, (_, _, n) in enumerate(_DOCKER) if n)} END AS INTEGER) AS line,
    'config/docker-' || CASE p_partkey % 5 {' '.join(f"WHEN {k} THEN '{r}'" for k, (_, r, _) in enumerate(_DOCKER) if r)} END AS rule FROM part WHERE p_partkey % 5 < 4""")
def docker_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*(F.lit(t) for t, _, _ in _DOCKER)), (F.col("p_partkey") % 5).cast("int"))
    return config_rules.dockerfile_issues(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), text.alias("text")))


@query("""
    WITH d AS (SELECT p_partkey, 'lib' || p_size % 4 AS dep, p_size % 4 AS k FROM part)
    SELECT p_partkey || '/package-lock.json' AS lockfile, '' AS parent, 'node_modules/app' AS child FROM d
    UNION ALL SELECT p_partkey || '/package-lock.json', 'node_modules/app', CASE WHEN k < 2 THEN 'node_modules/app/node_modules/' ELSE 'node_modules/' END || dep FROM d""")
def npm_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lockfile for each part: what the application needs is nested below it for some, and at the root for others."""
    dep = F.concat(F.lit("lib"), (F.col("p_size") % 4).cast("string"))
    at = F.when(F.col("p_size") % 4 < 2, F.concat(F.lit("node_modules/app/node_modules/"), dep)).otherwise(F.concat(F.lit("node_modules/"), dep))
    text = F.concat(F.lit('{"packages":{"":{"dependencies":{"app":"1"}},"node_modules/app":{"version":"1.0.0","dependencies":{"'), dep, F.lit('":"^1"}},"'), at, F.lit('":{"version":"1.2.0"}}}'))
    files = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("/package-lock.json")).alias("path"), text.alias("text"))
    return dependencies.npm_edges(dependencies.npm_packages(files))


@query("""
    SELECT 'src/p' || p_partkey || '.ts' AS file, CAST(2 AS INTEGER) AS line, './lib/m' || p_size AS spec, 'src/lib/m' || p_size || CASE WHEN p_size % 2 = 0 THEN '.ts' ELSE '/index.js' END AS target FROM part WHERE p_size < 40""")
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import of a module by each part's file; modules 40 and on aren't there."""
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    files = part.select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("file"), F.concat(F.lit("// import './no'\nimport x from './lib/m"), size, F.lit("'\n")).alias("text"))
    known = part.where("p_size < 40").select(F.concat(F.lit("src/lib/m"), size, F.when(F.col("p_size") % 2 == 0, ".ts").otherwise("/index.js")).alias("path")).distinct()
    return imports.resolved(imports.js_imports(code_text.lines(files, "file", "text")), known)


@query("""
    SELECT doc_id, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda x: regexp_matches(x, '\\b(TODO|FIXME|HACK|XXX)\\b'))) AS INTEGER) AS todos FROM documents""")
def todo_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_text.file_metrics(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "todos")


@query("""
    SELECT l_partkey AS package, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'https://github.com/o-' || l_suppkey || '/r.' || l_partkey END AS url, CASE WHEN l_partkey % 4 <> 0 THEN 'r.' || l_partkey END AS name, 'taint/sql-injection-' || l_linenumber AS rule_id,
           'https://github.com/o/r/blob/sha/a%20b/%2E%2E/f.ts#L' || l_linenumber || CASE WHEN l_quantity > 25 THEN '-L' || (l_linenumber + 2) ELSE '' END AS link, CAST(ceil(l_quantity / 3.5) AS BIGINT) AS tokens
    FROM lineitem""")
def repo_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, rule names, links and token estimates of line items."""
    key, n = F.col("l_partkey"), F.col("l_linenumber")
    url = F.when(key % 4 != 0, F.concat(F.lit("https://github.com/o-"), F.col("l_suppkey").cast("string"), F.lit("/r."), key.cast("string"))).otherwise("https://example.com/o/r")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_quantity", url.alias("url")).withColumn("repo", repo.repo_of_url(F.concat("url", F.when(key % 4 != 0, ".git").otherwise(""))))
    end = F.when(F.col("l_quantity") > 25, n + 2).otherwise(n)
    link = repo.permalink(F.lit("o"), F.lit("r"), F.lit("sha"), F.lit("a b/../f.ts"), n, end)
    return rows.select(key.alias("package"), F.when(F.col("repo").isNotNull(), F.col("url")).alias("url"), F.col("repo.name").alias("name"), repo.taint_rule_id(F.concat(F.lit("sast/sqlInjection_"), n.cast("string"))).alias("rule_id"), link.alias("link"), repo.estimated_tokens(F.col("l_quantity")).alias("tokens"))


@query("""
    WITH w AS (SELECT DISTINCT doc_id, line, unnest(regexp_extract_all(content, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')) AS content, CAST(generate_subscripts(string_split_regex(coalesce(text, ''), '\\r?\\n'), 1) AS INTEGER) AS line FROM documents)),
    n AS (SELECT DISTINCT left(name, 4) AS name FROM w WHERE length(name) > 9)
    SELECT name, doc_id AS file, line FROM w JOIN n USING (name)""")
def word_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of whole words that are the first four letters of long ones."""
    rows = code_text.lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "file")
    words = rows.select(F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))).alias("name"))
    return repo_tools.references(rows, words.where(F.length("name") > 9).select(F.substring("name", 1, 4).alias("name")))


@query("""
    WITH RECURSIVE c AS (SELECT o_custkey, o_orderkey AS commit, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders),
    p AS (SELECT min(o_orderkey) AS base, max(o_orderkey) AS head FROM orders GROUP BY o_custkey)
    SELECT base, head, true AS ancestor FROM p UNION ALL SELECT head, base, base = head FROM p WHERE base <> head UNION ALL SELECT -1, head, NULL FROM p""")
def commit_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a line of commits: the first is an ancestor of the last, and not the other way round."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    commits = orders.select(F.col("o_orderkey").alias("commit"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("parent"))
    ends = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("base"), F.max("o_orderkey").alias("head"))
    asked = ends.select("base", "head").union(ends.where("base <> head").select("head", "base")).union(ends.select(F.lit(-1), "head"))
    return repo_tools.is_ancestor(commits, asked)


@query("""
    WITH r AS (SELECT DISTINCT l_suppkey AS action, l_orderkey AS finding_id, l_partkey AS advisory FROM lineitem), n AS (SELECT action, count(DISTINCT advisory) AS n FROM r GROUP BY action),
    m AS (SELECT r.finding_id, r.action, count(DISTINCT advisory) AS own, any_value(n) AS n, any_value(s_acctbal) AS priority FROM r JOIN n USING (action) JOIN supplier ON s_suppkey = action GROUP BY r.finding_id, r.action)
    SELECT finding_id, action, 'run ' || action AS command, n - own AS others FROM m QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY priority DESC, n DESC, action) = 1""")
def best_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("action"), F.col("s_acctbal").alias("priority"), F.concat(F.lit("run "), F.col("s_suppkey").cast("string")).alias("command"))
    resolves = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("action"), F.col("l_orderkey").alias("finding_id"), F.col("l_partkey").alias("advisory"))
    return repo_tools.best_actions(actions, resolves)


@query(r"""
    WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS name FROM benchmark)
    SELECT name, doc_id FROM documents JOIN n ON contains(text, name)""")
def names_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where words of benchmark items stand in documents, also within longer words."""
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("name"))
    return repo_tools.names_in(table(spark, sf_dir, "documents").select("doc_id", "text"), names, "doc_id", "text", whole=False).select("name", "doc_id")

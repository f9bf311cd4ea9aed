"""Store writes: orders as scans, line items as findings, customers as repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.operators import stores
from sievegrid.plans.registry import query
from sievegrid.sources.tables import table


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan, fingerprint, analyzer, status and ord; one row for each scan and fingerprint."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("fingerprint")).agg(F.min("l_returnflag").alias("analyzer"), F.min("l_linestatus").alias("status"), F.min("l_partkey").alias("ord"))
    return rows.select("scan", "fingerprint", "analyzer", F.when(F.col("status") == "F", "fixed").otherwise("new").alias("status"), "ord")


_FOUND = "f AS (SELECT l_orderkey AS scan, l_linenumber AS fingerprint, min(l_returnflag) AS analyzer, CASE WHEN min(l_linestatus) = 'F' THEN 'fixed' ELSE 'new' END AS status, min(l_partkey) AS ord FROM lineitem GROUP BY ALL)"


@query(f"""
    WITH {_FOUND}, n AS (SELECT scan, fingerprint + 1 AS fingerprint, 'A' AS analyzer, 'new' AS status, ord FROM f WHERE analyzer = 'A' AND fingerprint % 2 = 0)
    SELECT scan, fingerprint, analyzer, status FROM f WHERE analyzer <> 'A'
    UNION ALL SELECT scan, fingerprint, analyzer, status FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.scan = n.scan AND f.fingerprint = n.fingerprint AND f.analyzer <> 'A')""")
def replace_for_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of analyzer A are replaced by others; where another analyzer has the fingerprint, its row stays."""
    stored = _findings(spark, sf_dir)
    new = stored.where("analyzer = 'A' and fingerprint % 2 = 0").select("scan", (F.col("fingerprint") + 1).alias("fingerprint"), F.lit("A").alias("analyzer"), F.lit("new").alias("status"), "ord")
    return stores.replaced(stored, new, F.col("analyzer") == "A", ["scan", "fingerprint"], "ord").select("scan", "fingerprint", "analyzer", "status")


@query(f"""
    WITH {_FOUND}, n AS (SELECT scan, 100 + fingerprint AS fingerprint FROM f WHERE fingerprint = 1)
    SELECT scan, fingerprint, status FROM f WHERE status <> 'fixed' UNION ALL SELECT scan, fingerprint, 'fixed' FROM n""")
def replace_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _findings(spark, sf_dir)
    new = stored.where("fingerprint = 1").withColumns({"fingerprint": F.col("fingerprint") + 100, "status": F.lit("fixed")})
    return stores.replaced(stored, new, ~stores.not_fixed(F.col("status")), ["scan", "fingerprint"], "ord").select("scan", "fingerprint", "status")


@query(f"""
    WITH {_FOUND} SELECT scan, fingerprint, CASE WHEN fingerprint = 2 THEN 'B' ELSE analyzer END AS analyzer, CASE WHEN fingerprint = 2 THEN NULL ELSE status END AS status FROM f WHERE fingerprint <> 3""")
def update_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second findings are rewritten (with a null), third ones are deleted, and what isn't stored isn't added."""
    stored = _findings(spark, sf_dir).drop("ord")
    changes = stored.where("fingerprint = 2").select("scan", "fingerprint", F.lit("B").alias("analyzer"), F.lit(None).cast("string").alias("status"))
    absent = changes.withColumn("fingerprint", F.col("fingerprint") + 1000)
    return stores.updated(stored, changes.union(absent), ["scan", "fingerprint"], stored.where("fingerprint = 3"))


@query("""
    WITH s AS (SELECT o_orderkey AS scan_id, o_orderpriority AS path, o_orderstatus AS status FROM orders),
    n AS (SELECT l_orderkey AS scan_id, l_shipmode AS path, max_by(l_returnflag, l_linenumber * 1000000 + l_partkey) AS status FROM (SELECT *, CAST(l_linenumber % 3 AS VARCHAR) AS l_shipmode FROM lineitem WHERE l_quantity > 40) GROUP BY ALL)
    SELECT scan_id, path, status FROM s WHERE scan_id NOT IN (SELECT scan_id FROM n) UNION ALL SELECT * FROM n""")
def coverage_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.lit("a").alias("analyzer"), F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("status"))
    entries = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("scan_id"), F.lit("a").alias("analyzer"), (F.col("l_linenumber") % 3).cast("string").alias("path"), F.col("l_returnflag").alias("status"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("at"))
    return stores.coverage_replaced(stored, entries, "at").select("scan_id", "path", "status")


@query("SELECT c_custkey AS id, c_nationkey AS owner, c_name || CASE WHEN c_acctbal > 0 THEN '!' ELSE '' END AS url FROM customer UNION ALL SELECT -c_custkey, c_nationkey + 1000, c_name FROM customer WHERE c_acctbal > 0")
def upsert_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows are written over but keep their id; others are added."""
    customers = table(spark, sf_dir, "customer")
    base = customers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner"), F.col("c_name").alias("name"), F.col("c_name").alias("url"))
    some = customers.where("c_acctbal > 0")
    again = some.select((-F.col("c_custkey")).alias("id"), F.col("c_nationkey").alias("owner"), F.col("c_name").alias("name"), F.concat("c_name", F.lit("!")).alias("url"))
    new = some.select((-F.col("c_custkey")).alias("id"), (F.col("c_nationkey") + 1000).alias("owner"), F.col("c_name").alias("name"), F.col("c_name").alias("url"))
    return stores.upserted_keeping(base, again.union(new), ["owner", "name"], "id").select("id", "owner", "url")


_SCANS = "s AS (SELECT o_orderkey AS id, o_custkey AS repo, o_orderstatus, o_orderdate AS created, o_orderkey % 2 AS ref FROM orders)"


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("QUEUED")
    ref = F.when(F.col("o_orderkey") % 2 == 1, "main")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo_id"), ref.alias("ref"), F.lit("x").alias("options"), F.lit("c").alias("commit"), state.alias("state"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("finished_at"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("date").alias("started_at"))


@query(f"""
    WITH {_SCANS}, p AS (SELECT a.id, b.id AS base_id, row_number() OVER (PARTITION BY a.id ORDER BY b.created DESC, b.id DESC) AS place FROM s a JOIN s b ON a.repo = b.repo AND a.ref = b.ref AND b.o_orderstatus = 'F' AND a.id <> b.id AND b.created <= a.created)
    SELECT id, base_id, CAST(place AS INTEGER) AS place FROM p WHERE place <= 3""")
def scan_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.baselines(_scans(spark, sf_dir), 3)


@query(f"WITH {_SCANS} SELECT repo AS repo_id, CASE WHEN ref = 1 THEN 'main' END AS ref, max_by(id, created::VARCHAR || lpad(id::VARCHAR, 12, '0')) AS id FROM s WHERE o_orderstatus <> 'F' GROUP BY repo, ref")
def active_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = _scans(spark, sf_dir)
    return stores.active_duplicates(scans, scans.select("repo_id", "ref", "options")).select("repo_id", "ref", "id")


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_totalprice > 200000 THEN 'FAILED' WHEN o_orderstatus = 'O' THEN 'RUNNING' ELSE 'QUEUED' END AS state,
           CASE WHEN o_orderstatus <> 'F' AND o_totalprice > 200000 THEN 'E' END AS error_code, o_orderstatus <> 'F' AND o_totalprice > 200000 AS started FROM orders""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of large orders are to fail; those that are over stay."""
    asked = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("id"), F.lit("FAILED").alias("to_state"), F.lit("E").alias("code"))
    after = stores.transitioned(_scans(spark, sf_dir), asked, F.lit("2024-01-01").cast("date"))
    return after.select("id", "state", "error_code", F.col("started_at").isNotNull().alias("started"))


@query("""
    WITH b AS (SELECT o_custkey || '/' || o_orderkey % 50 AS path, min(o_orderstatus) AS blob FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
    h AS (SELECT o_custkey || '/' || o_orderkey % 50 AS path, min(o_orderpriority)[1:1] AS p, min(o_orderstatus) AS blob FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1)
    SELECT coalesce(b.path, h.path) AS path, CASE WHEN b.path IS NULL THEN 'A' WHEN h.path IS NULL THEN 'D' ELSE 'M' END AS status FROM b FULL JOIN h ON b.path = h.path WHERE b.path IS NULL OR h.path IS NULL OR b.blob <> h.blob""")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trees whose added and deleted files have blobs of their own, so that none is a rename."""
    o = table(spark, sf_dir, "orders").withColumn("path", F.concat_ws("/", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 50).cast("string")))
    tree = lambda rest: o.where(F.col("o_orderkey") % 3 != rest).groupBy("path").agg(F.min("o_orderstatus").alias("blob"))
    base, head = tree(0), tree(1)
    gone, new = base.join(head, "path", "left_anti"), head.join(base, "path", "left_anti")
    own = lambda df, part, tag: df.join(part.select("path", F.lit(tag).alias("tag")), "path", "left").select("path", F.concat("blob", F.coalesce(F.concat("tag", "path"), F.lit(""))).alias("blob"))
    return stores.diff_status(own(base, gone, "b"), own(head, new, "h")).select("path", "status")


@query("""
    WITH b AS (SELECT o_orderstatus AS analyzer, o_orderkey FROM orders WHERE o_orderpriority < '4'), c AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000),
    k AS (SELECT o_orderstatus AS analyzer, sum(o_totalprice) AS cost FROM orders GROUP BY 1)
    SELECT analyzer, count(*) AS reviewed, count(c.o_orderkey) AS reused, round(any_value(cost) * count(c.o_orderkey) / count(*), 2) AS saved FROM b LEFT JOIN c USING (o_orderkey) JOIN k USING (analyzer) GROUP BY analyzer""")
def reuse_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = lambda where, status: o.where(where).select(F.col("o_orderstatus").alias("analyzer"), F.col("o_orderkey").alias("path"), F.lit(status).alias("status"))
    calls = o.select(F.col("o_orderstatus").alias("analyzer"), F.col("o_totalprice").alias("cost_usd"))
    return stores.reuse_stats(calls, rows("o_orderpriority < '4'", "reviewed"), rows("o_totalprice > 100000", "cached")).withColumn("saved", F.round("saved", 2))


@query("""
    SELECT c_nationkey AS repo_id, CAST(c_custkey AS VARCHAR) AS fingerprint, CASE WHEN c_acctbal > 5000 THEN 'accepted' ELSE 'false_positive' END AS status FROM customer WHERE NOT (c_acctbal BETWEEN 0 AND 5000)
    UNION ALL SELECT c_nationkey, 'x' || c_custkey, 'accepted' FROM customer WHERE c_acctbal > 5000""")
def triage_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rich customers' decisions are written under two keys, those of middling ones are cleared, others stay."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("repo_id"), F.col("c_custkey").cast("string").alias("key"), "c_acctbal")
    never = F.lit(None).cast("timestamp").alias("expires_at")
    stored = c.select("repo_id", F.col("key").alias("fingerprint"), F.lit("false_positive").alias("status"), never)
    decided = c.where("c_acctbal >= 0").select("repo_id", F.array("key", F.concat(F.lit("x"), "key")).alias("keys"), F.when(F.col("c_acctbal") > 5000, "accepted").alias("status"), never, F.lit(1).alias("at"))
    return stores.triaged(stored, decided, "at").select("repo_id", "fingerprint", "status")

"""Matching, suppression, version and supply-chain operators, over customers, orders, parts, line items and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import text as tx
from sievegrid.operators import dedupe, dependencies, matching
from sievegrid.plans.registry import query
from sievegrid.sources.tables import table


@query("""
    WITH p AS (SELECT c_name FROM customer WHERE c_acctbal > 9700)
    SELECT c.c_name AS name, min(p.c_name) AS target FROM customer c JOIN p ON damerau_levenshtein(c.c_name, p.c_name) = 1
    WHERE c.c_name NOT IN (SELECT c_name FROM p) GROUP BY c.c_name""")
def typosquats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_acctbal")
    return dependencies.typosquats(names, names.where("c_acctbal > 9700"), names.where("false"))


@query("""
    WITH k AS (SELECT c_custkey, unnest([CAST(c_custkey % 37 AS BIGINT), CAST(c_nationkey AS BIGINT) + 100]) AS key, unnest([0, 1]) AS pos FROM customer),
    s AS (SELECT CAST(s_suppkey AS BIGINT) AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'accepted' ELSE 'false_positive' END AS status FROM supplier WHERE s_suppkey % 5 < 3
          UNION ALL SELECT 100 + n_nationkey, 'by_nation' FROM nation WHERE n_name < 'J')
    SELECT CAST(c_custkey AS VARCHAR) AS id, min_by(status, pos) AS status FROM k JOIN s USING (key) GROUP BY c_custkey""")
def suppressions_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-01").cast("timestamp")
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array((F.col("c_custkey") % 37).cast("string"), (F.col("c_nationkey") + 100).cast("string")).alias("keys"))
    until = F.when(F.col("s_suppkey") % 5 == 3, now).when(F.col("s_suppkey") % 5 == 4, F.lit("2023-01-01").cast("timestamp")).when(F.col("s_suppkey") % 5 == 0, F.lit("2025-01-01").cast("timestamp"))
    by_key = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("fingerprint"), F.when(F.col("s_suppkey") % 2 == 0, "accepted").otherwise("false_positive").alias("status"), until.alias("expires_at"))
    by_nation = table(spark, sf_dir, "nation").where("n_name < 'J'").select((F.col("n_nationkey") + 100).cast("string"), F.lit("by_nation"), F.lit(None).cast("timestamp"))
    return matching.suppressed(found, by_key.union(by_nation), now)


@query("""
    WITH b AS (SELECT o_custkey AS key, min_by(o_orderkey, o_orderkey) AS base_id FROM orders WHERE year(o_orderdate) = 1996 GROUP BY o_custkey),
    h AS (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]) AS key, unnest([0, 1]) AS pos FROM orders WHERE year(o_orderdate) = 1997)
    SELECT CAST(o_orderkey AS VARCHAR) AS head_id, CAST(min_by(base_id, pos) AS VARCHAR) AS base_id FROM h JOIN b USING (key) GROUP BY o_orderkey""")
def exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    key = F.col("o_custkey")
    rows = lambda year, *keys: orders.where(F.col("year") == year).select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("ord"), F.array(*(k.cast("string") for k in keys)).alias("keys"))
    return matching.exact_matches(rows(1996, key), rows(1997, key, key + 1))


@query("""
    WITH v AS (SELECT p_brand, p_size AS a, CAST(p_partkey % 13 AS INTEGER) AS b, CAST(p_partkey % 7 AS INTEGER) AS c FROM part)
    SELECT p_brand, arg_max(a || '.' || b || '.' || c, a * 10000 + b * 100 + c) AS newest, arg_min(a || '.' || b || '.' || c, a * 10000 + b * 100 + c) AS oldest FROM v GROUP BY p_brand""")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 13).cast("string"), (F.col("p_partkey") % 7).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_brand", version.alias("version")).withColumn("key", tx.semver(F.col("version")))
    return rows.groupBy("p_brand").agg(F.max_by("version", "key").alias("newest"), F.min_by("version", "key").alias("oldest"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: a file for each user, a family for each type, short line ranges, and for every seventh a trace that ends at a sink."""
    e = F.col("event_id")
    start = (e % 40).cast("int")
    step = lambda line, kind: F.struct(F.col("user_id").cast("string").alias("file"), line.cast("int").alias("line"), F.lit(kind).alias("kind"))
    trace = F.when(e % 7 == 0, F.array(step(start + 20, "source"), step(start, "sink"))).cast(dedupe.TRACE)
    cwe = F.when(e % 5 == 0, "cwe-89 ").when(e % 11 == 0, "CWE-79")
    return table(spark, sf_dir, "events").select(e.cast("string").alias("id"), F.lit("sast").alias("category"), F.concat(F.lit("sast/"), "event_type").alias("rule_id"), cwe.alias("cwe"), F.col("user_id").cast("string").alias("file"), start.alias("start"), (start + (e % 3).cast("int")).alias("end"), trace.alias("trace"), e.alias("rank"))


_PAIRS = """
    f AS (SELECT event_id, user_id, event_type, event_id % 40 AS s, event_id % 40 + event_id % 3 AS e, event_id % 7 = 0 AS t, CASE WHEN event_id % 5 = 0 THEN 89 WHEN event_id % 11 = 0 THEN 79 END AS cwe FROM events),
    pairs AS (SELECT a.event_id AS a, b.event_id AS b FROM f a JOIN f b ON a.user_id = b.user_id AND a.event_id < b.event_id AND (a.event_type = b.event_type OR a.cwe = b.cwe)
      AND ((a.s <= b.e AND b.s <= a.e) OR (a.t AND (a.s + 20 BETWEEN b.s AND b.e OR a.s BETWEEN b.s AND b.e)) OR (b.t AND (b.s + 20 BETWEEN a.s AND a.e OR b.s BETWEEN a.s AND a.e)))
      AND (NOT a.t OR NOT b.t OR a.s = b.s OR a.s BETWEEN b.s AND b.e OR b.s BETWEEN a.s AND a.e))"""


@query(f"WITH {_PAIRS} SELECT a, b FROM pairs")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.candidate_pairs(_findings(spark, sf_dir))


@query()
def overlap_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-first absorption has no SQL; tests/test_dependencies.py checks it."""
    return dedupe.absorbed(_findings(spark, sf_dir))


@query("""
    WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/]*(/[a-z]*)', 1) AS name FROM pages),
    p AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY name) AS k FROM h)
    SELECT host, count(*) AS packages, array_to_string(list_sort(list(name) FILTER (k <= 8)), ',') AS names FROM p WHERE host NOT LIKE 'www.%' GROUP BY host""")
def host_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("source"), F.regexp_extract("url", "^[a-z]+://[^/]*(/[a-z]*)", 1).alias("name")).where(~dependencies.source_host(F.col("source")).startswith("www."))
    return dependencies.host_signals(rows, []).withColumn("names", F.array_join("names", ","))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN 'reachable' WHEN o_orderstatus = 'O' THEN 'imported' WHEN o_orderstatus = 'P' AND o_orderpriority LIKE '2%' THEN 'unknown'
                            WHEN o_orderstatus = 'P' THEN 'unreachable' WHEN o_totalprice > 250000 THEN 'unknown' ELSE 'unreachable' END AS reachability FROM orders""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, direct = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "P"
    first, second = F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority").startswith("2")
    made = matching.reachability(own, F.lit(True), first, F.lit(False), direct, F.lit(False), second, F.col("o_totalprice") > 250000, F.lit(True))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("reachability"))

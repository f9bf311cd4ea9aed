"""Imports, line rules, carried findings, upserts and overlaps, over pages, orders, line items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.operators import code_text, imports, review
from sievegrid.plans.registry import query
from sievegrid.sources.tables import table


@query("""
    WITH i AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS name FROM pages),
    p AS (SELECT regexp_extract(name, '^[^/]+') AS package FROM i UNION SELECT regexp_extract(name, '^[^/]+/e[^/]*') FROM i)
    SELECT page_id AS id, arg_max(package, length(package)) AS package FROM i JOIN p ON package <> '' AND (name = package OR starts_with(name, package || '/')) GROUP BY page_id""")
def import_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("name"))
    packages = names.select(F.regexp_extract("name", "^[^/]+", 0).alias("package")).union(names.select(F.regexp_extract("name", "^[^/]+/e[^/]*", 0)))
    return imports.owners(names, packages)


@query("""
    WITH l AS (SELECT page_id, unnest(regexp_split_to_array(coalesce(html, ''), '\\r?\\n')) AS content, generate_subscripts(regexp_split_to_array(coalesce(html, ''), '\\r?\\n'), 1) AS line FROM pages),
    h AS (SELECT page_id, CAST(line AS INTEGER) AS line, CASE WHEN regexp_matches(content, '<script\\b') THEN 'web/script' WHEN regexp_matches(content, '<!--') THEN 'web/comment' WHEN regexp_matches(content, '(?i)<a href="/t') THEN 'web/link' END AS rule_id FROM l)
    SELECT page_id AS file, line, rule_id, CASE rule_id WHEN 'web/script' THEN 'high' WHEN 'web/comment' THEN 'low' ELSE 'medium' END AS severity FROM h WHERE rule_id IS NOT NULL""")
def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_text.lines(table(spark, sf_dir, "pages"), "page_id", "html").withColumnRenamed("page_id", "file")
    return review.rule_hits(rows, (("web/script", "high", r"<script\b"), ("web/comment", "low", "<!--"), ("web/link", "medium", '(?i)<a href="/t')))


@query("""
    WITH b AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE year(o_orderdate) = 1996 GROUP BY o_custkey),
    c AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE year(o_orderdate) = 1997 GROUP BY o_custkey)
    SELECT coalesce(c.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN c.o_custkey IS NULL THEN b.n ELSE c.n END AS n, CASE WHEN c.o_custkey IS NULL THEN b.last ELSE c.last END AS last FROM b FULL JOIN c ON b.o_custkey = c.o_custkey""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    of = lambda year: orders.where(F.year("o_orderdate") == year).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    return review.upserted(of(1996), of(1997), ["o_custkey"])


@query("""
    SELECT o_custkey AS file, sha256('next:' || o_orderkey) AS id FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def carried_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("id"))
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "file")
    return review.carried(found, customers.where("c_acctbal > 0"), customers.where("c_mktsegment = 'BUILDING'"), "next")


@query("""
    SELECT o_orderkey, coalesce(max(o_orderdate + INTERVAL 20 DAY) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= o_orderdate, false) AS overlaps FROM orders""")
def overlaps_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 20 DAY")).alias("until"))
    return review.overlapping(rows, "o_custkey", "o_orderdate", "until", "o_orderkey").select("o_orderkey", "overlaps")


@query("""
    WITH s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01')
    SELECT count(*) AS files, count(o_custkey) AS in_scope, count(o_custkey) / count(*)::DOUBLE AS share, count(o_custkey) / count(*)::DOUBLE > 0.4 AS full FROM customer LEFT JOIN s ON c_custkey = o_custkey""")
def incremental_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"))
    return review.incremental_plan(files, table(spark, sf_dir, "orders").where("o_orderdate >= '1998-01-01'").select(F.col("o_custkey").alias("file")))


@query("""
    WITH f AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant')
    SELECT f.conv_id, f.turn, CASE WHEN coalesce(bool_or(starts_with(text, 'Th')) AND bool_or(contains(text, ', th')), false) OR coalesce(bool_or(starts_with(text, 'In')), false) THEN 'refuted' ELSE 'upheld' END AS verdict
    FROM f JOIN conversations c ON f.conv_id = c.conv_id AND c.turn BETWEEN f.turn - 1 AND f.turn GROUP BY f.conv_id, f.turn""")
def guarded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), (F.col("turn") + 1).cast("int").alias("line"), F.col("text").alias("content"), "conv_id", "turn", "role")
    found = rows.where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("id"), "file", F.col("line").alias("start"), F.col("line").alias("end"))
    made = review.verdicts(found, rows.select("file", "line", "content"), above=1, guards=("^Th", "^In"), beside=", th")
    return made.select("id.conv_id", "id.turn", "verdict")

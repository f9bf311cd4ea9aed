"""Report queries: customers as scans, orders as findings, line items as coverage, documents as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import scrub
from sievegrid.operators import reports
from sievegrid.plans.registry import query
from sievegrid.sources.tables import table

_CATEGORY = "CASE o_orderkey % 4 WHEN 0 THEN 'secret' WHEN 1 THEN 'sast' WHEN 2 THEN 'dependency' ELSE 'config' END"
_SEVERITY = "CASE WHEN o_totalprice > 400000 THEN 'critical' WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 200000 THEN 'medium' WHEN o_totalprice > 100000 THEN 'low' ELSE 'info' END"
_ROWS = f"f AS (SELECT o_custkey AS scan, o_orderkey AS id, {_CATEGORY} AS category, {_SEVERITY} AS severity, o_totalprice AS risk_score, o_orderstatus, o_orderpriority FROM orders)"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS scan", "o_orderkey AS id", f"{_CATEGORY} AS category", f"{_SEVERITY} AS severity", "o_totalprice AS risk_score", "o_orderstatus", "o_orderpriority")
    confidence = F.when(F.col("o_orderpriority") < "3", "high").otherwise("low")
    return rows.withColumns({"confidence": confidence, "reachability": F.when(F.col("o_orderstatus") == "F", "reachable"), "liveness": F.when(F.col("o_orderstatus") == "O", "live")})


@query(f"""
    WITH {_ROWS}, x AS (SELECT *, CASE category WHEN 'dependency' THEN o_orderstatus = 'F' WHEN 'secret' THEN o_orderstatus = 'O' ELSE o_orderpriority < '3' END AS ex FROM f)
    SELECT scan, CASE WHEN bool_or(severity = 'critical' AND ex) THEN 'F' WHEN bool_or(severity = 'critical' OR (severity = 'high' AND ex)) THEN 'D' WHEN bool_or(severity = 'high') THEN 'C' WHEN bool_or(severity = 'medium') THEN 'B' ELSE 'A' END AS grade FROM x GROUP BY scan""")
def scan_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.grades(_findings(spark, sf_dir), "scan")


@query(f"""
    WITH {_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY scan, category ORDER BY risk_score DESC, id) AS k FROM f WHERE severity <> 'info'),
    c AS (SELECT scan, category, count(*) AS n, max(risk_score) FILTER (k = 1) AS top, max(id) FILTER (k = 1) AS top_id, string_agg(id, ',' ORDER BY k) FILTER (k <= 10) AS ids,
                 min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS w FROM r GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY top DESC, top_id) AS place FROM c)
    SELECT scan, CAST(place AS INTEGER) AS place, category, n, ['critical', 'high', 'medium', 'low'][w + 1] AS severity, ids FROM p WHERE place <= 3""")
def top_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_risks(_findings(spark, sf_dir), "scan").withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query(f"""
    WITH {_ROWS}, s AS (SELECT DISTINCT scan FROM f), d AS (SELECT scan, unnest(['secret', 'dependency', 'taint', 'config']) AS category FROM s), r AS (SELECT c_custkey AS scan, CAST(c_nationkey % 2 AS BIGINT) AS files FROM customer)
    SELECT d.scan, d.category FROM d LEFT JOIN r ON d.scan = r.scan WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.scan = d.scan AND f.category = d.category) AND (d.category IN ('secret', 'dependency') OR coalesce(files, 0) > 0)""")
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir)
    scanned = found.select("scan").distinct().withColumn("category", F.explode(F.array(*map(F.lit, reports.CATEGORIES))))
    reviewed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scan"), (F.col("c_nationkey") % 2).alias("files"))
    return reports.observations(scanned, found, reviewed, "scan").select("scan", "category")


@query("""
    WITH c AS (SELECT l_suppkey AS scan, l_shipmode AS analyzer, CASE WHEN l_returnflag = 'R' THEN 'reviewed' WHEN l_returnflag = 'A' THEN 'cached' WHEN l_discount > 0.05 THEN 'skipped-budget' WHEN l_discount > 0.02 THEN 'not-relevant' ELSE 'failed' END AS status
               FROM (SELECT *, 'a' || l_linenumber % 3 AS l_shipmode FROM lineitem)),
    k AS (SELECT scan, string_agg(analyzer || ': ' || n, ', ' ORDER BY n DESC, analyzer) AS skipped FROM (SELECT scan, analyzer, count(*) AS n FROM c WHERE status LIKE 'skipped%' GROUP BY ALL) GROUP BY scan)
    SELECT c.scan, count(*) FILTER (status IN ('reviewed', 'cached')) AS covered, count(*) FILTER (status <> 'not-relevant') AS relevant,
           CASE WHEN count(*) FILTER (status <> 'not-relevant') > 0 THEN round(100.0::DOUBLE * count(*) FILTER (status IN ('reviewed', 'cached')) / count(*) FILTER (status <> 'not-relevant'), 1) ELSE 100.0 END AS percent,
           coalesce(any_value(skipped), '') AS skipped FROM c LEFT JOIN k ON c.scan = k.scan GROUP BY c.scan""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "reviewed").when(F.col("l_returnflag") == "A", "cached").when(F.col("l_discount") > 0.05, "skipped-budget").when(F.col("l_discount") > 0.02, "not-relevant").otherwise("failed")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scan"), F.concat(F.lit("a"), (F.col("l_linenumber") % 3).cast("string")).alias("analyzer"), F.col("l_partkey").alias("path"), status.alias("status"))
    return reports.coverage_report(rows, "scan")


@query(f"""
    WITH {_ROWS}, i AS (SELECT scan, id + 0 AS id FROM f WHERE severity <> 'low'), r AS (SELECT * FROM f WHERE id % 3 <> 0)
    SELECT i.scan, string_agg(DISTINCT r.id, ',' ORDER BY r.id DESC) AS ids, ['critical', 'high', 'medium', 'low', 'info'][min(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END)] AS severity
    FROM i JOIN r ON i.id = r.id GROUP BY i.scan""")
def valid_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's list of orders (newest first, the first one twice), of which every third order isn't known."""
    found = _findings(spark, sf_dir)
    lists = found.where("severity <> 'low'").groupBy("scan").agg(F.sort_array(F.collect_list("id"), False).alias("ids"))
    lists = lists.withColumn("ids", F.concat("ids", F.slice("ids", 1, 1)))
    done = reports.valid_references(lists, found.where("id % 3 <> 0"), "scan")
    return done.select("scan", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), "severity")


@query(r"""
    WITH c AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '`{1,3}[^`]*`{1,3}', '[code]', 'g') AS t FROM documents),
    r AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-z0-9_+/=.-]+|[^A-Za-z0-9_+/=.-]+')) AS x, generate_subscripts(regexp_extract_all(t, '[A-Za-z0-9_+/=.-]+|[^A-Za-z0-9_+/=.-]+'), 1) AS i FROM c),
    g AS (SELECT doc_id, i, x, regexp_extract(x, '[A-Za-z0-9_+=-]{16,}') AS w FROM r),
    s AS (SELECT doc_id, string_agg(CASE WHEN regexp_matches(x, '^[A-Za-z0-9_+/=.-]{24}') THEN '[redacted]' WHEN regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') THEN replace(x, w, '[redacted]') ELSE x END, '' ORDER BY i) AS t FROM g GROUP BY doc_id),
    n AS (SELECT doc_id, trim(regexp_replace(coalesce(s.t, ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents LEFT JOIN s USING (doc_id))
    SELECT doc_id, CASE WHEN length(t) > 4000 THEN left(t, 3999) || '…' ELSE t END AS text FROM n""")
def scrubbed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as digests, with their tokens and inline code gone."""
    return table(spark, sf_dir, "documents").select("doc_id", scrub.scrub_text(F.coalesce("text", F.lit("")), 4000).alias("text"))


@query("""
    SELECT count(*) FILTER (b AND NOT h) AS not_reproduced, count(*) FILTER (h AND NOT b) AS only_this_run, count(*) FILTER (b AND h) AS both
    FROM (SELECT l_partkey, bool_or(l_returnflag = 'A') AS b, bool_or(l_returnflag = 'R') AS h FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_partkey)""")
def run_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("fingerprint"), "l_returnflag")
    return reports.variation(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"))


@query("""
    SELECT l_partkey, count(DISTINCT l_suppkey) AS advisories, CASE min(CASE WHEN l_quantity > 45 THEN 0 WHEN l_quantity > 30 THEN 1 WHEN l_quantity > 10 THEN 2 ELSE 3 END) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS worst,
           max(CASE WHEN l_discount > 0.03 THEN l_discount END) AS max_cvss FROM lineitem GROUP BY l_partkey""")
def advisory_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    severity = F.when(q > 45, "critical").when(q > 30, "high").when(q > 10, "medium").otherwise("low")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("advisory"), severity.alias("severity"), F.when(F.col("l_discount") > 0.03, F.col("l_discount")).alias("cvss"))
    return reports.advisory_tally(rows, "l_partkey")


@query(r"""
    WITH w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') FROM benchmark),
    g AS (SELECT DISTINCT side, id, array_to_string(t[i:i + 7], ' ') AS g FROM (SELECT side, id, t, unnest(range(1, len(t) - 6)) AS i FROM w WHERE len(t) >= 8))
    SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM g d JOIN g b USING (g) WHERE d.side = 'd' AND b.side = 'b' GROUP BY ALL""")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight words, at every offset, that documents share with benchmark items."""
    return reports.shared_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), "doc_id", "item_id")

"""Search, paging, lookups, rollups and comparisons, over orders, customers, parts and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import severity as sev
from sievegrid.operators import dependencies, graph, matching, rollups, search
from sievegrid.plans.registry import query
from sievegrid.sources.tables import table

_LIST = "o_orderkey, o_orderstatus, o_orderpriority, o_totalprice"


def _listing() -> list:
    return [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")]


@query(f"SELECT {_LIST} FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority ILIKE '%urg%' ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 51")
def search_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    clause = search.match_clauses(equal={"o_orderstatus": ["O", "F"]}, text=(["o_orderpriority"], "URG"))
    return search.page(table(spark, sf_dir, "orders").where(clause).select(*_LIST.split(", ")), _listing(), 50)


@query(f"SELECT {_LIST} FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 51 OFFSET 50")
def search_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(table(spark, sf_dir, "orders").select(*_LIST.split(", ")), _listing(), 50, search.encode_cursor(50))


@query("""
    SELECT 'total' AS facet, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM orders
    UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority""")
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facet_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(r"SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand ILIKE 'brand#1%' AND p_name ILIKE '%bolt%' AND p_size IN (1, 2, 3, 4, 5)")
def facet_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    clause = search.match_clauses(equal={"p_size": [1, 2, 3, 4, 5]}, file=("p_brand", "Brand#1*"), text=(["p_name"], "BOLT"))
    return table(spark, sf_dir, "part").where(clause).select("p_partkey", "p_name", "p_brand")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 101")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyset(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 5000, 100)


@query("""
    SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.latest_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
    SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, place FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS place FROM lineitem) WHERE place <= 5""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return search.top_per(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], order, 5).select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "place")


@query("""
    WITH t AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 150 AS top FROM orders)
    SELECT CASE WHEN top THEN 'top' ELSE 'tail' END AS part, o_orderpriority AS value, count(*) AS n FROM t GROUP BY top, o_orderpriority""")
def topk_with_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.digest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 150, "o_orderpriority")


@query("""
    SELECT ship_year, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS A, CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS N,
           CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS R, CAST(0 AS BIGINT) AS X
    FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem) GROUP BY 1""")
def crosstab_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("ship_year"), "l_returnflag")
    return rollups.crosstab(rows, "ship_year", "l_returnflag", ["A", "N", "R", "X"])


@query("""
    SELECT l_returnflag, count(*) AS calls, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS failed, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS input_tokens,
           CAST(sum(l_linenumber) AS BIGINT) AS output_tokens, round(sum(l_extendedprice), 2) AS cost_usd
    FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("input_tokens"), F.col("l_linenumber").cast("long").alias("output_tokens"), F.col("l_extendedprice").alias("cost_usd"), F.when(F.col("l_discount") > 0.05, 1).alias("error_code"))
    return rollups.call_sums(calls, "l_returnflag").withColumn("cost_usd", F.round("cost_usd", 2))


@query("""
    WITH prices(model, input_price, output_price) AS (VALUES ('MAIL', 3.0, 15.0), ('A', 1.0, 5.0), ('N', 15.0, 75.0)),
    priced AS (SELECT l.l_returnflag AS model, l.l_quantity * coalesce(p.input_price, 15.0) + l.l_linenumber * coalesce(p.output_price, 75.0) AS c
               FROM lineitem l LEFT JOIN prices p ON l.l_returnflag = p.model)
    SELECT model, round(sum(c), 2) AS cost_per_million FROM priced GROUP BY model""")
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("MAIL", 3.0, 15.0), ("A", 1.0, 5.0), ("N", 15.0, 75.0)], "model string, input_price double, output_price double")
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("input_tokens"), F.col("l_linenumber").alias("output_tokens"))
    return rollups.cost_usd(calls, prices).groupBy("model").agg(F.round(F.sum("cost_usd") * 1e6, 2).alias("cost_per_million"))


_SPLIT = "base AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996), head AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997)"


def _base_head(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, year = table(spark, sf_dir, "orders"), F.year("o_orderdate")
    return orders.where(year == 1996).select("o_custkey").distinct(), orders.where(year == 1997).select("o_custkey").distinct()


@query(f"WITH {_SPLIT} SELECT o_custkey FROM head ANTI JOIN base USING (o_custkey)")
def diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.diff(*_base_head(spark, sf_dir), ["o_custkey"]).where("status = 'added'").drop("status")


@query(f"WITH {_SPLIT} SELECT o_custkey FROM base ANTI JOIN head USING (o_custkey)")
def diff_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.diff(*_base_head(spark, sf_dir), ["o_custkey"]).where("status = 'fixed'").drop("status")


@query(f"WITH {_SPLIT} SELECT o_custkey FROM head SEMI JOIN base USING (o_custkey)")
def diff_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.diff(*_base_head(spark, sf_dir), ["o_custkey"]).where("status = 'unchanged'").drop("status")


@query("SELECT c_custkey, c_name, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS covered FROM customer")
def covered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return matching.covered(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), big, ["c_custkey"])


_RANGES = [("Brand#11", "A-1", None, 10, None), ("Brand#11", "A-2", 20, 30, None), ("Brand#12", "A-3", 5, None, 25), ("Brand#13", "A-4", 40, None, None)]


@query("""
    WITH r(package, advisory, from_key, to_key, last_key) AS (VALUES ('Brand#11', 'A-1', NULL, 10, NULL), ('Brand#11', 'A-2', 20, 30, NULL), ('Brand#12', 'A-3', 5, NULL, 25), ('Brand#13', 'A-4', 40, NULL, NULL))
    SELECT DISTINCT p_brand AS package, p_partkey AS version, p_size AS key, advisory FROM part JOIN r ON p_brand = package
      AND (from_key IS NULL OR p_size >= from_key) AND (to_key IS NULL OR p_size < to_key) AND (last_key IS NULL OR p_size <= last_key)""")
def interval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame(_RANGES, "package string, advisory string, from_key int, to_key int, last_key int")
    versions = table(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.col("p_partkey").alias("version"), F.col("p_size").alias("key"))
    return matching.affected_versions(versions, ranges)


@query("""
    WITH cur AS (SELECT p_brand, min(p_size) AS now FROM part GROUP BY p_brand)
    SELECT p.p_brand AS package, min(p.p_size) AS next FROM part p JOIN cur c ON p.p_brand = c.p_brand WHERE p.p_size > c.now AND p.p_size % 7 <> 0 GROUP BY p.p_brand""")
def min_clean_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.col("p_size").alias("version"), F.col("p_size").alias("key")).distinct()
    now = versions.groupBy("package").agg(F.min("key").alias("key"))
    return dependencies.safe_upgrade(now, versions, versions.where("key % 7 = 0"))


@query("""
    WITH r AS (SELECT CAST(s_nationkey AS VARCHAR) AS merge_key, CASE WHEN l_linenumber = 1 THEN 'remove' WHEN l_linenumber = 2 THEN 'override' ELSE 'direct' END AS kind,
                      CASE WHEN l_discount > 0.07 THEN 'major' WHEN l_discount > 0.04 THEN 'minor' ELSE 'patch' END AS jump, l_quantity, l_tax, l_partkey, l_orderkey
               FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    once AS (SELECT merge_key, sum(risk) AS risk, count(*) AS findings FROM (SELECT merge_key, l_orderkey, max(l_quantity) AS risk FROM r GROUP BY ALL) GROUP BY merge_key),
    m AS (SELECT merge_key, min(l_quantity) AS from_version, max(l_quantity) AS to_version, bool_and(l_tax > 0.01) AS dev, count(DISTINCT l_partkey) AS advisories,
                 max(CASE WHEN kind = 'remove' THEN 5 WHEN kind = 'override' THEN 3 WHEN jump = 'major' THEN 5 WHEN jump = 'minor' THEN 2 ELSE 1 END) AS effort FROM r GROUP BY merge_key)
    SELECT m.*, once.risk, once.findings, once.risk / m.effort AS priority FROM m JOIN once USING (merge_key)""")
def action_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.when(F.col("l_linenumber") == 1, "remove").when(F.col("l_linenumber") == 2, "override").otherwise("direct")
    jump = F.when(F.col("l_discount") > 0.07, "major").when(F.col("l_discount") > 0.04, "minor").otherwise("patch")
    q = F.col("l_quantity")
    resolves = rows.select(F.col("s_nationkey").cast("string").alias("merge_key"), kind.alias("kind"), jump.alias("jump"), q.alias("from_version"), q.alias("from_key"), q.alias("to_version"), q.alias("to_key"), (F.col("l_tax") > 0.01).alias("dev"), F.col("l_partkey").alias("advisory"), F.col("l_orderkey").alias("finding_id"), q.alias("risk"))
    return rollups.fix_actions(resolves)


_BASE = "CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 30 THEN 'high' WHEN l_quantity >= 15 THEN 'medium' WHEN l_quantity >= 5 THEN 'low' ELSE 'info' END"
_SCORED = f"""
    s0 AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_discount, l_tax, {_BASE} AS base FROM lineitem),
    s1 AS (SELECT *, CASE base WHEN 'critical' THEN 92.0 WHEN 'high' THEN 75.0 WHEN 'medium' THEN 52.0 WHEN 'low' THEN 28.0 ELSE 8.0 END::DOUBLE AS x FROM s0),
    s2 AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN least(100.0::DOUBLE, x * 1.3::DOUBLE) ELSE x END AS x2 FROM s1),
    s3 AS (SELECT *, CASE WHEN l_tax < 0.02 THEN least(100.0::DOUBLE, x2 * 0.45::DOUBLE) ELSE x2 END AS x3 FROM s2),
    s4 AS (SELECT *, CASE WHEN l_discount > 0.08 THEN least(100.0::DOUBLE, x3 * 0.7::DOUBLE) ELSE x3 END AS x4 FROM s3),
    s5 AS (SELECT *, floor(x4 + 0.5) AS score FROM s4),
    s6 AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN greatest(score, 65.0::DOUBLE) WHEN l_linestatus = 'O' AND l_tax > 0.07 THEN least(score, 14.0::DOUBLE) ELSE score END AS final FROM s5)"""
_SEVERITY = "CASE WHEN final >= 85 THEN 'critical' WHEN final >= 65 THEN 'high' WHEN final >= 40 THEN 'medium' WHEN final >= 15 THEN 'low' ELSE 'info' END"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    base = F.when(q >= 45, "critical").when(q >= 30, "high").when(q >= 15, "medium").when(q >= 5, "low").otherwise("info")
    live, low = F.col("l_returnflag") == "R", F.col("l_discount") > 0.08
    risk = sev.risk(F.col("base"), F.lit(None).cast("double"), {"is_live": live, "is_unreachable": F.col("l_tax") < 0.02, "is_low_confidence": low})
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_tax", base.alias("base")).withColumn("risk", risk)
    final = sev.guarded(F.col("risk"), F.lit(False), (F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.07), live)
    return rows.withColumn("final", final).withColumn("severity", sev.severity_from_score(F.col("final")))


@query(f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, base, score, final, {_SEVERITY} AS severity FROM s6")
def score_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("l_orderkey", "l_linenumber", "base", F.col("risk").alias("score"), "final", "severity")


@query(f"WITH {_SCORED} SELECT {_SEVERITY} AS severity, count(*) AS n FROM s6 GROUP BY 1")
def severity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"""
    WITH {_SCORED}, g AS (SELECT l_orderkey, {_SEVERITY} AS severity, l_returnflag = 'R' AS ex FROM s6)
    SELECT l_orderkey, CASE WHEN bool_or(severity = 'critical' AND ex) THEN 'F' WHEN bool_or(severity = 'critical' OR (severity = 'high' AND ex)) THEN 'D'
                            WHEN bool_or(severity = 'high') THEN 'C' WHEN bool_or(severity = 'medium') THEN 'B' ELSE 'A' END AS grade FROM g GROUP BY l_orderkey""")
def grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("l_orderkey").agg(sev.grade(F.col("severity"), F.col("l_returnflag") == "R").alias("grade"))


@query("SELECT l_orderkey, CAST(floor((place - 1) / 3) AS BIGINT) AS batch, count(*) AS n FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place FROM lineitem) GROUP BY ALL")
def risk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.top_per(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 1 << 30)
    return rows.groupBy("l_orderkey", F.floor((F.col("place") - 1) / 3).alias("batch")).agg(F.count("*").alias("n"))


@query("""
    SELECT n_name AS node, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'prod' ELSE 'dev' END AS scope FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT r_name, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'prod' ELSE 'dev' END FROM region""")
def scope_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    nodes = region.select(F.col("r_name").alias("node")).union(nation.select("n_name"))
    return graph.scopes(nodes, edges, region.where(F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("r_name").alias("node")))


@query("""
    WITH m AS (SELECT DISTINCT l_orderkey, l_linenumber AS a, l_linenumber + CAST(l_quantity AS INTEGER) % 3 AS b FROM lineitem),
    w AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM m),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM w)
    SELECT l_orderkey, min(a) AS start_line, max(b) AS end_line FROM g GROUP BY l_orderkey, k""")
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).alias("end_line"))
    return rollups.merged_ranges(rows, "l_orderkey", "start_line", "end_line")


_FACTORS = [("l_returnflag = 'R'", 1.3), ("l_linenumber = 2 AND l_returnflag <> 'R'", 0.75), ("l_discount < 0.03", 1.15), ("l_tax < 0.02", 0.6), ("l_linenumber < 3", 1.2), ("l_linenumber > 2 AND l_linenumber < 6", 1.1),
            ("l_linestatus = 'F'", 0.4), ("l_linestatus <> 'F' AND l_discount > 0.05", 0.7), ("l_quantity < 25", 0.9)]


def _chain() -> str:
    """The score after each of _FACTORS, as SQL columns x1, x2, ... of one subquery inside the next."""
    inner = f"SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_discount, l_tax, l_quantity, greatest(CASE {_BASE} WHEN 'critical' THEN 92.0 WHEN 'high' THEN 75.0 WHEN 'medium' THEN 52.0 WHEN 'low' THEN 28.0 ELSE 8.0 END::DOUBLE, coalesce(CASE WHEN l_linenumber = 4 THEN 7.5::DOUBLE END * 10, 0)) AS x FROM lineitem"
    for condition, m in _FACTORS:
        inner = f"SELECT * REPLACE (least(100.0::DOUBLE, x * CASE WHEN {condition} THEN {m}::DOUBLE ELSE 1.0::DOUBLE END) AS x) FROM ({inner})"
    return inner


@query(f"SELECT l_orderkey, l_linenumber, floor(x + 0.5) AS score FROM ({_chain()})")
def risk_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores where flags that rule each other out hold together."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    base = F.when(q >= 45, "critical").when(q >= 30, "high").when(q >= 15, "medium").when(q >= 5, "low").otherwise("info")
    flags = {
        "is_live": F.col("l_returnflag") == "R", "is_history_only": n == 2, "is_reachable": F.col("l_discount") < 0.03, "is_dev": F.col("l_tax") < 0.02, "is_public_route": n < 3, "is_entrypoint": n < 6,
        "is_non_production": F.col("l_linestatus") == "F", "is_generated": F.col("l_discount") > 0.05, "is_medium_confidence": q < 25,
    }
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", sev.risk(base, F.when(n == 4, 7.5), flags).alias("score"))

"""Advisory, version and fix-plan queries, over packages and versions made from parts, suppliers and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import text as tx
from sievegrid.functions import versions as vs
from sievegrid.operators import advisories as adv
from sievegrid.plans.registry import query
from sievegrid.sources.tables import table

#: Packages are brands. Versions are numbers x.y.0 in order x * 100 + y.
_NUMBER = "CAST(p_size % 3 AS INTEGER) * 100 + CAST(p_partkey % 40 AS INTEGER)"
_VERSIONS = "v AS (SELECT DISTINCT p_brand AS name, CAST(p_size % 3 AS INTEGER) AS x, CAST(p_partkey % 40 AS INTEGER) AS y FROM part)"


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat_ws(".", (F.col("p_size") % 3).cast("int").cast("string"), (F.col("p_partkey") % 40).cast("string"), F.lit("0"))
    return table(spark, sf_dir, "part").select(F.when(F.col("p_brand") < "Brand#3", "npm").otherwise("PyPI").alias("ecosystem"), F.col("p_brand").alias("name"), version.alias("version")).distinct()


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OSV record for each brand: affected from 0.5.0 to 1.10.0 and from 2.20.0 on, and of some brands 1.39.0 too."""
    brand = table(spark, sf_dir, "part").select("p_brand").distinct()
    eco = F.when(F.col("p_brand") < "Brand#3", "npm").otherwise("PyPI")
    text = lambda s: F.lit(s)
    listed = F.when(F.col("p_brand").rlike("[135]$"), '"versions":["1.39.0"],').otherwise("")
    events = '[{"introduced":"0.5.0"},{"fixed":"1.10.0"},{"introduced":"2.20.0"}]'
    score = F.when(F.col("p_brand").rlike("[12]$"), '{"type":"CVSS_V3","score":"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"},{"type":"CVSS_V4","score":"CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N"}').otherwise('{"type":"CVSS_V3","score":"broken"}')
    json = F.concat(
        text('{"id":"ADV-'), "p_brand", text('","summary":"s","severity":['), score, text('],"database_specific":{"severity":"MODERATE","cwe_ids":["CWE-79"]},"affected":[{"package":{"ecosystem":"'), eco, text('","name":"'), "p_brand",
        text('"},'), listed, text('"ranges":[{"type":"SEMVER","events":'), text(events), text('},{"type":"GIT","events":[{"introduced":"0"}]}],"ecosystem_specific":{"imports":[{"symbols":["run"]}]}}]}'),
    )
    return brand.select(json.alias("json")).union(spark.createDataFrame([("{broken",), ('{"summary":"no id"}',)], "json string"))


@query(f"""
    WITH {_VERSIONS}
    SELECT CASE WHEN name < 'Brand#3' THEN 'npm' ELSE 'PyPI' END AS ecosystem, name, x || '.' || y || '.0' AS version, 'ADV-' || name AS advisory,
           CASE WHEN regexp_matches(name, '[12]$') THEN 'critical' ELSE 'medium' END AS severity, CASE WHEN regexp_matches(name, '[12]$') THEN 9.8::DOUBLE END AS cvss, 'run' AS symbols
    FROM v WHERE (x * 100 + y >= 5 AND x * 100 + y < 110) OR x * 100 + y >= 220 OR (x * 100 + y = 139 AND regexp_matches(name, '[135]$'))""")
def advisories_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adv.advisories_for(_packages(spark, sf_dir), adv.parsed(_records(spark, sf_dir)))
    return found.select("ecosystem", "name", "version", "advisory", "severity", "cvss", F.array_join("symbols", ",").alias("symbols"))


@query(f"""
    WITH {_VERSIONS}, bad AS (SELECT *, x * 100 + y AS n FROM v WHERE (x * 100 + y >= 5 AND x * 100 + y < 110) OR x * 100 + y >= 220 OR (x * 100 + y = 139 AND regexp_matches(name, '[135]$'))),
    ok AS (SELECT name, x * 100 + y AS n FROM v EXCEPT SELECT name, n FROM bad)
    SELECT b.name || '@' || b.x || '.' || b.y || '.0' AS finding_id, (min(o.n) // 100) || '.' || (min(o.n) % 100) || '.0' AS target FROM bad b JOIN ok o ON b.name = o.name AND o.n > b.n GROUP BY b.name, b.x, b.y""")
def safe_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest clean published version above each affected one."""
    packages = _packages(spark, sf_dir)
    found = adv.advisories_for(packages, adv.parsed(_records(spark, sf_dir))).withColumns({"finding_id": F.concat_ws("@", "name", "version"), "unavailable": F.lit(False)})
    published = packages.withColumnRenamed("version", "published")
    return adv.safe_upgrades(found.select("finding_id", "ecosystem", "name", "version"), found, published)[0].select("finding_id", "target")


@query("""
    WITH v AS (SELECT DISTINCT CAST(p_size % 3 AS INTEGER) AS a, CAST(p_partkey % 7 AS INTEGER) AS b, CAST(p_partkey % 5 AS INTEGER) AS c, p_size % 2 = 0 AS pre FROM part),
    n AS (SELECT *, a * 100 + b * 10 + c AS n FROM v),
    r(range) AS (VALUES ('^1.2.3'), ('~0.3'), ('>=1.1.0 <2.0.0 || 0.x'), ('1.2.1 - 2.1'), ('*'), ('>1.3'), ('<=0.4'), ('^0.2.2'), ('=1.0.0'), ('nonsense!')),
    t AS (SELECT *, CASE range WHEN '^1.2.3' THEN n >= 123 AND a < 2 WHEN '~0.3' THEN a = 0 AND b = 3 WHEN '>=1.1.0 <2.0.0 || 0.x' THEN (n >= 110 AND a < 2) OR a = 0 WHEN '1.2.1 - 2.1' THEN n >= 121 AND n < 220
                          WHEN '*' THEN true WHEN '>1.3' THEN n >= 140 WHEN '<=0.4' THEN n < 50 WHEN '^0.2.2' THEN n >= 22 AND n < 30 WHEN '=1.0.0' THEN n = 100 ELSE false END AS inside FROM n, r)
    SELECT range, a || '.' || b || '.' || c || CASE WHEN pre THEN '-rc.1' ELSE '' END AS version, inside AND NOT pre AS held FROM t""")
def npm_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    number = lambda c, m: (F.col(c) % m).cast("int").cast("string")
    version = F.concat(F.concat_ws(".", number("p_size", 3), number("p_partkey", 7), number("p_partkey", 5)), F.when(F.col("p_size") % 2 == 0, "-rc.1").otherwise(""))
    ranges = ["^1.2.3", "~0.3", ">=1.1.0 <2.0.0 || 0.x", "1.2.1 - 2.1", "*", ">1.3", "<=0.4", "^0.2.2", "=1.0.0", "nonsense!"]
    each = p.select(version.alias("version")).distinct().withColumn("range", F.explode(F.array(*map(F.lit, ranges))))
    return each.select("range", "version", vs.satisfies_npm(F.col("version"), F.col("range")).alias("held"))


@query("""
    WITH v AS (SELECT DISTINCT CAST(p_size % 3 AS INTEGER) AS a, CAST(p_partkey % 7 AS INTEGER) AS b, CAST(p_partkey % 4 AS INTEGER) AS k FROM part)
    SELECT a, max_by(b || CASE k WHEN 0 THEN '.dev1' WHEN 1 THEN 'rc2' WHEN 2 THEN '' ELSE '.post1' END, b * 10 + k) AS newest, min_by(b || CASE k WHEN 0 THEN '.dev1' WHEN 1 THEN 'rc2' WHEN 2 THEN '' ELSE '.post1' END, b * 10 + k) AS oldest,
           min_by(b || CASE k WHEN 2 THEN '' ELSE '.post1' END, b * 10 + k) FILTER (k >= 2 AND b >= 3) AS stable FROM v GROUP BY a""")
def pypi_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, ".dev1").when(k == 1, "rc2").when(k == 2, "").otherwise(".post1")
    rows = p.select((F.col("p_size") % 3).cast("int").alias("a"), F.concat((F.col("p_partkey") % 7).cast("string"), tail).alias("version")).withColumn("key", vs.pep440(F.col("version")))
    stable = vs.is_stable(F.lit("PyPI"), F.col("version")) & (F.col("key") >= vs.pep440(F.lit("3.0")))
    return rows.groupBy("a").agg(F.max_by("version", "key").alias("newest"), F.min_by("version", "key").alias("oldest"), F.min_by("version", F.when(stable, F.col("key"))).alias("stable"))


_VECTORS = {
    0: ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), 1: ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), 2: ("CVSS:3.0/AV:L/AC:H/PR:L/UI:N/S:U/C:L/I:N/A:N", 2.5), 3: ("CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:C/C:H/I:H/A:H", 9.9),
    4: ("CVSS:3.1/AV:P/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0), 5: ("CVSS:3.1/AV:A/AC:H/PR:N/UI:R/S:U/C:L/I:L/A:L", 4.6), 6: ("CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", None), 7: ("nothing", None),
}


@query(f"""
    SELECT p_partkey, CASE p_partkey % 8 {" ".join(f"WHEN {k} THEN {s}" for k, (_, s) in _VECTORS.items() if s is not None)} END::DOUBLE AS score,
           CASE p_partkey % 8 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'critical' WHEN 4 THEN 'info' WHEN 5 THEN 'medium' END AS severity FROM part""")
def cvss_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = F.array(*(F.lit(v) for v, _ in _VECTORS.values()))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(vectors, (F.col("p_partkey") % 8).cast("int")).alias("v")).withColumn("score", tx.cvss3(F.col("v")))
    return rows.select("p_partkey", "score", tx.cvss_severity(F.col("score")).alias("severity"))


@query("""
    WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier),
    d AS (SELECT k, n, k % 4 AS kind, CASE WHEN k % 4 = 0 THEN '1.2.0' WHEN k % 4 = 1 THEN '2.0.0' WHEN k % 4 = 2 THEN '1.1.0' END AS target FROM s)
    SELECT CAST(n AS VARCHAR) AS manifest_dir, CASE kind WHEN 0 THEN 'upgrade-direct' WHEN 1 THEN 'upgrade-direct' WHEN 2 THEN 'upgrade-parent' ELSE 'remove' END AS kind,
           CASE kind WHEN 0 THEN 'aa' WHEN 1 THEN 'bb' WHEN 2 THEN 'pp' ELSE 'dd' END AS package, CASE kind WHEN 0 THEN '1.2.0' WHEN 1 THEN '2.0.0' WHEN 2 THEN '3.1.0' END AS "to",
           count(*) AS findings, CAST(sum(k) AS BIGINT) AS risk, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 5 END AS effort,
           CASE kind WHEN 0 THEN 'npm install aa@1.2.0' WHEN 1 THEN 'npm install bb@2.0.0' WHEN 2 THEN 'npm install pp@3.1.0' ELSE 'npm uninstall dd' END AS command
    FROM d GROUP BY n, kind""")
def fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each supplier: in one of three packages that are direct (one of them without a fix), or in one that only a parent's next release gets rid of."""
    k = F.col("s_suppkey")
    kind = k % 4
    name = F.when(kind == 0, "aa").when(kind == 1, "bb").when(kind == 2, "cc").otherwise("dd")
    rows = table(spark, sf_dir, "supplier").select(F.lit("scan").alias("scan_id"), k.cast("string").alias("finding_id"), F.lit("npm").alias("ecosystem"), F.col("s_nationkey").cast("string").alias("manifest_dir"), F.lit("package-lock.json").alias("lockfile"), name.alias("name"), F.lit("1.0.0").alias("version"), (kind != 2).alias("direct"), F.lit(False).alias("dev"), k.cast("long").alias("risk"))
    fixed = F.when(F.col("name") == "aa", "1.2.0").when(F.col("name") == "bb", "2.0.0").when(F.col("name") == "cc", "1.1.0")
    range_ = F.array(F.struct(F.lit("0").alias("introduced"), fixed.alias("fixed"), F.lit(None).cast("string").alias("last_affected"))).cast(adv.RANGES)
    found = rows.select("finding_id", F.concat(F.lit("A-"), "name").alias("advisory"), range_.alias("ranges"), F.lit(None).cast("array<string>").alias("versions"), F.array_compact(F.array(fixed)).alias("fixed"), F.lit(False).alias("unavailable"))
    listed = [("aa", "1.1.0"), ("aa", "1.2.0"), ("aa", "1.3.0"), ("bb", "1.9.0"), ("bb", "2.0.0-rc.1"), ("bb", "2.0.0"), ("cc", "1.0.5"), ("cc", "1.1.0"), ("cc", "1.1.1"), ("dd", "1.0.1"), ("dd", "2.0.0"), ("pp", "3.0.0"), ("pp", "3.1.0"), ("pp", "3.2.0")]
    published = spark.createDataFrame([("npm", *x) for x in listed], "ecosystem string, name string, published string")
    parents = rows.where("not direct").select("finding_id", F.lit("pp").alias("parent"), F.lit("3.0.0").alias("parent_version"), F.lit(False).alias("parent_dev"), F.lit(True).alias("root"))
    ranges = spark.createDataFrame([("npm", "pp", "3.0.0", "cc", "1.0.x"), ("npm", "pp", "3.1.0", "cc", "^1.0.0"), ("npm", "pp", "3.2.0", "cc", None)], "ecosystem string, parent string, parent_version string, child string, range string")
    return adv.fix_plan(rows, found, published, parents, ranges).select("manifest_dir", "kind", "package", "to", "findings", "risk", "effort", "command")

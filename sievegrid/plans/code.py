"""Text metrics, likeness and links, over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import text as tx
from sievegrid.operators import code_text, dependencies, graph, imports, matching, rollups
from sievegrid.plans.registry import query
from sievegrid.sources.tables import table


@query("SELECT doc_id, CAST(len(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) AS INTEGER) AS lines FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_text.file_metrics(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "lines")


@query("""
    SELECT doc_id, CAST(i AS INTEGER) AS line, l[i] AS content FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS l FROM documents))
    WHERE regexp_matches(l[i], '[0-9a-f]{40}')""")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_text.lines(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("content").rlike("[0-9a-f]{40}"))


@query("""
    SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(x, '^\\s*(//|#|\\*|/\\*)'))) AS INTEGER) AS code_lines FROM documents""")
def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_text.file_metrics(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "code_lines")


@query("SELECT doc_id, sha256(source || chr(0) || lang || chr(0) || coalesce(text, '')) AS fingerprint FROM documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("source"), F.col("lang"), F.col("text")).alias("fingerprint"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_text.equal_texts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("first", "first_doc")


@query("SELECT DISTINCT doc_id, t AS token, '…' || right(t, 4) AS redacted FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9a-f]{40}\\b')) AS t FROM documents)")
def token_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9a-f]{40}\b"), F.lit(0))).alias("token")).distinct()
    return found.select("doc_id", "token", tx.redact(F.col("token")).alias("redacted"))


@query("""
    WITH c AS (SELECT p_partkey, p_name, unnest(string_split(p_name, '')) AS ch FROM part), n AS (SELECT p_partkey, ch, count(*) AS k, max(length(p_name)) AS n FROM c GROUP BY 1, 2)
    SELECT p_partkey, round(-sum(k / n::DOUBLE * log2(k / n::DOUBLE)), 6) AS bits FROM n GROUP BY 1""")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(tx.entropy(F.col("p_name")), 6).alias("bits"))


@query("""
    WITH w AS (SELECT c_custkey, list_distinct(list_filter(regexp_split_to_array(lower(c_mktsegment || ' ' || c_name), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS a,
                      list_distinct(list_filter(regexp_split_to_array(lower('building ' || c_name || ' extra'), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS b FROM customer)
    SELECT c_custkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS likeness FROM w""")
def title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tx.words_of(F.concat_ws(" ", "c_mktsegment", "c_name"))
    b = tx.words_of(F.concat(F.lit("building "), F.col("c_name"), F.lit(" extra")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(tx.jaccard(a, b), 6).alias("likeness"))


@query("""
    WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages)
    SELECT host, count(*) AS n FROM h GROUP BY host""")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(dependencies.source_host(F.col("url")).alias("host"))
    return rollups.call_counts(hosts, ["host"])


_LINKS = "links AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS target FROM pages)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.page_links(table(spark, sf_dir, "pages"), "page_id", "html")


@query(f"WITH {_LINKS} SELECT page_id, target FROM links")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


@query(f"""
    WITH {_LINKS}, s AS (SELECT 'p0' AS node), e AS (SELECT 'p' || page_id AS src, target AS dst FROM links UNION ALL SELECT target, 'p' || page_id FROM links),
    one AS (SELECT DISTINCT dst AS node FROM e JOIN s ON src = node), two AS (SELECT DISTINCT dst AS node FROM e JOIN one ON src = node)
    SELECT node, CAST(min(d) AS INTEGER) AS depth FROM (SELECT node, 0 AS d FROM s UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) GROUP BY node""")
def reach_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir).select(F.concat(F.lit("p"), "page_id").alias("page"), "target")
    edges = links.select(F.col("page").alias("src"), F.col("target").alias("dst")).union(links.select("target", "page"))
    return graph.closure(edges, spark.createDataFrame([("p0",)], "node string"), 2)


@query("SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("role", F.length("text").alias("chars"))
    return rollups.call_counts(turns, ["role"], ["chars"])


@query("""
    WITH l AS (SELECT doc_id, i AS line, x[i] AS content FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
    f AS (SELECT doc_id, line, CASE WHEN contains(content, '|') THEN 'noise' ELSE 'symbols' END AS tail FROM l WHERE contains(content, '|') OR regexp_matches(content, '[#*$%&]{3}'))
    SELECT CAST(doc_id AS VARCHAR) AS expected_id, CAST(quality AS VARCHAR) AS category, EXISTS (SELECT 1 FROM f WHERE f.doc_id = labels.doc_id AND f.line <= 4 AND f.tail = 'noise') AS found FROM labels""")
def recall_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as expected findings near a text's second line, and odd lines as what was found."""
    rows = code_text.lines(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.contains("content", F.lit("|")) | F.col("content").rlike("[#*$%&]{3}"))
    found = rows.select(F.col("doc_id").cast("string").alias("file"), F.col("line").alias("start"), F.col("line").alias("end"), F.lit(None).cast("string").alias("cwe"), F.when(F.contains("content", F.lit("|")), "noise").otherwise("symbols").alias("tail"))
    doc = F.col("doc_id").cast("string")
    wanted = table(spark, sf_dir, "labels").select(doc.alias("expected_id"), F.col("quality").cast("string").alias("category"), doc.alias("file"), F.lit(2).alias("line"), F.lit(2).alias("line_tolerance"), F.lit("CWE-0").alias("cwe"), F.lit("noise").alias("rule_hint"))
    return matching.recall(wanted, found)


@query(r"""
    WITH k AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r?\n'), lambda x, i: {'line': CAST(i AS INTEGER), 'content': trim(x, ' ')}), lambda x: x.content <> '') AS l FROM documents),
    w AS (SELECT doc_id, CAST(a AS INTEGER) AS pos, l[a].line AS line, list_transform(l[a:a + 5], lambda x: x.content) AS key FROM (SELECT doc_id, l, unnest(range(1, len(l) - 4)) AS a FROM k WHERE len(l) >= 6)),
    f AS (SELECT key, min({'file': doc_id, 'pos': pos, 'line': line}) AS first FROM w GROUP BY key HAVING count(*) > 1),
    p AS (SELECT f.first.file AS file_a, f.first.pos AS pos_a, f.first.line AS start_a, w.doc_id AS file_b, w.pos, w.line AS start_b FROM w JOIN f USING (key) WHERE w.doc_id <> f.first.file OR w.pos <> f.first.pos),
    i AS (SELECT *, pos - pos_a AS apart, pos - row_number() OVER (PARTITION BY file_a, file_b, pos - pos_a ORDER BY pos) AS island FROM p)
    SELECT file_a, min(start_a) AS start_a, file_b, min(start_b) AS start_b, count(*) + 5 AS length FROM i GROUP BY file_a, file_b, apart, island""")
def dup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_text.duplicate_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'python' WHEN p_size % 3 = 1 THEN 'typescript' ELSE 'dockerfile' END AS language, p_size % 2 = 0 AS is_test FROM part""")
def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    folder = F.when(size % 2 == 0, "tests/").otherwise("src/")
    name = F.when(size % 3 == 0, "a.py").when(size % 3 == 1, "b.tsx").otherwise("Dockerfile")
    path = F.concat(folder, F.col("p_partkey").cast("string"), F.lit("/"), name)
    return table(spark, sf_dir, "part").select("p_partkey", tx.language_of(path).alias("language"), F.array_contains(tx.tags_of(path), "test").alias("is_test"))


@query("SELECT s_suppkey, regexp_replace(lower(trim('  ' || s_name || '__X.y ')), '[-_.]+', '-', 'g') AS name FROM supplier")
def pypi_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", tx.normalize_pypi(F.concat(F.lit("  "), "s_name", F.lit("__X.y "))).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 9.8 ELSE 6.1 END::DOUBLE AS score FROM part")
def cvss_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.when(F.col("p_size") % 2 == 0, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").otherwise("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N")
    return table(spark, sf_dir, "part").select("p_partkey", tx.cvss3(vector).alias("score"))

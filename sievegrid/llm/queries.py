"""The queries of this subpackage, with production parameters, and SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sievegrid.llm import bpe_fold, clustering, fingerprints, hard_negatives, language_id, mixing, near_dup, packing, quality, quality_rules, sharding, token_counts, url_rules
from sievegrid.sources.tables import table

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"


def tokenizer_path() -> str:
    """Where the tokenizer's file is; every executor has the package."""
    return public_tokenizers.path(TOKENIZER)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over web pages, with real markup, hosts and suffixes."""
    return language_id.identify_pages(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_fold.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_fingerprints, op4_mixing, op5_quality, op6_near_dup, op7_quality_rules, op8_packing, op9_sharding, op10_url_rules, op11_byte_bpe, op12_clustering, op13_hard_negatives, page_language_id)}


def _clustering_sql(k: int = 8, rounds: int = 10) -> str:
    """All rounds in a row: an assignment of every vector, and the floors of the means."""
    parts = ["""kept AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS j, v FROM kept
        ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) LIMIT {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS MATERIALIZED (
        SELECT vec_id, arg_min(j, (d, j)) AS cluster, min(d) AS distance, any_value(v) AS v FROM (
            SELECT vec_id, j, kept.v, CAST(list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c{i}.v[i]) * (kept.v[i] - c{i}.v[i]))) AS BIGINT) AS d
            FROM kept, c{i}) GROUP BY vec_id)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
        SELECT j, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
            SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
                SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM d{i}, range(1, 65) AS t(i) GROUP BY cluster, i)
            GROUP BY cluster) AS m ON m.cluster = j)""")
    return "WITH " + ",\n".join(parts) + f"""
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM d{rounds} JOIN c{rounds} ON j = cluster"""


def oracle_sql() -> dict[str, str]:
    """The other queries' results depend on a tokenizer, trained models, sketches, hashes of Spark or a greedy plan."""
    return {
        "op12_clustering": _clustering_sql(),
        "op13_hard_negatives": """
            WITH kept AS MATERIALIZED (
                SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                       list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                FROM embeddings
                WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            scored AS MATERIALIZED (
                SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                       CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
                FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
            positives AS (
                SELECT anchor_id, id, score FROM scored WHERE same
                QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
            SELECT p.anchor_id, p.id AS positive_id,
                   CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
                   n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
            FROM positives p JOIN scored n
              ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
            QUALIFY rank <= 5
        """,
        "op10_url_rules": r"""
            WITH parts AS (
                SELECT page_id,
                       translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
                FROM pages),
            rules(rule_host, rule_path, verdict) AS (
                VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                       ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
            fits AS (
                SELECT p.*, r.rule_host || r.rule_path AS rule, r.verdict,
                       row_number() OVER (PARTITION BY p.page_id, p.host, p.path
                                          ORDER BY length(r.rule_host) DESC, length(r.rule_path) DESC) AS place
                FROM parts p LEFT JOIN rules r
                  ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
            SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
        """,
    }

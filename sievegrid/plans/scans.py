"""Event logs and as-of lookups, over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.operators import events as log
from sievegrid.operators import rollups, search
from sievegrid.plans.registry import query
from sievegrid.sources.tables import table

_SEQ = "seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(ts) // 1000 AS at_ms FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    return log.sequenced(rows, "user_id", ["ts", "event_id"]).withColumn("at_ms", F.unix_millis("ts"))


@query(f"WITH {_SEQ} SELECT event_id, user_id, seq FROM seq")
def seq_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "user_id", "seq")


@query(f"WITH {_SEQ} SELECT user_id, seq, event_type FROM seq WHERE seq > 40")
def replay_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.replay(_events(spark, sf_dir), 40).select("user_id", "seq", "event_type")


@query(f"WITH {_SEQ} SELECT user_id, event_type, max(seq) AS last_seq, max_by(value, seq) AS last_value, max_by(event_id, seq) AS last_event FROM seq GROUP BY ALL")
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.folded(_events(spark, sf_dir), ["user_id", "event_type"], {"last_value": "value", "last_event": "event_id"})


@query(f"WITH {_SEQ}, f AS (SELECT user_id, min(seq) AS stop FROM seq WHERE event_type = 'error' GROUP BY user_id) SELECT s.user_id, s.seq, s.event_type FROM seq s LEFT JOIN f USING (user_id) WHERE f.stop IS NULL OR s.seq <= f.stop")
def terminal_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.until_terminal(_events(spark, sf_dir), "user_id", "seq", F.col("event_type") == "error").select("user_id", "seq", "event_type")


@query(f"""
    WITH {_SEQ}, c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY seq) AS b FROM seq), d AS (SELECT * FROM c WHERE b IS DISTINCT FROM event_type)
    SELECT user_id, seq, event_type, at_ms AS started, coalesce(lead(at_ms) OVER (PARTITION BY user_id ORDER BY seq), -1) AS ended FROM d""")
def stage_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.timeline(_events(spark, sf_dir), "user_id", "seq", "event_type", "at_ms").withColumn("ended", F.coalesce("ended", F.lit(-1)))


@query(f"WITH {_SEQ} SELECT user_id, event_type, count(*) AS n, max(seq) AS last_seq, round(sum(value), 4) AS total FROM seq GROUP BY ALL")
def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.lanes(_events(spark, sf_dir), "user_id", "event_type", "seq", "value").withColumn("total", F.round("total", 4))


@query(f"""
    WITH RECURSIVE {_SEQ}, k(user_id, seq, at_ms) AS (
        SELECT user_id, seq, at_ms FROM seq WHERE seq = 1
        UNION ALL SELECT user_id, min(seq), min_by(at_ms, seq) FROM (
            SELECT s.user_id, s.seq, s.at_ms, k.seq AS of FROM k JOIN seq s ON s.user_id = k.user_id AND s.seq > k.seq AND (s.at_ms - k.at_ms >= 86400000 OR s.event_type = 'error')) GROUP BY user_id, of)
    SELECT user_id, seq FROM k""")
def throttle_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("final", F.col("event_type") == "error")
    return log.throttled(rows, "user_id", "at_ms", 86_400_000, final="final").select("user_id", "seq")


@query("SELECT user_id, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 00:00:00'")
def stuck_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return log.stuck(_events(spark, sf_dir), "user_id", "ts", now, 0).select("user_id", F.unix_millis("last_at").alias("last_ms"))


@query(f"""
    WITH {_SEQ}, p AS (SELECT user_id, seq, event_id FROM seq WHERE event_type = 'purchase')
    SELECT s.user_id, s.seq, max_by(p.event_id, p.seq) AS baseline FROM seq s JOIN p ON s.user_id = p.user_id AND p.seq < s.seq WHERE s.event_type = 'error' GROUP BY ALL""")
def asof_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = log.as_of(_events(spark, sf_dir), "user_id", "seq", F.col("event_type") == "purchase", "event_id", "baseline")
    return found.where("event_type = 'error' and baseline is not null").select("user_id", "seq", "baseline")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.latest_per(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT event_id, epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(ts) // 1000 <= 604800000 AS is_fresh FROM events")
def ttl_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", search.fresh(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"), 604_800_000).alias("is_fresh"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25'")
def ttl_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return log.unpurged(rows, "ts", F.lit("2024-01-25").cast("timestamp_ntz")).select("event_id")


@query(f"""
    WITH {_SEQ}, b AS (SELECT user_id, seq, value, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spent FROM seq)
    SELECT user_id, seq, spent + value <= 500.0 AS fits_first, spent + value <= 350.0 AS fits_second FROM b""")
def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.running_budget(_events(spark, sf_dir), "user_id", ["seq"], "value", 500.0, {"first": 1.0, "second": 0.7}).select("user_id", "seq", "fits_first", "fits_second")


_GENESIS = "0" * 64
_PAYLOAD = "concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority)"


@query(f"""
    WITH RECURSIVE o AS (SELECT o_custkey AS log, o_orderkey AS seq, {_PAYLOAD} AS payload, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    c AS (SELECT log, seq, n, payload, o_orderpriority, o_orderstatus, '{_GENESIS}' AS prev_hash, sha256('{_GENESIS}' || payload) AS hash FROM o WHERE n = 1
          UNION ALL SELECT o.log, o.seq, o.n, o.payload, o.o_orderpriority, o.o_orderstatus, c.hash, sha256(c.hash || o.payload) FROM c JOIN o ON o.log = c.log AND o.n = c.n + 1),
    stored AS (SELECT log, seq, CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'P' THEN payload || '!' ELSE payload END AS payload,
                      CASE WHEN o_orderpriority LIKE '2%' AND o_orderstatus = 'P' THEN 'lost' ELSE prev_hash END AS prev_hash, hash
               FROM c WHERE NOT (o_orderpriority LIKE '5%' AND o_orderstatus = 'P')),
    seen AS (SELECT *, lag(hash, 1, '{_GENESIS}') OVER (PARTITION BY log ORDER BY seq) AS before FROM stored)
    SELECT log, seq FROM seen WHERE prev_hash <> before OR hash <> sha256(prev_hash || payload)""")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as sealed logs, of which some entries have another payload since, some another link, and some are gone."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey AS log", "o_orderkey AS seq", f"{_PAYLOAD} AS payload", "o_orderstatus", "o_orderpriority")
    sealed = log.chained(orders, "log", "seq", "payload", _GENESIS)
    odd = lambda n: F.col("payload").like(f"%|P|{n}%")
    stored = sealed.where(~odd(5)).withColumns({"prev_hash": F.when(odd(2), "lost").otherwise(F.col("prev_hash")), "payload": F.when(odd(1), F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))})
    return log.chain_breaks(stored, "seq", "prev_hash", "hash", "payload", _GENESIS, "log").select("log", "seq")

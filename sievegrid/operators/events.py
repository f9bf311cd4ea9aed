"""Event logs: sequences, replay, folds, timelines and hash chains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.operators.ranking import positioned


def sequenced(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds seq, from 1 in each key."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def replay(df: DataFrame, after: int) -> DataFrame:
    return df.where(F.col("seq") > after)


def folded(df: DataFrame, keys: list[str], values: dict[str, str], seq: str = "seq") -> DataFrame:
    """The last value of each key by sequence number; no sort, only partial aggregates."""
    return df.groupBy(*keys).agg(F.max(seq).alias("last_seq"), *(F.max_by(v, seq).alias(name) for name, v in values.items()))


def until_terminal(df: DataFrame, key: str, seq: str, terminal: Column) -> DataFrame:
    """Rows up to the first terminal one of each key; later ones are ignored."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_sg_over", F.coalesce(F.max(terminal.cast("int")).over(w), F.lit(0))).where("_sg_over = 0").drop("_sg_over")


def timeline(df: DataFrame, key: str, seq: str, state: str, at: str) -> DataFrame:
    """A row for each stretch of one state: its first event's place, its start, and the start of what follows."""
    w = Window.partitionBy(key).orderBy(seq)
    steps = df.withColumn("_sg_before", F.lag(state).over(w)).where(~F.col("_sg_before").eqNullSafe(F.col(state)))
    return steps.withColumns({"started": F.col(at), "ended": F.lead(at).over(w)}).select(key, seq, state, "started", "ended")


def throttled(df: DataFrame, key: str, at_ms: str, interval_ms: int, seq: str = "seq", final: str | None = None) -> DataFrame:
    """Rows that come at least the interval after the last one kept of their key, and all that ``final`` (a boolean column) marks.

    Each key is read as a sorted stream, of which one time is held.
    """
    rows = df.repartition(key).sortWithinPartitions(key, seq)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, last, begun = None, 0, False
        for pdf in batches:
            kept = []
            ends = pdf[final] if final else [False] * len(pdf)
            for k, at, end in zip(pdf[key], pdf[at_ms], ends, strict=True):
                if not begun or not (k == of or pd.isna(k) and pd.isna(of)):
                    of, last, begun = k, at - interval_ms, True
                if stays := bool(end) or at - last >= interval_ms:
                    last = at
                kept.append(stays)
            yield pdf[kept]

    return rows.mapInPandas(keep, df.schema)


def chain_breaks(df: DataFrame, seq: str, prev_hash: str, hash_: str, payload: str, genesis: str, log: str | None = None) -> DataFrame:
    """Entries whose previous hash isn't the one before, or whose hash isn't SHA-256 of previous hash and payload.

    log: a column that parts independent chains. Every entry is joined with the one before by position, so that no task holds a chain.
    """
    placed = positioned(df, [*([log] if log else []), seq], "_sg_at")
    before = placed.select((F.col("_sg_at") + 1).alias("_sg_next"), F.col(hash_).alias("_sg_hash"), (F.col(log) if log else F.lit(0)).alias("_sg_log"))
    of_log = F.col(log).eqNullSafe(F.col("_sg_log")) if log else F.lit(True)
    joined = placed.join(before, (F.col("_sg_at") == F.col("_sg_next")) & of_log, "left")
    linked = F.col(prev_hash).eqNullSafe(F.coalesce("_sg_hash", F.lit(genesis)))
    sealed = F.col(hash_).eqNullSafe(F.sha2(F.concat(F.col(prev_hash), F.col(payload)), 256))
    return joined.where(~(linked & sealed)).select(*df.columns)


def chained(df: DataFrame, log: str, seq: str, payload: str, genesis: str) -> DataFrame:
    """log, seq, payload, prev_hash and hash: each log's entries sealed in order, for logs that are short (one row each is folded)."""
    entry = F.struct(F.col(seq).alias("seq"), F.col(payload).alias("payload"))
    logs = df.groupBy(log).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    none = F.array().cast("array<struct<seq:bigint,payload:string,prev_hash:string,hash:string>>")

    def seal(acc: Column, e: Column) -> Column:
        made = F.struct(e["seq"].cast("long").alias("seq"), e["payload"].alias("payload"), acc["last"].alias("prev_hash"), F.sha2(F.concat(acc["last"], e["payload"]), 256).alias("hash"))
        return F.struct(F.sha2(F.concat(acc["last"], e["payload"]), 256).alias("last"), F.concat(acc["done"], F.array(made)).alias("done"))

    folded_ = F.aggregate("entries", F.struct(F.lit(genesis).alias("last"), none.alias("done")), seal)["done"]
    return logs.select(log, F.explode(folded_).alias("e")).select(log, "e.seq", "e.payload", "e.prev_hash", "e.hash")


def as_of(df: DataFrame, key: str, seq: str, candidate: Column, value: str, out: str) -> DataFrame:
    """Adds ``out``: ``value`` of the last earlier row of the key that is a candidate; null where there is none."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(candidate, F.col(value)), ignorenulls=True).over(w))


def lanes(df: DataFrame, key: str, lane: str, seq: str, amount: str) -> DataFrame:
    """Events, last sequence number and summed amount of each lane of each key."""
    return df.groupBy(key, lane).agg(F.count("*").alias("n"), F.max(seq).alias("last_seq"), F.sum(amount).alias("total"))


def unpurged(df: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """Rows that are no older than the cutoff."""
    return df.where(F.col(at) >= cutoff)


def warnings_once(df: DataFrame, key: str, order: str, what: tuple[str, ...] = ("code", "message")) -> DataFrame:
    """The first warning of each code and message of a key."""
    rest = [c for c in df.columns if c not in (key, *what)]
    first = df.groupBy(key, *what).agg(F.min_by(F.struct(*rest), order).alias("_sg_row"))
    return first.select(key, *what, *(F.col(f"_sg_row.{c}").alias(c) for c in rest))


def stuck(df: DataFrame, key: str, at: str, now: Column, threshold_s: int) -> DataFrame:
    """Keys whose last event is older than the threshold."""
    return df.groupBy(key).agg(F.max(at).alias("last_at")).where(F.unix_timestamp(now) - F.unix_timestamp("last_at") > threshold_s)

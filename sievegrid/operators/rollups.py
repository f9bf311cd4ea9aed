"""Rollups of coverage, cost, reuse, fix actions and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crosstab(df: DataFrame, row: str, column: str, domain: list[str]) -> DataFrame:
    """Counts of each value of ``domain`` for each row, 0 where there are none."""
    return df.groupBy(row).pivot(column, domain).agg(F.count(F.lit(1))).na.fill(0)


def call_counts(df: DataFrame, by: list[str], sums: list[str] | None = None) -> DataFrame:
    """n, and the sum of each of ``sums``, of each combination of ``by``."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums or ()))


def call_sums(calls: DataFrame, by: str) -> DataFrame:
    """Calls, failures, tokens and cost, by ``by`` and in total (null)."""
    cost = F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 9)
    return calls.rollup(by).agg(F.count("*").alias("calls"), F.count("error_code").alias("failed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")), cost.alias("cost_usd"))


def digest(df: DataFrame, order: list[Column], most: int, by: str) -> DataFrame:
    """part, value and n: the first ``most`` rows one by one (part "top"), and counts of the rest by a column (part "tail").

    Only the top goes through a sort, which keeps ``most`` rows of each partition.
    """
    top = df.orderBy(*order).limit(most)
    counts = df.groupBy(by).agg(F.count("*").alias("n_all")).join(top.groupBy(by).agg(F.count("*").alias("n_top")), by, "left")
    rest = counts.select(F.lit("tail").alias("part"), F.col(by).alias("value"), (F.col("n_all") - F.coalesce("n_top", F.lit(0))).alias("n")).where("n > 0")
    return top.groupBy(by).agg(F.count("*").alias("n")).select(F.lit("top").alias("part"), F.col(by).alias("value"), "n").union(rest)


def running_budget(df: DataFrame, key: str, order: list[str], cost: str, budget: float, tiers: dict[str, float]) -> DataFrame:
    """Adds spent (before the row) and one flag for each tier: whether the row fits below its share of the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(w), F.lit(0.0))
    return df.withColumn("spent", spent).withColumns({f"fits_{t}": F.col("spent") + F.col(cost) <= budget * share for t, share in tiers.items()})


def merged_ranges(df: DataFrame, key: str, start: str, end: str, gap: int = 1) -> DataFrame:
    """Overlapping or adjacent intervals of each key as one."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(key, start, end, F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0).alias("_sg_new"))
    grouped = marked.withColumn("_sg_group", F.sum("_sg_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_sg_group").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_sg_group")


def cost_usd(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd: tokens at the model's price for a million; an unknown model takes the highest price of each kind."""
    top = prices.agg(*(F.max(c).alias(f"_sg_top_{c}") for c in ("input_price", "output_price")))
    priced = calls.join(prices, "model", "left").crossJoin(top)  # the latter is one row
    part = lambda kind: F.col(f"{kind}_tokens") * F.coalesce(f"{kind}_price", f"_sg_top_{kind}_price")
    return priced.withColumn("cost_usd", (part("input") + part("output")) / 1e6).select(*calls.columns, "cost_usd")


def fix_actions(resolves: DataFrame) -> DataFrame:
    """One row for each merge_key: lowest from, highest to, whether all are dev, distinct advisories, risk of distinct findings, priority.

    resolves: merge_key, kind, jump, from_version, from_key, to_version, to_key, dev, advisory, finding_id, risk.
    Effort is 5 for removal and major steps, 3 for overrides, 2 for minor steps, else 1.
    """
    once = resolves.groupBy("merge_key", "finding_id").agg(F.max("risk").alias("risk")).groupBy("merge_key").agg(F.sum("risk").alias("risk"), F.count("*").alias("findings"))
    effort = F.when(F.col("kind") == "remove", 5).when(F.col("kind") == "override", 3).when(F.col("jump") == "major", 5).when(F.col("jump") == "minor", 2).otherwise(1)
    merged = resolves.groupBy("merge_key").agg(F.min_by("from_version", "from_key").alias("from_version"), F.max_by("to_version", "to_key").alias("to_version"), F.bool_and("dev").alias("dev"), F.count_distinct("advisory").alias("advisories"), F.max(effort).alias("effort"))
    return merged.join(once, "merge_key").withColumn("priority", F.col("risk") / F.col("effort"))

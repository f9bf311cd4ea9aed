"""Ranks inside groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.sources.scratch import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def shuffle_width(df: DataFrame) -> int:
    """Number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of the column pairs."""
    return reduce(lambda a, b: a & b, (left[x].eqNullSafe(right[y]) for x, y in pairs))


def positioned(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """Adds the global 0-based position of each row in ``order``.

    A range sort spreads the rows, however skewed a leading column is, as long as
    the whole order tells rows apart. Only one row count per partition reaches the
    driver. The sorted rows are written to scratch, so that positions are stable.
    """
    sorted_rows = df.repartitionByRange(shuffle_width(df), *order).sortWithinPartitions(*order)
    pinned = materialize(sorted_rows.withColumn("_sg_row", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_sg_row", _ROW_BITS).alias("_sg_part")
    counts = sorted((r["_sg_part"], r["n"]) for r in pinned.groupBy(part).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_sg_part long, _sg_start long")  # one row per partition
    placed = pinned.withColumn("_sg_part", part).join(F.broadcast(offsets), "_sg_part")
    row = F.col("_sg_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn(out, F.col("_sg_start") + row).drop("_sg_part", "_sg_start", "_sg_row")


def ranked(df: DataFrame, group: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row inside its group, by ``order``.

    Columns of ``group`` may be null (nulls are one group). Rows equal in group
    and order get different ranks in no stated order. An empty frame stays empty.
    """
    rows = positioned(df, [*group, *order], "_sg_position")
    starts = rows.groupBy(*(F.col(c).alias(f"_sg_{i}") for i, c in enumerate(group))).agg(F.min("_sg_position").alias("_sg_first"))
    keys = [(c, f"_sg_{i}") for i, c in enumerate(group)]
    joined = rows.join(starts, same(rows, starts, keys))
    return joined.withColumn(out, F.col("_sg_position") - F.col("_sg_first")).drop("_sg_position", "_sg_first", *(k for _, k in keys))

"""Ranges of a two-column order, cut by a sample of the rows; hot keys are cut by the second column."""

from __future__ import annotations

import json
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows for each range that are looked at to cut the ranges.
LOOKED_AT = 16

Place = tuple[str | int, int]


def cuts(rows: DataFrame, n_rows: int, ranges: int) -> list[Place]:
    """At most ranges - 1 places (key, tie) of ``rows`` that cut them into parts of about equal ``weight``.

    They come from a sample of about LOOKED_AT rows for each range, and decide only what is worked on together. Each is the
    place of a row, so that row is the first of its range.
    """
    share = min(1.0, ranges * LOOKED_AT / max(n_rows, 1))
    seen = sorted((r["key"], r["tie"], r["weight"]) for r in rows.sample(share, seed=7).select("key", "tie", "weight").collect())
    total, sum_, out = sum(w for *_, w in seen), 0, set()
    for key, tie, weight in seen:
        if sum_ * ranges // max(total, 1) != (sum_ + weight) * ranges // max(total, 1):
            out.add((key, tie))
        sum_ += weight
    return sorted(out)[: ranges - 1]


def below(marks: list[Place], kind: str, key: Column, tie: Column) -> Column:
    """How many of the sorted ``marks`` (keys of SQL type ``kind``) are at or below a place, by a look at blocks of marks and then into one."""
    if not marks:
        return F.lit(0)
    step = isqrt(len(marks)) + 1
    blocks = [[{"k": k, "t": t} for k, t in marks[at : at + step]] for at in range(0, len(marks), step)]
    table = F.from_json(F.lit(json.dumps(blocks)), f"array<array<struct<k:{kind},t:bigint>>>")
    place = F.struct(key.alias("k"), tie.alias("t"))
    block = F.size(F.filter(table, lambda b: F.get(b, F.lit(0)) <= place))
    return F.when(block == 0, 0).otherwise((block - 1) * step + F.size(F.filter(F.get(table, block - 1), lambda m: m <= place)))

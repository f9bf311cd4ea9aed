"""Faceted and paged search, counts, and other lookups over findings."""

from __future__ import annotations

import base64
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.text import file_clause

MOST_ROWS, MOST_OFFSET = 200, 1_000_000


def conjunction(clauses: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def match_clauses(*, equal: dict[str, list] | None = None, file: tuple[str, str] | None = None, text: tuple[list[str], str] | None = None) -> Column:
    """A filter from facets: column values, a file spec, and free text in any of several columns (any case)."""
    clauses = [F.col(c).isin(*values) for c, values in (equal or {}).items() if values]
    if file:
        clauses.append(file_clause(F.col(file[0]), file[1]))
    if text and text[1]:
        wanted = "%" + text[1].replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        clauses.append(reduce(lambda a, b: a | b, (F.col(c).ilike(wanted) for c in text[0])))
    return conjunction(clauses)


def encode_cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(str(offset).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> int:
    """The offset of a cursor; 0 for none; an error for what isn't a cursor."""
    if not cursor:
        return 0
    try:
        offset = int(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as error:
        raise ValueError("not a cursor") from error
    if not 0 <= offset <= MOST_OFFSET:
        raise ValueError("not a cursor")
    return offset


def page(df: DataFrame, order: list[Column], limit: int, cursor: str | None = None) -> DataFrame:
    """Rows of one page and one more, which says that there is a next page."""
    return df.orderBy(*order).offset(decode_cursor(cursor)).limit(max(1, min(limit, MOST_ROWS)) + 1)


def keyset(df: DataFrame, key: str, before: int | None, limit: int) -> DataFrame:
    """Newest rows before a key; one more than ``limit``."""
    rows = df if before is None else df.where(F.col(key) < before)
    return rows.orderBy(F.desc(key)).limit(limit + 1)


def facet_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """facet, value and n: the total (facet "total") and the counts by each facet, in one pass."""
    total = F.lit(None).cast("string")
    sets = [()] + [(f,) for f in facets]
    grouped = df.select(*facets).groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, facets)).agg(F.count("*").alias("n"), *(F.grouping(f).alias(f"_g_{f}") for f in facets))
    name, value = F.lit("total"), total
    for f in facets:
        name = F.when(F.col(f"_g_{f}") == 0, f).otherwise(name)
        value = F.when(F.col(f"_g_{f}") == 0, F.col(f).cast("string")).otherwise(value)
    return grouped.select(name.alias("facet"), value.alias("value"), "n")


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, which should tell rows apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_sg_n", F.row_number().over(w)).where("_sg_n = 1").drop("_sg_n")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def in_force(status: Column, expires: Column, now: Column) -> Column:
    """The triage status if it has not lapsed; one that expires now has."""
    return F.when(expires.isNull() | (expires > now), status)


def fresh(at: Column, now: Column, ttl_ms: int) -> Column:
    """Whether something fetched ``at`` is at most ``ttl_ms`` old; equal age is fresh."""
    return F.unix_millis(now) - F.unix_millis(at) <= ttl_ms

"""Mixing sources to target weights by subset-sum budget fitting.

Documents of each source are counted by exact length. A source that is to give
more than it has gives every document once, and the rest is a budget below its
size. Of each budget the larger part is spread over the lengths in proportion;
a bounded-knapsack dynamic program over the counts that are left then fills the
remaining budget. If that misses the budget, the program is given a larger part,
at last all of it, and the closest sum counts. So many documents of each length as
the program asks for are chosen: those with the smallest seeded hash.

One row for each source goes to the driver, for the shares depend on all
sources' sizes; counts of lengths and documents stay with Spark. Documents of
size 0 are never taken. Null texts have size 0; a null source is one source and
comes last. The hash is of seed, doc_id and text, and rows are ranked by it, so
null and repeated doc_ids are counted row by row; rows that agree in all of them
are interchangeable. An empty table gives an empty result. Other columns, whatever
their names, pass through ``drawn`` and are left out by ``mix``.
"""

from __future__ import annotations

from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.operators.ranking import ranked, same
from sievegrid.sources.scratch import materialize

#: Words of a budget that the dynamic program fills at first, and how much wider it looks where that isn't enough.
WINDOW, WIDER = 8_192, 8


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\t to \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words that each source is to give.

    Sources in the order of their code points, null last, weigh ``weights`` in
    turn and share ``share`` times all sizes. A target stops at ``most`` times its
    source's size, and the excess goes to the others by weight until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = share * sum(size.values()), list(weight), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > most * size[s]]
        if not above:
            return out | {s: unit * weight[s] for s in open_}
        for s in above:
            out[s] = most * float(size[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their sum is near ``budget`` and not above.

    counts: documents of each length. Where the window doesn't reach the budget (or the multiple of all lengths'
    common divisor below it), it is widened, up to the whole budget; then the sum is the largest that there is.
    """
    if budget >= sum(x * n for x, n in counts.items()):
        return dict(counts)
    unit = gcd(*counts)
    small, goal = {x // unit: n for x, n in counts.items()}, budget // unit
    best, most, window = {}, -1, WINDOW
    while True:
        taken = _filled(small, goal, window)
        if (made := sum(x * n for x, n in taken.items())) > most:
            best, most = taken, made
        if most == goal or window >= goal:
            return {x * unit: n for x, n in best.items()}
        window *= WIDER


def _filled(counts: dict[int, int], budget: int, window: int) -> dict[int, int]:
    """All but ``window`` of the budget spread in proportion, and the rest filled by the dynamic program."""
    total = sum(x * n for x, n in counts.items())
    spread = max(0, budget - window)
    taken, seen, used = {}, 0, 0
    for x in sorted(counts, reverse=True):
        seen += x * counts[x]
        taken[x] = max(0, min(counts[x], (spread * seen // total - used) // x))
        used += taken[x] * x
    rest = budget - used
    reached, steps = 1, []  # bit s: a sum of s can be made
    whole = (1 << (rest + 1)) - 1
    for x in sorted(counts, reverse=True):
        n, k = min(counts[x] - taken[x], rest // x), 1
        while n > 0 and not reached >> rest & 1:
            k = min(k, n)
            new = reached << (x * k) & whole & ~reached
            if new:
                low = (new & -new).bit_length() - 1
                steps.append((x, k, low, new >> low))
                reached |= new
            n, k = n - k, 2 * k
        if reached >> rest & 1:
            break
    at = reached.bit_length() - 1
    for x, k, low, new in reversed(steps):
        if at >= low and new >> (at - low) & 1:
            taken[x] += k
            at -= x * k
    return taken


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with the columns that the plan is made and applied by."""
    text = F.col("text").cast("string")
    return docs.withColumns({"_sg_source": F.col("source").cast("string"), "_sg_size": word_count(text), "_sg_hash": F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), text)})


def planned(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 20) -> DataFrame:
    """A row for each row of ``docs``: doc_id, _sg_source, _sg_size, _sg_hash, _sg_rank, and what the mix asks of its source and length.

    _sg_all and _sg_target are its source's; a row is taken _sg_copies times, and once more if its rank (among the rows of its
    source and length, by seeded hash) is below _sg_more.
    """
    spark = docs.sparkSession
    rows = materialize(sized(docs, seed).select(F.col("doc_id").alias("_sg_id"), "_sg_source", "_sg_size", "_sg_hash"), "lengths")
    lengths = materialize(rows.groupBy("_sg_source", "_sg_size").agg(F.count("*").alias("_sg_n")), "length_counts")
    sizes = [(r["_sg_source"], r["size"]) for r in lengths.groupBy("_sg_source").agg(F.sum(F.col("_sg_size") * F.col("_sg_n")).alias("size")).collect()]
    size, goal = dict(sizes), targets(sizes, weights, share, most)
    goals = spark.createDataFrame([(s, size[s], float(t)) for s, t in goal.items()], "_sg_s string, _sg_all long, _sg_target double")
    of_source = lengths.join(goals, same(lengths, goals, [("_sg_source", "_sg_s")])).drop("_sg_s")

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = {int(x): int(n) for x, n in zip(pdf["_sg_size"], pdf["_sg_n"], strict=True) if x > 0}
        all_, want = int(pdf["_sg_all"].iloc[0]), round(pdf["_sg_target"].iloc[0])
        copies = want // all_ if all_ else 0
        more = fit(counts, want - copies * all_)
        return pdf.drop(columns="_sg_n").assign(_sg_copies=copies, _sg_more=[more.get(int(x), 0) for x in pdf["_sg_size"]])

    fields = "_sg_source string, _sg_size long, _sg_all long, _sg_target double, _sg_copies long, _sg_more long"
    asked = materialize(of_source.groupBy("_sg_source").applyInPandas(ask, fields), "asked").withColumnsRenamed({"_sg_source": "_sg_s", "_sg_size": "_sg_n"})
    order = ranked(rows, ["_sg_source", "_sg_size"], ["_sg_hash", "_sg_id"], "_sg_rank")
    return order.join(asked, same(order, asked, [("_sg_source", "_sg_s"), ("_sg_size", "_sg_n")])).drop("_sg_s", "_sg_n")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes) of every row of ``docs``."""
    taken = F.col("_sg_size") * (F.col("_sg_copies") + (F.col("_sg_rank") < F.col("_sg_more")).cast("long"))
    return planned(docs.select("doc_id", "text", "source"), **how).select(F.col("_sg_id").alias("doc_id"), F.col("_sg_size").alias("size"), F.col("_sg_all").alias("source_size"), F.col("_sg_target").alias("target"), taken.alias("taken"))


def drawn(docs: DataFrame, seed: int = 20, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with its columns.

    Rows meet their source's and length's plan by the hash of the last row that it takes once more. Rows that agree in doc_id,
    text and source share a hash; where the plan takes only some of those, one of them stands for what is taken of them.
    """
    keys = ["_sg_source", "_sg_size"]
    rows = materialize(planned(docs.select("doc_id", "text", "source"), seed=seed, **how), "mix")
    cut = rows.groupBy(*keys).agg(F.first("_sg_copies").alias("_sg_copies"), F.max(F.when(F.col("_sg_rank") < F.col("_sg_more"), F.col("_sg_hash"))).alias("_sg_cut"))
    plan = materialize(cut.where("_sg_copies > 0 or _sg_cut is not null").withColumnsRenamed({"_sg_source": "_sg_s", "_sg_size": "_sg_n"}), "cuts")
    at_cut = rows.join(plan.select("_sg_s", "_sg_n", "_sg_cut"), same(rows, plan, [("_sg_source", "_sg_s"), ("_sg_size", "_sg_n")])).where(F.col("_sg_hash") == F.col("_sg_cut"))
    some = at_cut.groupBy(*keys).agg(F.count("*").alias("_sg_all"), F.count_if(F.col("_sg_rank") < F.col("_sg_more")).alias("_sg_some")).where("_sg_some < _sg_all")
    ties = materialize(some.select(F.col("_sg_source").alias("_sg_x"), F.col("_sg_size").alias("_sg_y"), "_sg_some"), "ties")

    met = sized(docs, seed)
    met = met.join(plan, same(met, plan, [("_sg_source", "_sg_s"), ("_sg_size", "_sg_n")]))
    met = met.join(ties, same(met, ties, [("_sg_source", "_sg_x"), ("_sg_size", "_sg_y")]), "left")
    tied = F.col("_sg_some").isNotNull() & (F.col("_sg_hash") == F.col("_sg_cut"))
    more = F.coalesce(((F.col("_sg_hash") <= F.col("_sg_cut")) & ~tied).cast("long"), F.lit(0))
    times = lambda df, n: df.where(n > 0).withColumn("_sg_copy", F.explode(F.sequence(F.lit(1), n.cast("int")))).select(*docs.columns)
    out = times(met, F.when(F.col("_sg_size") > 0, F.col("_sg_copies") + more))
    if ties.isEmpty():
        return out
    one = met.where(tied & (F.col("_sg_size") > 0)).groupBy(*keys).agg(F.first("_sg_some").alias("_sg_some"), F.first(F.struct(*(F.col(c) for c in docs.columns))).alias("_sg_row"))
    return out.union(times(one.select("_sg_some", "_sg_row.*"), F.col("_sg_some")))

"""Longest-processing-time scheduling of groups that stay together.

Groups are sorted by size, and each goes to the least-loaded shard of a heap.
Groups of one size are alike to the schedule, so it is made on the number of
groups of each exact size: where the least-loaded shards are within one size of
each other they take turns, as many rounds at once as the next shard's load
allows. Spark counts groups, ranks those of a size, and gives each group the
shard that its rank has.

The driver sees one row for each different group size. Sizes that differ add up,
so a table of T bytes has at most the root of 2 T of them; real texts have some
hundred thousand.

Equal texts are one group; null texts count as the empty text. Repeated rows
count each; ties in a size go by the hash of the text. An empty table gives an
empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.operators.ranking import ranked
from sievegrid.sources.scratch import materialize

ROW_BYTES = 16

Turn = tuple[int, list[int]]  # first rank, and shards that take turns from there on


def schedule(counts: dict[int, int], shards: int) -> dict[int, list[Turn]]:
    """Turns of the groups of each size, from the number of groups of each size: largest first, each to the least-loaded shard."""
    loads = [(0, s) for s in range(shards)]
    out: dict[int, list[Turn]] = {}
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        turns = out[size] = []
        while left:
            front = [heapq.heappop(loads)]
            while loads and len(front) < left and loads[0][0] < front[0][0] + size:
                front.append(heapq.heappop(loads))
            rounds = left // len(front)
            if loads:  # the last of the front takes its turn before the next shard is the least-loaded one
                rounds = min(rounds, max(0, loads[0][0] - front[-1][0]) // size + 1)
            turns.append((rank, [s for _, s in front]))
            rank, left = rank + rounds * len(front), left - rounds * len(front)
            for load, shard in front:
                heapq.heappush(loads, (load + rounds * size, shard))
    return out


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row.

    size is the text's UTF-8 bytes plus ROW_BYTES; slot counts the rows of a shard from 0.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"))
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    counts = {r["bytes"]: r["n"] for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()}
    turns = schedule(counts, shards)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("order", pa.list_(pa.int32()))]))
    table = pa.table({"bytes": pa.array(list(turns), pa.int64()), "turns": pa.array([[{"first": f, "order": o} for f, o in t] for t in turns.values()], kind)})
    plan = materialize(spark.createDataFrame(table), "shards")  # its size is known then, and the join is planned by it
    placed = ranked(groups, ["bytes"], ["group"], "_sg_rank").join(plan, "bytes")
    turn = F.element_at(F.filter("turns", lambda t: t["first"] <= F.col("_sg_rank")), -1)
    mine = placed.withColumn("turn", turn).select("group", F.get("turn.order", ((F.col("_sg_rank") - F.col("turn.first")) % F.size("turn.order")).cast("int")).alias("shard"))
    out = ranked(rows.join(mine, "group"), ["shard"], ["doc_id", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

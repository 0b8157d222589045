"""Prefix doubling: ranks by 2 L symbols from ranks by L.

A rank is the number of smaller suffixes of the string, so refining it needs only the suffixes that
share it: no window is global. Suffixes whose rank is unique are resolved and leave; each round
writes the active ones, and what it resolved is a log. To look up the ranks further on, a round reads
the logs; once the active suffixes are few, they are broadcast to the logs, which no round shuffles
then. Between rounds there are tables in the shared folder.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import keep

#: Active suffixes that are broadcast: two numbers each, some 64 MB as a hash table. More are joined by a shuffle.
FEW = 1 << 20


def shifted(active: DataFrame, ranks: DataFrame, length: int) -> DataFrame:
    """active with `next`, the rank `length` positions on (null past the string's end)."""
    ahead = ranks.select("sid", (F.col("pos") - length).alias("pos"), F.col("rank").alias("next"))
    return active.join(ahead, ["sid", "pos"], "left")


def reached(active: DataFrame, ranks: DataFrame, length: int, few: bool) -> DataFrame:
    """As shifted, for suffixes that share their first `length` symbols with another of their string: these hold no end, so
    all of them have a next rank, and the join may turn either way. few: the active ones may be broadcast."""
    ahead = ranks.select("sid", (F.col("pos") - length).alias("pos"), F.col("rank").alias("next"))
    return ahead.join(F.broadcast(active) if few else active, ["sid", "pos"]).select("sid", "pos", "rank", "next")


def triplets(pairs: DataFrame) -> DataFrame:
    """sid, rank, next, cnt: how many active suffixes have a pair of ranks."""
    return pairs.groupBy("sid", "rank", "next").agg(F.count(F.lit(1)).alias("cnt"))


def refine(pairs: DataFrame) -> DataFrame:
    """sid, pos, rank, cnt: new ranks, and how many suffixes share them. Both windows use one exchange and sort."""
    order = W.partitionBy("sid", "rank").orderBy("next")
    same = W.partitionBy("sid", "rank", "next")
    return pairs.select("sid", "pos", (F.col("rank") + F.rank().over(order) - 1).alias("rank"), F.count(F.lit(1)).over(same).alias("cnt"))


def refine_counts(pairs: DataFrame) -> DataFrame:
    """As refine, by way of the triplets: a rank that very many suffixes share is a row for each next rank there, not a
    window over its suffixes."""
    before = W.partitionBy("sid", "rank").orderBy("next").rowsBetween(W.unboundedPreceding, -1)
    new = triplets(pairs).withColumn("new", F.col("rank") + F.coalesce(F.sum("cnt").over(before), F.lit(0)))
    new = new.select(F.col("sid").alias("s"), F.col("rank").alias("r"), F.col("next").alias("x"), "new", "cnt")
    on = (F.col("sid") == F.col("s")) & (F.col("rank") == F.col("r")) & F.col("next").eqNullSafe(F.col("x"))
    return pairs.join(new, on).select("sid", "pos", F.col("new").alias("rank"), "cnt")


def apply_ranks(ranks: DataFrame, updates: DataFrame) -> DataFrame:
    """ranks with the updates' ranks where there are any."""
    new = updates.select("sid", "pos", F.col("rank").alias("new"))
    return ranks.join(new, ["sid", "pos"], "left").select("sid", "pos", F.coalesce("new", "rank").alias("rank"))


def run(initial: DataFrame, k: int, preaggregate: bool = False) -> tuple[DataFrame, list[dict]]:
    """sid, pos, rank with unique ranks, from ranks by k symbols (sid, pos, rank, cnt); and a row of metrics a round."""
    now, logs, metrics, length = keep(initial), [], [], k
    while True:
        logs.append(now.where("cnt = 1").select("sid", "pos", "rank"))
        active = now.where("cnt > 1").select("sid", "pos", "rank")
        before = active.count()
        if not before:
            return reduce(DataFrame.unionByName, logs), metrics
        began = time.time()
        pairs = reached(active, reduce(DataFrame.unionByName, [*logs, active]), length, before <= FEW)
        now = keep((refine_counts if preaggregate else refine)(pairs))
        if (after := now.count()) != before:
            raise RuntimeError(f"a round of {before} active suffixes returned {after}")
        metrics.append({"round": len(metrics) + 1, "length": length, "active_in": before, "active_out": now.where("cnt > 1").count(), "seconds": time.time() - began})
        length *= 2

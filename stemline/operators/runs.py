"""Runs of equal ranks, and what they say about a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lower ends of the classes of run lengths (fixed values).
CLASSES = (1, 2, 3, 4, 5, (1 << 8) + 1, (1 << 16) + 1, (1 << 24) + 1)


def rank_runs(ranks: DataFrame) -> DataFrame:
    """sid, rank, cnt."""
    return ranks.groupBy("sid", "rank").agg(F.count(F.lit(1)).alias("cnt"))


def length_distribution(runs: DataFrame) -> DataFrame:
    """least, n_runs, n_positions: runs by class of length; a class reaches to the next one's least."""
    least = F.coalesce(*[F.when(F.col("cnt") >= c, F.lit(c).cast("long")) for c in reversed(CLASSES)])
    return runs.groupBy(least.alias("least")).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("cnt").alias("n_positions"))


def windows(active: DataFrame, chunk: int) -> DataFrame:
    """sid, chunk, low, high: the first and last active position of each chunk that has any."""
    return active.groupBy("sid", F.floor(F.col("pos") / chunk).alias("chunk")).agg(F.min("pos").alias("low"), F.max("pos").alias("high"))


def joint_walk(first: DataFrame, second: DataFrame) -> DataFrame:
    """sid, rank, next, cnt of two run lists over the same elements: first (sid, run, rank, cnt) and second (sid, run, next,
    cnt), each in the order of run. Parts of runs that overlap are joined; cumulated counts are the bounds."""
    from pyspark.sql import Window as W

    def bounds(runs: DataFrame, value: str) -> DataFrame:
        upto = F.sum("cnt").over(W.partitionBy("sid").orderBy("run").rowsBetween(W.unboundedPreceding, 0))
        return runs.select("sid", value, (upto - F.col("cnt")).alias(f"{value}_from"), upto.alias(f"{value}_to"))

    both = bounds(first, "rank").join(bounds(second, "next"), "sid").where("rank_from < next_to and next_from < rank_to")
    return both.select("sid", F.greatest("rank_from", "next_from").alias("at"), "rank", "next", (F.least("rank_to", "next_to") - F.greatest("rank_from", "next_from")).alias("cnt"))

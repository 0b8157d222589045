"""Checks of a suffix array in time linear in its length: no text is compared beyond one symbol.

Two suffixes in rank order are in text order if their first symbols are, or if these are equal and
the suffixes one position on are in rank order, which is checked for them too.

Every table is read once: what the checks need of a position meets in one exchange by position, and
what they need of a rank in a second one by rank. No key has more rows than the tables have copies
of it, so neither skews. Where a task holds a string and its rows, as for strings sorted there, it
checks them itself (holds), and nothing of them is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKS = ("length", "range", "permutation", "agreement", "order")


def holds(b: bytes, rank: np.ndarray, pos: np.ndarray) -> bool:
    """Whether rows of rank and pos, in any order, are the suffix array of b: all checks of report, for one string."""
    n = len(b) + 1
    if len(rank) != n or len(pos) != n or not all(0 <= x.min() and x.max() < n for x in (rank, pos)):
        return False
    at, ranks = np.full(n, -1), np.full(n + 1, -1)  # past the end: smaller than any rank
    at[rank], ranks[pos] = pos, rank
    if at.min() < 0 or ranks[:n].min() < 0:
        return False
    code = np.append(np.frombuffer(b, np.uint8).astype(np.int64) + 1, 0)
    # a symbol and the rank one position on as one number
    key = (code * (n + 1) + ranks[1:] + 1)[at]
    return bool((key[1:] > key[:-1]).all())


def _rows(df: DataFrame, keep: tuple[str, ...], schema: dict[str, str], *rows: dict[str, Column]) -> DataFrame:
    """For each row of df one row per given one, of the columns of schema; those not given are null."""
    structs = [F.struct(*[r.get(c, F.lit(None)).cast(t).alias(c) for c, t in schema.items()]) for r in rows]
    return df.select(*keep, F.inline(F.array(*structs)))


def report(symbols: DataFrame, isa: DataFrame, sa: DataFrame) -> DataFrame:
    """check, violations, n_positions. symbols: sid, pos, code; isa: sid, pos, rank; sa: sid, rank, pos.

    length: positions without just one rank, and ranks of positions that no string has. range: ranks that aren't 0 to the
    string's length. permutation: ranks given twice. agreement: ranks at which sa and isa name other positions, or only one
    does. order: neighbours in rank that aren't in text order. No strings: no violations, no positions."""
    at = {"pos": "long", "code": "int", "rank": "long", "next": "long"}
    p, r = F.col("pos"), F.col("rank")
    by_pos = _rows(symbols, ("sid",), at, {"pos": p, "code": F.col("code")}).unionByName(_rows(isa, ("sid",), at, {"pos": p, "rank": r}, {"pos": p - 1, "next": r}))
    by_pos = by_pos.groupBy("sid", "pos").agg(F.max("code").alias("code"), F.max("rank").alias("rank"), F.max("next").alias("next"), F.count("rank").alias("ranks"))
    # the shifted copy of position 0 has no other rows
    by_pos = by_pos.where("code is not null or ranks > 0")

    of = {"rank": "long", "pos": "long", "code": "int", "next": "long", "code2": "int", "next2": "long", "ranks": "int", "position": "int", "wrong": "int", "other": "long"}
    code, following = F.col("code"), F.coalesce("next", F.lit(-1))
    own = {"rank": r, "pos": p, "code": code, "next": following, "ranks": F.col("ranks"), "wrong": (code.isNull() | (F.col("ranks") != 1)).cast("int")}
    by_rank = _rows(by_pos, ("sid",), of, own, {"rank": r - 1, "code2": code, "next2": following}, {"rank": F.when(code.isNotNull(), p), "position": F.lit(1)})
    by_rank = by_rank.unionByName(_rows(sa, ("sid",), of, {"rank": r, "other": p}))
    first = {c: F.max(c).alias(c) for c in ("code", "next", "code2", "next2")}
    by_rank = by_rank.groupBy("sid", "rank").agg(
        *first.values(), F.sum("position").alias("position"), F.sum("wrong").alias("wrong"), F.count("pos").alias("n_isa"), F.count("other").alias("n_sa"),
        F.sum("pos").alias("pos"), F.sum("other").alias("other"), F.max("ranks").alias("ranks"),
    )
    held = r.isNotNull() & (F.col("n_isa") > 0)
    rules = {
        "length": F.col("wrong"),
        "range": F.when(held & F.col("position").isNull(), F.col("n_isa")),
        "permutation": F.when(held & ((F.col("n_isa") > 1) | (F.col("ranks") > 1)), 1),
        "agreement": F.when(r.isNotNull() & ((F.col("n_isa") != F.col("n_sa")) | ~F.col("pos").eqNullSafe(F.col("other"))), 1),
        "order": F.when(held & ~((F.col("code") < F.col("code2")) | (F.col("code") == F.col("code2")) & (F.col("next") < F.col("next2"))), 1),
    }
    total = by_rank.agg(F.coalesce(F.sum("position"), F.lit(0)).alias("n_positions"), *[F.coalesce(F.sum(rules[c]), F.lit(0)).alias(c) for c in CHECKS])
    return total.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in CHECKS])), "n_positions")

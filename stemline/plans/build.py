"""Suffix arrays of all strings of a table."""

from __future__ import annotations

from functools import reduce
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, choose_k
from ..operators import doubling, local, symbols, verify
from ..sources import texts as sources
from ..storage import keep


class Parts(NamedTuple):
    """What a build was made of: its strings, its tables, and those of its strings that were sorted in tasks (near) and of
    the others (far; none: null)."""

    texts: DataFrame
    sa: DataFrame
    isa: DataFrame
    near: DataFrame
    near_sa: DataFrame
    far: DataFrame | None
    far_sa: DataFrame | None


class SuffixArray(NamedTuple):
    """sa: sid, rank, pos. isa: sid, pos, rank. metrics: a row for each doubling round."""

    sa: DataFrame
    isa: DataFrame
    metrics: list[dict]
    parts: Parts | None = None


def _workers_import_this(df: DataFrame) -> None:
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))


def from_pieces(pieces_of, config: Config | None = None) -> SuffixArray:
    """By prefix doubling over the cluster. pieces_of(overlap): the strings as pieces with so many bytes of overlap."""
    config = config or Config()
    k = config.k
    if k is None or config.max_byte is not None:
        histogram = symbols.byte_histogram(pieces_of(0)).cache()
        if config.max_byte is not None and (bad := symbols.check_bytes(histogram, config.max_byte).first())["n_invalid"]:
            raise ValueError(f"{bad['n_invalid']} bytes are over {config.max_byte}")
        k = k or choose_k(histogram.count(), config.chunk_size)
        histogram.unpersist()
    isa, metrics = doubling.run(symbols.initial_ranks(pieces_of(k - 1), k), k, config.preaggregate)
    return SuffixArray(isa.select("sid", "rank", "pos"), isa, metrics)


def build(texts: DataFrame, config: Config | None = None) -> SuffixArray:
    """Of a table of strings (sid, b): those of at most config.local_bytes are sorted where they are, without a shuffle;
    longer ones go through prefix doubling."""
    config = config or Config()
    _workers_import_this(texts)
    if config.max_byte is not None:
        bad = symbols.check_bytes(symbols.byte_histogram(sources.pieces(texts, 0)), config.max_byte).first()["n_invalid"]
        if bad:
            raise ValueError(f"{bad} bytes are over {config.max_byte}")
    small = F.octet_length("b") <= config.local_bytes
    near = texts.where(small)
    sa, metrics = local.suffix_arrays(near), []
    near_sa, far, far_sa, long = sa, None, None, texts.where(~small)
    if not long.select("sid").isEmpty():
        built = from_pieces(lambda overlap: sources.pieces(long, overlap), Config(config.memory, config.chunk, config.k, None, config.local_bytes, config.preaggregate))
        far, far_sa, metrics = long, built.sa, built.metrics
        sa = sa.unionByName(far_sa)
    isa = sa.select("sid", "pos", "rank")
    return SuffixArray(sa, isa, metrics, Parts(texts, sa, isa, near, near_sa, far, far_sa))


def verify_build(texts: DataFrame, result: SuffixArray) -> DataFrame:
    """check, violations, n_positions. Strings that a build sorted in tasks are checked there; what shuffles a row a position
    is left for those that fail, whose number comes again, or that went through prefix doubling, and for tables that aren't
    the build's own."""
    parts = result.parts
    if parts is None or parts.texts is not texts or parts.sa is not result.sa or parts.isa is not result.isa:
        return verify.report(symbols.symbols(sources.pieces(texts, 0)), result.isa, result.sa)
    checked = keep(local.checks(parts.near))
    numbers = checked.select("sid", "right", "n_positions")
    if parts.far is not None:
        numbers = numbers.unionByName(parts.far.select("sid", F.lit(True).alias("right"), F.lit(0).cast("long").alias("n_positions")))
    doubtful = keep(numbers.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.every("right").alias("right")).where("n > 1 or not right").select("sid"))
    rest = [] if parts.far is None else [(parts.far, parts.far_sa)]
    if n := doubtful.count():
        of = F.broadcast(doubtful) if n <= doubling.FEW else doubtful
        rest.append(tuple(x.join(of, "sid", "left_semi") for x in (parts.near, parts.near_sa)))
        checked = checked.join(of, "sid", "left_anti")
    held = checked.agg(F.coalesce(F.sum("n_positions"), F.lit(0)).alias("n_positions"))
    out = held.select(F.explode(F.array(*map(F.lit, verify.CHECKS))).alias("check"), F.lit(0).cast("long").alias("violations"), "n_positions")
    if not rest:
        return out
    strings, sa = (reduce(DataFrame.unionByName, x) for x in zip(*rest, strict=True))
    other = verify.report(symbols.symbols(sources.pieces(strings, 0)), sa.select("sid", "pos", "rank"), sa)
    return out.unionByName(other).groupBy("check").agg(F.sum("violations").alias("violations"), F.sum("n_positions").alias("n_positions"))

"""Texts as tables of (sid, b): a string's number and its bytes; and as pieces of bounded size.

Columns besides these are ignored. A null text is empty. A string's number must be unique; rows whose number is null
are no strings and are left out, whatever their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a piece. A piece also holds what follows, as far as the reader asks, so windows over its end are whole.
PIECE = 1 << 14


def from_column(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("sid"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("b"))


def joined(df: DataFrame, id_col: str, text_col: str, separator: str = "\n") -> DataFrame:
    """All texts in order of their id as one string, sid 0. It is one row, so this is for tables of names and the like."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("k"), F.col(text_col).alias("t"))))
    return df.agg(F.array_join(F.transform(ordered, lambda x: x["t"]), separator).cast("binary").alias("b")).select(F.lit(0).cast("long").alias("sid"), F.coalesce("b", F.lit(b"")).alias("b"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of under 2 GB as strings, numbered by path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("sid"), F.col("content").alias("b"))


def pieces(texts: DataFrame, overlap: int, piece: int = PIECE) -> DataFrame:
    """sid, start, n, b: positions start to start + n - 1 of each string, its end position (the sentinel's) included, and
    the bytes from start on, `overlap` more than n where the string has them."""
    n = F.octet_length("b")
    out = texts.select("sid", "b", n.alias("len"), F.explode(F.sequence(F.lit(0), n, F.lit(piece))).alias("start"))
    return out.select(
        "sid", F.col("start").cast("long").alias("start"), F.least(F.lit(piece), F.col("len") + 1 - F.col("start")).alias("n"),
        F.substring("b", F.col("start") + 1, F.lit(piece + overlap)).alias("b"),
    )

"""Symbols, alphabets and k-mers of texts.

pieces: a table of sid, start, n, b (sources.texts.pieces or the byte_ranges source). Every string has
one more position than bytes: the last holds the sentinel, symbol 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bytes import symbol

#: K-mers of up to so many bytes are numbers of 64 bits, in base 257.
NUMBERS = 7
#: Positions that a task counts at a time.
POSITIONS = 1 << 20


def _positions(pieces: DataFrame, k: int, column: str, kind: str, value) -> DataFrame:
    """sid, pos and a column made by value(data, at, size): from the bytes of many pieces, where each position's begin and
    how many of its k there are. Pieces are read some 2^16 positions at a time, whatever a batch holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, b = batch.column(0), batch.column(3).cast(pa.large_binary())
            start, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
            ends = np.frombuffer(b.buffers()[1], np.int64)[b.offset : b.offset + len(b) + 1]
            # one byte more, for the sentinel after the last text
            data = np.append(np.frombuffer(b.buffers()[2] or b"", np.uint8)[: ends[-1]], np.uint8(0))
            upto = np.cumsum(n)
            cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1], 1 << 16)), len(n))) if len(n) else []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                m = n[low:high]
                row = np.repeat(np.arange(low, high), m)
                within = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
                at = ends[row] + within
                made = value(data, at, np.clip(ends[row + 1] - at, 0, k))
                yield pa.RecordBatch.from_arrays([sid.take(pa.array(row)), pa.array(start[row] + within), made], ["sid", "pos", column])

    sid = pieces.schema["sid"].dataType.simpleString()
    return pieces.select("sid", "start", "n", "b").mapInArrow(run, f"sid {sid}, pos long, {column} {kind}")


def kmers(pieces: DataFrame, k: int) -> DataFrame:
    """sid, pos, kmer: the k bytes from each position, fewer at a string's end, none at the sentinel. Binary order of
    k-mers is the order of suffixes by their first k symbols."""

    # a function of its own here goes to the workers by value, so they needn't import this package
    def strings(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(size)])
        held = data[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])]
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(held)])

    return _positions(pieces, k, "kmer", "binary", strings)


def symbols(pieces: DataFrame) -> DataFrame:
    """sid, pos, code: 1 to 256 for bytes, 0 for the sentinel."""
    return _positions(pieces, 1, "code", "int", lambda data, at, size: pa.array(np.where(size > 0, data[at].astype(np.int32) + 1, 0).astype(np.int32)))


def _counts(pieces: DataFrame, k: int) -> DataFrame:
    """kmer, cnt, several rows a k-mer: tasks count pieces of some POSITIONS at a time, as numbers whose digits are the
    symbols, so what is shuffled is k-mers and not positions. Memory is bounded by POSITIONS, whatever a text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(keys: list[np.ndarray]) -> pa.RecordBatch:
            key, cnt = np.unique(np.concatenate(keys), return_counts=True)
            digits = np.stack([key // 257 ** (k - 1 - j) % 257 for j in range(k)], axis=1)
            sizes = (digits > 0).sum(axis=1)
            # digits past a string's end are the last ones: what stays of each row is a prefix
            data = (digits[digits > 0] - 1).astype(np.uint8)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            kmer = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays([kmer, pa.array(cnt.astype(np.int64))], ["kmer", "cnt"])

        keys, held = [], 0
        for batch in batches:
            for n, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                digits = np.zeros(n + k - 1, np.int64)
                read = np.frombuffer(b.as_buffer(), np.uint8)[: n + k - 1]
                digits[: len(read)] = read
                digits[: len(read)] += 1
                key = digits[:n].copy()
                for j in range(1, k):
                    key *= 257
                    key += digits[j : j + n]
                keys.append(key)
                held += n
                if held >= POSITIONS:
                    yield counted(keys)
                    keys, held = [], 0
        if keys:
            yield counted(keys)

    return pieces.select("n", "b").mapInArrow(run, "kmer binary, cnt long")


def byte_histogram(pieces: DataFrame) -> DataFrame:
    """byte, cnt over all strings. The sentinel is no byte."""
    return kmer_histogram(pieces, 1).where(F.octet_length("kmer") > 0).select((symbol(F.col("kmer")) - 1).alias("byte"), "cnt")


def check_bytes(histogram: DataFrame, max_byte: int) -> DataFrame:
    """One row: n_bytes and n_invalid, those over max_byte."""
    return histogram.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum(F.when(F.col("byte") > max_byte, F.col("cnt"))), F.lit(0)).alias("n_invalid"))


def dense_alphabet(histogram: DataFrame) -> DataFrame:
    """byte, code: codes 1 to sigma in the bytes' order. At most 256 rows, so one task ranks them."""
    return histogram.select("byte", F.dense_rank().over(W.orderBy("byte")).alias("code"))


def kmer_histogram(pieces: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, kmer, cnt."""
    if not by and k <= NUMBERS:
        return _counts(pieces, k).groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
    return kmers(pieces, k).groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("cnt"))


def bucket_starts(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, kmer, cnt, start: how many positions have a smaller k-mer. The histogram has a row for each k-mer, not for each
    position: the chunk size bounds it, by the choice of k."""
    before = W.partitionBy(*by).orderBy("kmer").rowsBetween(W.unboundedPreceding, -1)
    return histogram.withColumn("start", F.coalesce(F.sum("cnt").over(before), F.lit(0)))


def initial_ranks(pieces: DataFrame, k: int) -> DataFrame:
    """sid, pos, rank, cnt: how many of its string's suffixes are smaller by their first k symbols, and how many are equal.
    The sentinel's k-mer is empty, so it has rank 0."""
    starts = bucket_starts(kmer_histogram(pieces, k, ("sid",)), ("sid",))
    return kmers(pieces, k).join(starts, ["sid", "kmer"]).select("sid", "pos", F.col("start").alias("rank"), "cnt")

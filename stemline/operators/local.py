"""Suffix arrays of strings that a task holds whole: prefix doubling in numpy, a string at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import verify


def suffix_array(b: bytes) -> np.ndarray:
    """Positions 0..len(b) in the order of their suffixes; the end, the smallest suffix, comes first."""
    n = len(b) + 1
    bits = n.bit_length()
    packed = 3 * bits <= 63  # two ranks and a position are one number: sorting such is several times as fast as argsort
    at = np.arange(n)

    def ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not packed:
            order = np.argsort(key, kind="stable")
            return order, key[order]
        key = np.sort(key << bits | at)
        return key & ((1 << bits) - 1), key >> bits

    code = np.zeros(n, np.int64)
    code[:-1] = np.frombuffer(b, np.uint8).astype(np.int64) + 1
    # ranks by the first symbols at once, base 257: as many as are left room for
    rank, length = np.zeros(n, np.int64), 6 if bits <= 14 or not packed else 5
    for k in range(length):
        rank *= 257
        rank[: max(0, n - k)] += code[k:]
    while True:
        order, key = ordered(rank)
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        if new[order[-1]] == n - 1:
            return order
        rank = new << bits if packed else (new + 1) * (n + 1)
        if length < n:
            rank[: n - length] += new[length:] + 1
        length *= 2


def _rows(sid: int, b: bytes) -> Iterator[pa.RecordBatch]:
    order = suffix_array(b)
    for k in range(0, len(order), 1 << 16):
        part = order[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), sid)), pa.array(np.arange(k, k + len(part))), pa.array(part)], ["sid", "rank", "pos"])


def suffix_arrays(texts: DataFrame) -> DataFrame:
    """sid, rank, pos of each string of texts (sid, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _rows(sid, b.as_py())

    return texts.select("sid", "b").mapInArrow(run, "sid long, rank long, pos long")


def checks(texts: DataFrame) -> DataFrame:
    """sid, n_positions, right: of each string, whether the rows that suffix_arrays makes of it pass all of verify's checks.
    They are checked in the task that makes them, beside the text, so no row of a position is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, right = [], []
            for sid, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = b.as_py()
                rows = pa.Table.from_batches(_rows(sid, text))
                n.append(len(text) + 1)
                right.append(bool((rows["sid"].to_numpy() == sid).all()) and verify.holds(text, rows["rank"].to_numpy(), rows["pos"].to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(right, pa.bool_())], ["sid", "n_positions", "right"])

    return texts.select("sid", "b").mapInArrow(run, "sid long, n_positions long, right boolean")

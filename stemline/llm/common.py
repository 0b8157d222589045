"""What the corpus operators share: text as bytes, shared scratch tables, Arrow row maps."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One Arrow batch holds at most so many rows, and about so many bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Bytes of texts that are read together, as much as a processor's cache holds with what is made of it.
TOGETHER = 1 << 16
#: Bits of the largest bitmap and of one segment of it, as powers of two; bits for each key.
BITMAP, SEGMENT, SPARSE = 27, 20, 32

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z to a-z; every byte that can't stand in a word [0-9a-z\x80-] to a space.
WORD_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _LOWER)


def words(payload: bytes | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text in UTF-8, A-Z lower-cased."""
    return payload.translate(WORD_TABLE).split() if payload else []


_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SPACE_TABLE = _SPACES.astype(np.uint8).tobytes()
_BYTE = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
#: Odd, and 1 less is no multiple of 4, so swapped bytes differ in their sums; and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C17
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PIECE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def word_names(payload: bytes) -> np.ndarray:
    """A 64-bit hash of each word (parted at ASCII white space) of a text, all words at once: differences of sums over its bytes."""
    return names_of([payload])[0]


def names_of(payloads: Sequence[bytes]) -> list[np.ndarray]:
    """word_names of each text. Short texts are read together, as a call on one costs more than its bytes do."""
    out, at, size = [], 0, 0
    for k, p in enumerate(payloads, 1):
        size += len(p)
        if size >= TOGETHER or k == len(payloads):
            starts, names = _names(b" ".join(payloads[at:k]))
            cut = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in payloads[at:k]])).tolist()
            out += [names[x:y] for x, y in zip([0, *cut], cut, strict=False)]
            at, size = k, 0
    return out


def _names(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash."""
    begin, out, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(payload):
        end = at + _PIECE
        while end < len(payload) and not _SPACES[payload[end]]:  # a word is never cut
            end += 1
        piece = payload[at:end]
        data, n = np.frombuffer(piece, np.uint8), len(piece)
        if len(_POWERS[0]) < n + 1:
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                _POWERS[k] = np.cumprod(np.append(np.uint64(1), np.full(2 * n, base, np.uint64)))
        space = np.ones(n + 2, np.uint8)
        space[1:-1] = np.frombuffer(piece.translate(_SPACE_TABLE), np.uint8)
        edge = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE.take(data) * _POWERS[0][:n], out=sums[1:])
        begin.append(starts + at)
        out.append(mixed((sums[ends] - sums[starts]) * _POWERS[1][starts]))
        at = end
    return np.concatenate(begin), np.concatenate(out)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir, or where that is unset and all runs on
    this machine (tests) below a temporary one. It goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="stemline-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/stemline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there, and a
    lost executor costs nothing that is done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of long texts within a worker's memory, and lets workers on this machine import this package
    from where the driver did."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def let_go() -> None:
    """Frees what another operator's tasks have kept in this worker: workers outlive tasks."""
    if tokens := sys.modules.get(f"{__package__}.tokens"):
        tokens.encoder.cache_clear()


def trim() -> None:
    """Gives memory that is free back to the system: Python, Arrow and the C library keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, keeps: bool = False) -> DataFrame:
    """df.mapInArrow(run, schema) in workers that begin without what other operators kept (unless run keeps something
    itself) and give their memory back at the end of a task."""
    small_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            let_go()
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(task, schema)


_broadcasts: list = []


def share(spark: SparkSession, value):
    """value as a broadcast."""
    _broadcasts.append(spark.sparkContext.broadcast(value))
    return _broadcasts[-1]


def rest() -> None:
    """Takes all that share() has broadcast so far off the executors; what is read again is sent again."""
    for b in _broadcasts:
        b.unpersist()
    _broadcasts.clear()


def as_bytes(col: str) -> Column:
    return F.col(col).cast("binary")


def map_texts(
    df: DataFrame,
    text_col: str,
    carry: Sequence[str],
    start: Callable[[], Callable[[list], Sequence]],
    out: Sequence[tuple[str, str, pa.DataType]],
) -> DataFrame:
    """For each row: struct `row` with the columns of carry, untouched (so no name can clash), and
    the columns of out. start() makes a task's function; that takes a batch of texts as bytes
    (None: null) and returns a list for each column of out."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), as_bytes(f"`{text_col}`").alias("payload"))
    schema = T.StructType([rows.schema["row"]])
    for name, ddl, _ in out:
        schema.add(name, T._parse_datatype_string(ddl))
    names, kinds = ["row", *[x[0] for x in out]], [x[2] for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for b in batches:
            if b.num_rows:
                cols = f(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    return map_batches(rows, run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def join_path(folder: str, name: str) -> str:
    return os.path.join(folder, name)


def filesystem(uri: str):
    """The file system of a shared folder and the path in it, from any executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Bitmap(NamedTuple):
    """A set of keys by their last bits: keys of the set are in it, others mostly aren't."""

    bits: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & (8 * len(self.bits) - 1)
        return self.bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1


def bitmap(keys: DataFrame, bits: int | None = None) -> Bitmap:
    """The bitmap of the long column `key`, put together from segments: SPARSE bits or more for each key, of 2 ** BITMAP
    bits at most (beyond that it has more wrong bits, which its readers bear)."""
    if bits is None:
        bits = min(BITMAP, max(16, (SPARSE * keys.count()).bit_length()))
    segment = min(bits, SEGMENT)
    slots = keys.select(F.col("key").bitwiseAND((1 << bits) - 1).alias("slot"))
    slots = slots.withColumn("segment", F.shiftright("slot", segment)).repartition(F.col("segment"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            slot = b.column(0).to_numpy(zero_copy_only=False)
            for s in np.unique(slot >> segment).tolist():
                own = held.setdefault(s, np.zeros(1 << segment, bool))
                own[slot[slot >> segment == s] & ((1 << segment) - 1)] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], ["segment", "bits"])

    out, size = np.zeros((1 << bits) // 8, np.uint8), (1 << segment) // 8
    for s, data in map_batches(slots, run, "segment long, bits binary").collect():
        out[s * size : s * size + size] |= np.frombuffer(bytes(data), np.uint8)
    return Bitmap(out)

"""Hierarchical multi-length packing of token ids.

A document's ids (END appended) are cut into whole windows of the longest tier and a remainder. The
remainder goes to the smallest tier whose window holds it. Tiers are packed from the longest: each
window takes its tier's longest piece, and its gap is filled with the longest pieces of shorter
tiers that fit; if none fits, a longer piece is cut at the gap. So windows are exactly full and
need no padding; what is left when a task ends is cut into powers of two. Finished windows are dealt
to step groups of about STEP_IDS ids: each, longest first, to the group with the fewest ids.

Tasks pack their own rows, so nothing is shuffled. A task's pool holds at most POOL_IDS ids besides
one document. Numbers of sequences and steps carry the task's partition in their high bits.

A null or empty text is END alone. Repeated rows are documents of their own. Columns of the input
travel in a struct, so their names can't clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

END, TIERS, POOL_IDS, STEP_IDS = 0, (1024, 512, 256, 128), 1 << 20, 1 << 16


class Piece(NamedTuple):
    doc: Any
    start: int
    ids: bytes  # four bytes an id
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(self.doc, self.start + n, self.ids[4 * n :], self.doc_tokens)


class Pool:
    """Pieces by length; a bit mask says which lengths there are."""

    def __init__(self, longest: int) -> None:
        self.by_length: list[list[Piece]] = [[] for _ in range(longest + 1)]
        self.mask = self.ids = 0

    def put(self, p: Piece) -> None:
        n = len(p.ids) // 4
        if n:
            self.by_length[n].append(p)
            self.mask |= 1 << n
            self.ids += n

    def _take(self, n: int) -> Piece:
        own = self.by_length[n]
        p = own.pop()
        if not own:
            self.mask ^= 1 << n
        self.ids -= n
        return p

    def longest(self, most: int) -> Piece | None:
        """The longest piece of at most so many ids."""
        n = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        return self._take(n) if n > 0 else None

    def shortest(self, over: int) -> Piece | None:
        """The shortest piece of more ids."""
        rest = self.mask >> (over + 1)
        return self._take((rest & -rest).bit_length() + over) if rest else None


def fill(pool: Pool, tiers: Sequence[int], final: bool) -> Iterator[list[Piece]]:
    """Full windows from a pool. What can't fill a window stays in the pool, or if final comes in windows of powers of two."""
    for size, shorter in zip(tiers, [*tiers[1:], 0], strict=True):
        while pool.mask >> (shorter + 1):  # pieces of this tier: the longer tiers' are used up
            first = pool.longest(size)
            window, gap = [first], size - len(first.ids) // 4
            while gap:
                p = pool.longest(gap)
                if p is None:
                    p = pool.shortest(gap)
                    if p is None:
                        break
                    p, rest = p.cut(gap)
                    pool.put(rest)
                window.append(p)
                gap -= len(p.ids) // 4
            if gap:
                yield from _rest(pool, window, tiers, final)
                return
            yield window


def _rest(pool: Pool, window: list[Piece], tiers: Sequence[int], final: bool) -> Iterator[list[Piece]]:
    """The pool is empty and the window isn't full."""
    if not final:
        for p in window:
            pool.put(p)
        return
    left = sum(len(p.ids) // 4 for p in window)
    while left:
        size, out = 1 << (left.bit_length() - 1), []
        left -= size
        while size:
            p = window.pop(0)
            n = len(p.ids) // 4
            if n > size:
                p, rest = p.cut(size)
                window.insert(0, rest)
                n = size
            out.append(p)
            size -= n
        yield out


def steps(windows: list[list[Piece]], step_ids: int) -> list[int]:
    """The step group of each window: groups as even in ids as dealing the longest first makes them."""
    sizes = [sum(len(p.ids) // 4 for p in w) for w in windows]
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_ids)))]
    out = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: (-sizes[k], k)):
        held, g = groups[0]
        out[k] = g
        heapq.heapreplace(groups, (held + sizes[k], g))
    return out


def pack(df: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None, end: int = END, tiers: Sequence[int] = TIERS, pool_ids: int = POOL_IDS, step_ids: int = STEP_IDS, parts: int | None = None, segments: int | None = None) -> DataFrame:
    """A row for each piece: `row` with its document's columns of carry (None: all), start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_length, step_id. path: the tokenizer's file, which all
    executors have. tiers: window lengths, powers of two, the longest first. parts, segments: sizes of
    a worker's dictionaries of ids."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers must be powers of two, the longest first")
    carry = df.columns if carry is None else carry
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), common.as_bytes(f"`{text_col}`").alias("payload"))
    names = ["row", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_id"]
    schema = T.StructType([rows.schema["row"]])
    for n in names[1:]:
        schema.add(n, T.BinaryType() if n == "ids" else T.LongType())
    end_bytes = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, longest = Pool(tiers[0]), tiers[0]
        base, n_sequences, n_steps, row_type = TaskContext.get().partitionId() << 40, 0, 0, None
        done: list[list[Piece]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_sequences, n_steps, done, size
            groups, out = steps(done, step_ids), {n: [] for n in names}
            for w, g in zip(done, groups, strict=True):
                offset, total = 0, sum(len(p.ids) // 4 for p in w)
                for p in w:
                    n = len(p.ids) // 4
                    for name, value in zip(names, (p.doc, p.start, n, p.ids, p.doc_tokens, base + n_sequences, offset, total, base + n_steps + g), strict=True):
                        out[name].append(value)
                    offset += n
                n_sequences += 1
            n_steps += max(groups, default=-1) + 1
            done, size = [], 0
            if out["start"]:
                yield pa.RecordBatch.from_arrays([pa.array(out[n], row_type if n == "row" else pa.binary() if n == "ids" else pa.int64()) for n in names], names)

        for b in batches:
            encoder, row_type = tokens.encoder(path, parts, segments), b.column(0).type
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                ids += end_bytes
                n, at = len(ids) // 4, 0
                for at in range(0, n - n % longest, longest):
                    done.append([Piece(doc, at, ids[4 * at : 4 * (at + longest)], n)])
                at = n - n % longest
                pool.put(Piece(doc, at, ids[4 * at :], n))
                size += n
                if size >= pool_ids:
                    done += fill(pool, tiers, False)
                    yield from flush()
        done += fill(pool, tiers, True)
        yield from flush()

    return common.map_batches(rows, run, schema, keeps=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(common.documents(spark, sf_dir), tokens.vocabulary("byte_bpe_50k.json"), carry=["doc_id"])
    return pieces.select("row.doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_id")

"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts anywhere else.

Sampling. Of the GRAM-byte strings that begin in a window of LENGTH bytes the one with the least
hash, the leftmost of equals, is the window's anchor. It depends on the window's bytes alone, so
equal windows have equal anchors at equal distances, and only windows whose anchors hash alike can
be equal. Anchors stand for runs of neighbouring windows, about one for each (LENGTH - GRAM) / 2
bytes. Texts are scanned once for the hashes of their anchors, and those that come twice go into a
bitmap of fixed size that is broadcast; in a second scan anchors whose bit is set yield a context,
the bytes of their windows. Wrong bits cost contexts, never results.

Sorting. Contexts are dealt by their anchor's hash. In each group the strings right of the anchors,
and those left of them read backwards, are sorted deep-shallow: multikey quicksort by characters of
eight bytes, all segments at a time, to SHALLOW bytes, and blind tries for the groups that agree that far.
Common prefixes of neighbours in these two sorted arrays say which contexts agree in d bytes to the left and
LENGTH - d to the right of the anchor, that is, in the window d bytes before it. Equal contexts of a
task travel once. Groups of over HOT anchors are counted window by window, by 128-bit hashes,
instead, in a plain aggregation that no key can make too large for a task.

Copies. Equal texts are known by digest; the scans for contexts take one of them, and all bytes of a copy of LENGTH bytes or more
are repeats. A run of windows that equals the windows a period before it, as in a text that
repeats itself, is settled at once where it stands.

Words. A text may also be read as the names of its words, eight bytes each: then strings of LENGTH
bytes are passages of 50 words, however they are spaced and however many bytes they have.

Texts that no repeat touches never leave their task; the others are joined with their spans.

A null text is empty. Texts under LENGTH bytes have no repeats. Ids aren't used: rows count by their
text, so repeated rows are copies. Columns of the input travel in a struct, so their names can't
clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH, GRAM, SHALLOW = 400, 32, 32
REACH = LENGTH - GRAM  # the farthest an anchor lies from its window's start
#: Windows scanned at once; contexts sorted at once (more if a group has more); anchors of a hot group.
PIECE, CHUNK, HOT = 1 << 19, 20_000, 100_000
#: Bytes of a word's name where texts are taken as words.
NAME = 8
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


# -- units -----------------------------------------------------------------------------------------


def reader(words: bool) -> Callable[[list[bytes]], list[bytes]]:
    """What is searched of texts: their bytes, or the names of their words (parted at ASCII white space), so that LENGTH bytes
    are LENGTH // NAME words whatever parts them."""
    if not words:
        return lambda payloads: payloads
    return lambda payloads: [x.astype("<u8", copy=False).tobytes() for x in common.names_of(payloads)]


def byte_spans(payload: bytes, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the names of a text's words as spans of its bytes, from a first word to a last one."""
    whole = [(-(-a // NAME), b // NAME) for a, b in found]
    whole = [(a, b) for a, b in whole if b - a >= LENGTH // NAME]
    if not whole:
        return []
    ends = [m.span() for m in _WORD.finditer(payload)]
    return [(ends[a][0], ends[b - 1][1]) for a, b in whole]


# -- anchors ---------------------------------------------------------------------------------------


class Anchors(NamedTuple):
    """Runs of windows low..high, with their anchor's place and hash."""

    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    hash: np.ndarray


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place."""
    x = data.astype(np.uint64)
    for n in (1, 2, 4):
        x = x[:-n] << np.uint64(8 * n) | x[n:]
    x = x[:-8] * _K[0] + x[8:]
    x ^= x >> np.uint64(32)
    x *= _K[1]
    x = x[:-16] * _K[2] + x[16:]
    x ^= x >> np.uint64(29)
    x *= _K[3]
    return x ^ x >> np.uint64(32)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from the least of 2, 4, 8 and so on."""
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def anchors(payload: bytes) -> Anchors:
    """The anchors of a text's windows."""
    return anchors_of([payload])[0]


def anchors_of(payloads: list[bytes]) -> list[Anchors]:
    """The anchors of each text's windows. Short texts are read together, as a call on one costs more than its bytes do."""
    out, at, size = [], 0, 0
    for k, p in enumerate(payloads, 1):
        size += len(p)
        if size >= common.TOGETHER or k == len(payloads):
            small = [x if len(x) < PIECE else b"" for x in payloads[at:k]]
            found = _together(small)
            out += [_alone(x) if len(x) >= PIECE else own for x, own in zip(payloads[at:k], found, strict=True)]
            at, size = k, 0
    return out


def _places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, and the place of the anchor of each window."""
    h = _gram_hashes(data)
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    return h, (_least(key, REACH + 1) & np.uint64(0xFFFFFF)).astype(np.int64)


def _together(payloads: list[bytes]) -> list[Anchors]:
    """As anchors_of, for few bytes: windows that reach over a text's end are left out."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    if len(data) < LENGTH:
        return [_NONE] * len(payloads)
    h, place = _places(data)
    sizes = np.array([len(p) for p in payloads])
    ends = np.cumsum(sizes)
    window = np.flatnonzero(np.arange(len(place)) <= np.repeat(ends - LENGTH, sizes)[: len(place)])
    place = place[window]
    first = np.flatnonzero(np.append(len(place) > 0, place[1:] != place[:-1]))  # another text, another place
    low, high, place = window[first], window[np.append(first[1:], len(place)) - 1] if len(first) else window[:0], place[first]
    of = np.searchsorted(ends, low, "right")
    base = (ends - sizes)[of]
    cut = np.searchsorted(of, np.arange(len(payloads) + 1)).tolist()
    parts = (place - base, low - base, high - base, h[place])
    return [Anchors(*(x[a:b] for x in parts)) for a, b in zip(cut, cut[1:], strict=False)]


def _alone(payload: bytes) -> Anchors:
    data, parts = np.frombuffer(payload, np.uint8), []
    for at in range(0, len(data) - LENGTH + 1, PIECE):
        h, place = _places(data[at : at + PIECE + LENGTH - 1])
        low = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        high = np.append(low[1:], len(place)) - 1
        place = place[low]
        parts.append((place + at, low + at, high + at, h[place]))
    return Anchors(*(np.concatenate(x) for x in zip(*parts, strict=True)))


_NONE = Anchors(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))


def settle(payload: bytes, found: Anchors) -> tuple[Anchors, list[tuple[int, int]]]:
    """Without the runs of windows that equal those one period before them, and the spans that these cover."""
    drop, spans = np.zeros(len(found.place), bool), []
    for k in (np.flatnonzero(found.hash[1:] == found.hash[:-1]) + 1).tolist():
        period = int(found.place[k] - found.place[k - 1])
        low, end = int(found.low[k]), int(found.high[k]) + LENGTH
        if 0 < period <= low and payload[low:end] == payload[low - period : end - period]:
            drop[k] = True
            spans.append((low - period, end))
    return Anchors(*(x[~drop] for x in found)), union(spans)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# -- deep-shallow sorting --------------------------------------------------------------------------


def blind_trie(strings: list[bytes]) -> list[int]:
    """The places of strings, all of one length, in sorted order. Inner nodes hold only the bit at which strings
    part; a string goes down unseen to some leaf, is compared there once, and enters where it differs."""
    leaves = [[0]]  # places of equal strings
    nodes: list[list] = []  # bit, children: a node's number, or ~ a leaf's
    root = ~0
    for k in range(1, len(strings)):
        s, at = strings[k], root
        while at >= 0:
            bit, zero, one = nodes[at]
            at = one if s[bit >> 3] >> (7 - (bit & 7)) & 1 else zero
        other = strings[leaves[~at][0]]
        if s == other:
            leaves[~at].append(k)
            continue
        diff = int.from_bytes(s) ^ int.from_bytes(other)
        bit = 8 * len(s) - diff.bit_length()
        side = s[bit >> 3] >> (7 - (bit & 7)) & 1
        parent, at = None, root
        while at >= 0 and nodes[at][0] < bit:
            node = nodes[at]
            parent, turn = at, 2 if s[node[0] >> 3] >> (7 - (node[0] & 7)) & 1 else 1
            at = node[turn]
        leaves.append([k])
        leaf = ~(len(leaves) - 1)
        nodes.append([bit, at, leaf] if side else [bit, leaf, at])
        if parent is None:
            root = len(nodes) - 1
        else:
            nodes[parent][turn] = len(nodes) - 1
    out, stack = [], [root]
    while stack:
        at = stack.pop()
        if at < 0:
            out += leaves[~at]
        else:
            stack += [nodes[at][2], nodes[at][1]]
    return out


def deep_shallow(groups: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows (bytes, all of one width) by group and bytes, and for each place in it the length of the prefix
    shared with the row before (-1 at a group's first)."""
    n, width = rows.shape
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -width % 8)))).view(">u8").astype(np.uint64)
    order, segment = np.argsort(groups, kind="stable"), None
    segment = np.cumsum(np.concatenate([[0], np.diff(groups[order]) != 0])) if n else np.zeros(0, int)
    for k in range(min(SHALLOW // 8, words.shape[1])):
        open_ = np.flatnonzero(np.bincount(segment, minlength=n)[segment] > 1)
        if not len(open_):
            break
        key = words[order[open_], k]
        inner = np.lexsort((key, segment[open_]))
        order[open_], key = order[open_][inner], key[inner]
        new = np.ones(n, bool)  # a segment begins
        new[1:] = segment[1:] != segment[:-1]
        at = open_[1:]
        new[at] |= (key[1:] != key[:-1]) | (np.diff(open_) != 1)
        segment = np.cumsum(new) - 1
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if n else np.zeros(0, int)
    ends = np.append(starts[1:], n)
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        own = order[a:b]
        order[a:b] = own[blind_trie([r.tobytes() for r in rows[own, SHALLOW:]])]
    lcp = np.full(n, -1, np.int64)
    for a in range(1, n, 50_000):
        b = min(n, a + 50_000)
        now, before = order[a:b], order[a - 1 : b - 1]
        differ = rows[now] != rows[before]
        common_ = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[a:b] = np.where(groups[now] == groups[before], common_, -1)
    return order, lcp


def repeated(groups: np.ndarray, contexts: list[bytes], left: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each context (bytes of its windows; `left` of them before the anchor; windows begin `least` to `left` bytes
    before the anchor) and each d: whether its window d bytes before the anchor comes again in the group. low and high
    are the least and the greatest number of the places a context stands for; equal numbers don't count as again."""
    n = len(contexts)
    right, before = np.zeros((n, LENGTH), np.uint8), np.zeros((n, REACH), np.uint8)
    for k, c in enumerate(contexts):
        data, a = np.frombuffer(c, np.uint8), int(left[k])
        after = data[a : a + LENGTH]
        right[k, : len(after)] = after
        before[k, :a] = data[:a][::-1]
    order_r, lcp_r = deep_shallow(groups, right)
    order_l, lcp_l = deep_shallow(groups, before)
    del right, before
    place_r, place_l = np.empty(n, int), np.empty(n, int)
    place_r[order_r], place_l[order_l] = np.arange(n), np.arange(n)
    out = np.zeros((n, REACH + 1), bool)
    for d in range(REACH + 1):
        own = np.flatnonzero((least <= d) & (d <= left))
        if not len(own):
            continue
        class_r, class_l = np.cumsum(lcp_r < LENGTH - d)[place_r[own]], np.cumsum(lcp_l < d)[place_l[own]]
        key = class_r * (n + 1) + class_l
        turn = np.argsort(key)
        key = key[turn]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.minimum.reduceat(low[own[turn]], starts) != np.maximum.reduceat(high[own[turn]], starts)
        out[own[turn], d] = np.repeat(many, np.diff(np.append(starts, len(key))))
    return out


def runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true values in a row."""
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


# -- DataFrames ------------------------------------------------------------------------------------


def _digest(payload: bytes) -> bytes:
    return hashlib.sha256(payload).digest()[:16]


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:7])


def _scan(texts: DataFrame, schema: str, start: Callable[[], Callable[[list], list[tuple]]]) -> DataFrame:
    """A map over batches of payloads, the only column of texts, to any rows."""
    kind = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        f, arrow = start(), to_arrow_schema(kind)
        for b in batches:
            rows = f(b.column(0).to_pylist())
            for k in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 20_000], strict=True), arrow.types, strict=True)], schema=arrow)

    return common.map_batches(texts, run, kind)


class Context(NamedTuple):
    hash: int
    digest: bytes
    place: int
    left: int  # bytes of windows before the anchor
    least: int  # the last window begins so many bytes before the anchor
    id: bytes
    bytes: bytes | None


_CONTEXT = "hash long, digest binary, place long, left long, least long, id binary, bytes binary"


def _contexts(shared, seen: set, payload: bytes, found: Anchors, digest: bytes, across: bool) -> Iterator[Context]:
    """The contexts of anchors whose bit is set; also, with left -1, spans settled on the spot (place to least)."""
    found, spans = (found, []) if across else settle(payload, found)
    key = _key(digest)
    for a, b in spans:
        yield Context(key, digest, a, -1, b, b"", None)
    keep = shared.value.has(found.hash.view(np.int64))
    for place, low, high, h in zip(*(x[keep].tolist() for x in (found.place, found.low, found.high, found.hash.view(np.int64))), strict=True):
        data = payload[low : high + LENGTH]
        name = xxhash.xxh3_128_digest(data + (place - low).to_bytes(4))
        known = name in seen
        if not known and len(seen) < 200_000:
            seen.add(name)
        yield Context(h, digest, place, place - low, place - high, name, None if known else data)


def _settle_groups(rows: list[Context], across: bool) -> Iterator[tuple[bytes, int, int]]:
    """digest, start, end of the repeats of whole groups."""
    groups: dict[int, dict[bytes, list[Context]]] = {}
    for r in rows:
        if r.left < 0:
            yield r.digest, r.place, r.least
        else:
            groups.setdefault(r.hash, {}).setdefault(r.id, []).append(r)
    chunk: list[tuple[int, list[Context]]] = []
    for g, own in enumerate(groups.values()):
        if sum(map(len, own.values())) > 1:
            chunk += [(g, members) for members in own.values()]
        if len(chunk) >= CHUNK:
            yield from _settle_chunk(chunk, across)
            chunk = []
    if chunk:
        yield from _settle_chunk(chunk, across)


def _settle_chunk(chunk: list[tuple[int, list[Context]]], across: bool) -> Iterator[tuple[bytes, int, int]]:
    firsts = [members[0] for _, members in chunk]
    number: dict[bytes, int] = {}
    own = [[number.setdefault(r.digest, len(number)) for r in members] if across else [k, k + (len(members) > 1)] for k, (_, members) in enumerate(chunk)]
    if not across:  # a number for each context, none of another; two if it stands for several places
        own = [[2 * a, 2 * a + b - a] for a, b in own]
    found = repeated(
        np.array([g for g, _ in chunk]), [next(r.bytes for r in members if r.bytes is not None) for _, members in chunk],
        np.array([r.left for r in firsts]), np.array([r.least for r in firsts]), np.array([min(x) for x in own]), np.array([max(x) for x in own]),
    )
    for k, first, last in zip(*(x.tolist() for x in runs(found)), strict=True):
        for r in chunk[k][1]:
            yield r.digest, r.place - last, r.place - first + LENGTH


def _hot_spans(contexts: DataFrame, across: bool) -> DataFrame:
    """Spans of groups too large for a task: windows are counted by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                starts = list(range(r["left"] - r["least"] + 1))
                names = [xxhash.xxh3_128_digest(r["bytes"][s : s + LENGTH]) for s in starts]
                n = len(starts)
                low = r["place"] - r["left"]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([r["digest"]] * n, pa.binary()), pa.array([low + s for s in starts], pa.int64())], ["window", "digest", "start"])

    windows = common.map_batches(contexts, run, "window binary, digest binary, start long")
    again = F.min("digest") != F.max("digest") if across else F.count(F.lit(1)) > 1
    twice = windows.groupBy("window").agg(again.alias("again")).where("again").select("window")
    return windows.join(twice, "window").select("digest", "start", (F.col("start") + LENGTH).alias("end"))


def spans(texts: DataFrame, bits: int | None = None, hot: int = HOT, words: bool = False, across: bool = False) -> DataFrame:
    """digest, key, spans (array of struct start, end) for each text that has repeats. texts: one column, the payloads.
    words: of names of words (see reader). across: only what comes again in another text, or in a copy."""
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def long(read: Callable, payloads: list) -> list[bytes]:
        return [p for p in read([p for p in payloads if p is not None]) if len(p) >= LENGTH]

    def outline() -> Callable:
        read = reader(words)

        def rows(payloads: list) -> list[tuple]:
            out, texts = [], long(read, payloads)
            for p, found in zip(texts, anchors_of(texts), strict=True):
                digest = _digest(p)
                hashes = np.unique(found.hash) if across else settle(p, found)[0].hash
                out.append((digest, _key(digest), len(p), hashes.view(np.int64).tolist()))
            return out

        return rows

    outlines = _scan(texts, "digest binary, key long, n long, hashes array<long>", outline)
    outlines = common.table(outlines.groupBy("digest", "key", "n").agg(F.count(F.lit(1)).alias("copies"), F.first("hashes").alias("hashes")), "outlines")
    counts = outlines.select(F.explode("hashes").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = common.table(counts, "twice")
    copied = outlines.where("copies > 1")
    shared, several = (common.share(spark, common.bitmap(x, bits)) for x in (counts, copied.select("key")))
    n_contexts, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()

    def digested(payloads: list[bytes]) -> Iterator[tuple[bytes, bytes, bool]]:
        """Texts with their digests, and whether there may be copies of them."""
        digests = [_digest(p) for p in payloads]
        return zip(payloads, digests, several.value.has(np.array([_key(d) for d in digests], np.int64)).tolist(), strict=True)

    def single() -> Callable:
        seen, read = set(), reader(words)

        def rows(payloads: list) -> list[tuple]:
            out, texts = [], long(read, payloads)
            own = [(p, d) for p, d, copied in digested(texts) if not copied]
            for (p, d), found in zip(own, anchors_of([p for p, _ in own]), strict=True):
                out += _contexts(shared, seen, p, found, d, across)
            return out

        return rows

    def one_of() -> Callable:
        read = reader(words)

        def rows(payloads: list) -> list[tuple]:
            return [(d, p) for p, d, copied in digested(long(read, payloads)) if copied]

        return rows

    def of_copies() -> Callable:
        seen: set = set()
        return lambda payloads: [c for p, found in zip(payloads, anchors_of(payloads), strict=True) for c in _contexts(shared, seen, p, found, _digest(p), across)]

    one = _scan(texts, "digest binary, payload binary", one_of).groupBy("digest").agg(F.first("payload").alias("payload"))
    contexts = _scan(texts, _CONTEXT, single).unionByName(_scan(one.select("payload"), _CONTEXT, of_copies))
    large = counts.where(F.col("n") > hot).select(F.col("key").alias("hash")) if most > hot else None
    tasks = max(partitions, n_contexts * (2 * LENGTH) // (48 << 20) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [Context(*x) for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        out: list[tuple] = []
        for r in _settle_groups(rows, across):
            out.append(r)
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["digest", "start", "end"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["digest", "start", "end"])

    usual = contexts if large is None else contexts.join(large, "hash", "left_anti")
    found = common.map_batches(usual.repartition(tasks, "hash"), run, "digest binary, start long, end long")
    if large is not None:
        # every context is needed whole here: a task's repeats of it are filled in from the one that has the bytes
        held = common.table(contexts.join(large, "hash", "left_semi"), "hot")
        whole = held.where("bytes is not null").groupBy("id").agg(F.first("bytes").alias("whole"))
        found = found.unionByName(_hot_spans(held.join(whole, "id").withColumn("bytes", F.col("whole")).drop("whole"), across))
    found = found.unionByName(copied.select("digest", F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    lists = found.groupBy("digest").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    key = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long").alias("key")
    return common.table(lists.select("digest", key, "spans"), "spans")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_DDL = "array<struct<start:long,end:long>>"
_OUT = [("n_bytes", "long", pa.int64()), ("spans", _DDL, _SPANS), ("passages", _DDL, _SPANS), ("kept", "binary", pa.binary())]


def remove(df: DataFrame, text_col: str = "text", carry: list[str] | None = None, bits: int | None = None, words: bool = False, passages: bool = False) -> DataFrame:
    """`row` with the columns of carry (None: all but the text), n_bytes, `spans` (maximal runs of removed bytes, in order),
    `passages` (of bytes, in order; empty unless asked for) and `kept`, the bytes without spans. words: strings are of LENGTH //
    NAME words, whatever parts these, and spans go from a first word to a last one. passages: also tells what strings of so
    many words come again in another text or copy, and leaves them. df is read four times, for passages three times more."""
    spark = df.sparkSession
    carry = [c for c in df.columns if c != text_col] if carry is None else carry
    payload = F.coalesce(common.as_bytes(f"`{text_col}`"), F.lit(b""))
    texts = df.select(payload.alias("payload"))
    kinds = [words, True] if passages else [words]  # whether names of words are searched
    found = [spans(texts, bits, words=w, across=k == 1) for k, w in enumerate(kinds)]
    touched = [common.share(spark, common.bitmap(x, bits)) for x in found]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), payload.alias("payload"))
    row = rows.schema["row"]

    def split(whole: bool) -> Callable:
        """Rows that no span touches, finished; or the others, with their digests."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = [reader(w) for w in kinds]
            for b in batches:
                payloads = b.column(1).to_pylist()
                digests = [[_digest(p) for p in f(payloads)] for f in read]
                hit = np.zeros(len(payloads), bool)
                for t, own in zip(touched, digests, strict=True):
                    hit |= t.value.has(np.array([_key(d) for d in own], np.int64))
                at = np.flatnonzero(~hit if whole else hit)
                if len(at):
                    part = b.take(pa.array(at))
                    if whole:
                        none = pa.array([[]] * len(at), _SPANS)
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(payloads[k]) for k in at], pa.int64()), none, none, part.column(1)], ["row", *[x[0] for x in _OUT]])
                    else:
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array([own[k] for k in at], pa.binary()) for own in digests]], names)

        return run

    names = ["row", "payload", *[f"d{k}" for k in range(len(kinds))]]
    done, marked = T.StructType([row]), T.StructType([row])
    for name, ddl, _ in _OUT:
        done.add(name, T._parse_datatype_string(ddl))
    for name in names[1:]:
        marked.add(name, T.BinaryType())
    clean = common.map_batches(rows, split(True), done)
    rest = common.map_batches(rows, split(False), marked)
    for k, x in enumerate(found):
        rest = rest.join(x.select(F.col("digest").alias(f"d{k}"), F.col("spans").alias(f"s{k}")), f"d{k}", "left")
    rest = rest.select("row", "payload", *[f"s{k}" for k in range(len(kinds))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, told, kept = [], [[], []], []
            payloads = b.column(1).to_pylist()
            for p, *had in zip(payloads, *[b.column(2 + k).to_pylist() for k in range(len(kinds))], strict=True):
                own = [union([(s["start"], s["end"]) for s in h or ()]) for h in had]
                own = [union(byte_spans(p, x)) if w else x for w, x in zip(kinds, own, strict=True)]
                edges = [0, *[x for s in own[0] for x in s], len(p)]
                sizes.append(len(p))
                for out, x in zip(told, [*own, []], strict=False):
                    out.append([{"start": a, "end": e} for a, e in x])
                kept.append(b"".join([p[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *[pa.array(x, _SPANS) for x in told], pa.array(kept, pa.binary())], ["row", *[x[0] for x in _OUT]])

    return clean.unionByName(common.map_batches(rest, cut, done))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest by strings of LENGTH bytes, and beside it n_passages and n_passage_bytes: of passages of 50 words or more
    that come again in another document, be they of LENGTH bytes or not."""
    out = remove(common.documents(spark, sf_dir), carry=["doc_id"], passages=True)

    def total(spans: str):
        return F.expr(f"aggregate({spans}, 0L, (x, s) -> x + s.end - s.start)")

    return out.select(
        "row.doc_id", "n_bytes", total("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"), total("passages").alias("n_passage_bytes"),
    )

"""Token ids in binary shards, compressed by a Re-Pair grammar.

Documents are encoded in ascending order of their id (range partitions, sorted; nulls first, equal
ids by text), END is appended to each, and tasks write files of shards. In a shard, frequent pairs
of neighbouring symbols become nonterminals, PAIRS a round and the most frequent first, until none
comes LEAST times or symbols run out; no pair reaches over a document's end, so documents are decoded alone. A shard holds its rules, the length of each
rule's expansion, the symbols, and a directory of documents (first symbol, first id), all as
little-endian arrays under a header; a document, or any run of its ids, is decoded from the
directory and the expansion lengths.

The manifest is a table with a row for each shard of the attempts that counted. A shard's first id
is a running sum over it.

A null text is empty: END alone. Repeated rows are documents of their own. Columns besides id and
text are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, tokens

END, SHARD_IDS, PAIRS, LEAST = 1, 1 << 20, 5400, 6
MAGIC = b"RPS1"
_HEAD = struct.Struct("<4sIIIQQQ")  # magic, bytes a symbol, first nonterminal, rules, symbols, documents, ids


def rounds_of(first: int, rules: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks [start, end) of rules whose parts all come before the block."""
    most, start = rules.max(axis=1) - first if len(rules) else np.zeros(0, int), 0
    while start < len(rules):
        late = np.flatnonzero(most[start:] >= start)
        end = start + int(late[0]) if len(late) else len(rules)
        yield start, end
        start = end


def expansion_lengths(first: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each symbol stands for. A rule's parts come before it."""
    out, rules = np.ones(first + len(rules), np.int64), rules.astype(np.int64)
    for start, end in rounds_of(first, rules):
        out[first + start : first + end] = out[rules[start:end]].sum(axis=1)
    return out


class Grammar:
    """Rules: nonterminal first + k stands for the pair rules[k]; flat and offset hold the ids each symbol stands for."""

    def __init__(self, first: int, rules: np.ndarray) -> None:
        rules = rules.astype(np.int64)
        self.first, self.rules, self.lengths = first, rules, expansion_lengths(first, rules)
        ends = np.cumsum(self.lengths)  # of ids, each by itself, then of rules in order
        self.offsets = ends - self.lengths
        self.flat = np.empty(ends[-1], np.uint32)
        self.flat[:first] = np.arange(first)
        for start, end in rounds_of(first, rules):
            self.flat[self.offsets[first + start] : ends[first + end - 1]] = self.expand(rules[start:end].ravel())

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.offsets[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def compress(ids: np.ndarray, starts: np.ndarray, first: int, pairs: int = PAIRS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, starts of documents among them, and rules (rows of two symbols) for the ids of documents that begin at
    starts. Symbols below first are ids. Each round replaces the most frequent pairs, left to right, until no pair comes
    `least` times; symbols keep to 2 bytes where ids do, unless more rules make up for wider ones."""
    is_first = np.zeros(len(ids) + 1, bool)
    is_first[starts] = True
    is_first[-1] = True
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint32)
    if first < 1 << 16:
        seq, is_first, rules, mergeable = _rounds(seq, is_first, rules, first, (1 << 16) - first, pairs, least)
        size = 2 * len(seq) + 8 * len(rules)
        # no rule reaches over a pair that is rare now, so at most the other pairs go
        if 4 * (len(seq) - mergeable) + 12 * len(rules) < size:
            more = _rounds(seq.copy(), is_first, rules, first, (1 << 31) - first, pairs, least)
            if 4 * len(more[0]) + 12 * len(more[2]) < size:
                seq, is_first, rules, _ = more
    else:
        seq, is_first, rules, _ = _rounds(seq, is_first, rules, first, (1 << 31) - first, pairs, least)
    return seq, np.flatnonzero(is_first[:-1]), rules


def _rounds(seq: np.ndarray, is_first: np.ndarray, rules: np.ndarray, first: int, room: int, pairs: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rounds until no pair comes least times or there are room rules; and the places of pairs that still come so often.
    Replacing makes pairs of older symbols rarer only, so after the first round just pairs with a symbol of the last
    round are counted, and those that were frequent and are left over. What a round removes stays in place, passed over by
    after and before, until it is an eighth of all: rounds that replace little cost little."""
    all_rules, used, most, places = [rules], len(rules), pairs, np.arange(len(seq) - 1)
    after, before, live, dead = np.arange(1, len(seq) + 2), np.arange(-1, len(seq)), np.ones(len(seq), bool), 0
    near, missing = np.zeros(len(seq) + 1, bool), 0
    while len(places):
        right = after[places]
        inside = ~is_first[right]
        places, right = places[inside], right[inside]
        bits = np.uint64((first + used).bit_length())
        keys = seq[places].astype(np.uint64) << bits | seq[right]
        alone = np.ones(len(places), bool)  # of a symbol's run, every other pair: the rest overlaps
        same = np.flatnonzero(seq[places] == seq[right])
        alone[same[_odd(places[same], right[same], keys[same])]] = False
        order, edge, counts = _groups(keys, 2 * int(bits), alone)
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        size = np.diff(np.append(edge, len(keys)))
        if used >= room:
            missing = int(size[often].sum())
            break
        taken = np.sort(often[np.argsort(-counts[often], kind="stable")[: min(most, room - used)]])
        chosen = keys[order[edge[taken]]]
        # of each place, the number of its pair among the chosen; -1: frequent, but not chosen; -2: rare
        group = np.full(len(edge), -2, np.int32)
        group[often] = -1
        group[taken] = np.arange(len(taken))
        number = np.empty(len(keys), np.int32)
        number[order] = np.repeat(group, size)
        hit = np.flatnonzero(number >= 0)
        # of overlapping places, every other from the left of each run of neighbours
        hit = hit[~_odd(places[hit], right[hit])]
        at, rank = places[hit], number[hit]
        # pairs whose places went to others wait for another round; the most frequent alone keeps all of its own
        enough = np.bincount(rank, minlength=len(chosen)) >= least
        if not enough.any():
            most = max(1, len(chosen) // 4)
            continue
        most = pairs
        own = enough[rank]
        at, rank = at[own], (np.cumsum(enough) - 1)[rank[own]]
        gone, ahead = after[at], before[at]
        # frequent pairs that no replaced one touches are left over
        near[at] = near[gone] = near[ahead] = True  # -1, before the first, is the place past the last
        left = places[(number > -2) & ~near[places]]
        near[at] = near[gone] = near[ahead] = False
        seq[at] = (first + used + rank).astype(np.uint32)
        after[at] = after[gone]
        before[after[gone]] = at
        live[gone] = False
        dead += len(at)
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        if 16 * len(places) > len(seq):
            near[at] = near[ahead] = near[left] = True
            places = np.flatnonzero(near)
            near[places] = False
        else:
            places = np.sort(np.concatenate([at, ahead, left]))
            places = places[np.append(True, places[1:] != places[:-1])]
        all_rules.append(np.stack([chosen >> bits, chosen & ((np.uint64(1) << bits) - np.uint64(1))], axis=1).astype(np.uint32)[enough])
        used += int(enough.sum())
        if 8 * dead > len(seq):
            places = (np.cumsum(live) - 1)[places]
            seq, is_first = seq[live], np.append(is_first[:-1][live], True)
            after, before, live, dead = np.arange(1, len(seq) + 2), np.arange(-1, len(seq)), np.ones(len(seq), bool), 0
            near = np.zeros(len(seq) + 1, bool)
    return seq[live], np.append(is_first[:-1][live], True), np.concatenate(all_rules), missing


def _groups(keys: np.ndarray, bits: int, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys of so many bits, where in it each group of equal ones begins, and how many of a group are alone."""
    low = len(keys).bit_length()
    if bits + low <= 64:  # a plain sort of key and place is several times as fast as argsort
        both = np.sort(keys << np.uint64(low) | np.arange(len(keys), dtype=np.uint64))
        order, ordered = (both & np.uint64((1 << low) - 1)).view(np.int64), both >> np.uint64(low)
    else:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, int)
    counts = np.diff(np.append(edge, len(keys)))
    if not alone.all():
        counts -= np.bincount(np.searchsorted(edge, np.flatnonzero(~alone[order]), "right") - 1, minlength=len(edge))
    return order, edge, counts


def _odd(at: np.ndarray, after: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """Whether each of the sorted places, which have the places after as neighbours, has an odd number in its run of
    neighbours (of one key)."""
    new = at[1:] != after[:-1]
    if keys is not None:
        new |= keys[1:] != keys[:-1]
    run = np.flatnonzero(np.concatenate([[True], new])) if len(at) else np.zeros(0, int)
    return ((np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) & 1).astype(bool)


def pack(ids: np.ndarray, starts: np.ndarray, first: int) -> bytes:
    """A shard's bytes."""
    seq, at, rules = compress(ids, starts, first)
    wide = 2 if first + len(rules) <= 1 << 16 else 4
    kind = f"<u{wide}"
    lengths = expansion_lengths(first, rules)[first:]
    head = _HEAD.pack(MAGIC, wide, first, len(rules), len(seq), len(starts), len(ids))
    return head + rules.astype(kind).tobytes() + lengths.astype("<u4").tobytes() + at.astype("<u8").tobytes() + starts.astype("<u8").tobytes() + seq.astype(kind).tobytes()


class Shard:
    """A shard's documents, decoded alone or together."""

    def __init__(self, data: bytes) -> None:
        magic, wide, first, n_rules, n_symbols, self.n_docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        kind, at = f"<u{wide}", _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        rules = take(kind, 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        self.first_symbol = np.append(take("<u8", self.n_docs), n_symbols).astype(np.int64)
        self.first_id = np.append(take("<u8", self.n_docs), self.n_ids).astype(np.int64)
        self.symbols = take(kind, n_symbols)
        self.grammar = Grammar(first, rules.astype(np.int64))

    def document(self, k: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids [start, end) of document k, from the symbols that hold them."""
        symbols = self.symbols[self.first_symbol[k] : self.first_symbol[k + 1]]
        ends = np.cumsum(self.grammar.lengths[symbols])
        end = int(ends[-1]) if end is None else end
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, end, "left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self.grammar.expand(symbols[a:b])[start - before : end - before]

    def documents(self, piece: int = 1 << 16) -> Iterator[bytes]:
        """The ids of each document in order, as bytes; documents are expanded together, about `piece` symbols at a time."""
        k = 0
        while k < self.n_docs:
            to = max(k + 1, int(np.searchsorted(self.first_symbol, self.first_symbol[k] + piece, "right")) - 1)
            ids, base = self.grammar.expand(self.symbols[self.first_symbol[k] : self.first_symbol[to]]).astype("<u4").tobytes(), self.first_id[k]
            for d in range(k, to):
                yield ids[4 * (self.first_id[d] - base) : 4 * (self.first_id[d + 1] - base)]
            k = to


def write(df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the ids of df's texts below folder, a shared one, by the tokenizer file at path, which all executors have.
    Returns the manifest: part, shard, path, offset, n_bytes, n_ids, doc_ids (in order), base (ids in shards before)."""
    id_type = df.schema[id_col].dataType
    rows = df.select(F.col(f"`{id_col}`").alias("id"), common.as_bytes(f"`{text_col}`").alias("payload"))
    rows = rows.repartitionByRange(F.col("id")).sortWithinPartitions("id", "payload")
    end_bytes = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at, encoder, shards, ids_type = f"{folder}/{uuid.uuid4().hex}.rps", None, 0, None, [], None
        keys, texts, size = [], [], 0

        def flush() -> None:
            nonlocal out, at, keys, texts, size
            if out is None:
                system, place = common.filesystem(name)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(place, compression=None)
            ids = np.frombuffer(b"".join(texts), "<u4")
            starts = np.cumsum([0, *[len(t) // 4 for t in texts[:-1]]])
            data = pack(ids, starts, encoder.tokenizer.get_vocab_size())
            out.write(data)
            shards.append((at, len(data), len(ids), keys))
            at += len(data)
            keys, texts, size = [], [], 0

        for b in batches:
            ids_type = b.column(0).type
            encoder = tokens.encoder(path)
            for key, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                keys.append(key)
                texts.append(ids + end_bytes)
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    flush()
        if texts:
            flush()
        if out is not None:
            out.close()
            part = TaskContext.get().partitionId()
            for k, (offset, n_bytes, n_ids, own) in enumerate(shards):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([name]), pa.array([offset]), pa.array([n_bytes]), pa.array([n_ids]), pa.array([own], pa.list_(ids_type))],
                    ["part", "shard", "path", "offset", "n_bytes", "n_ids", "doc_ids"],
                )

    schema = f"part int, shard int, path string, offset long, n_bytes long, n_ids long, doc_ids array<{id_type.simpleString()}>"
    manifest = common.table(common.map_batches(rows, run, schema, keeps=True), "manifest")
    before = W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)  # a row a shard
    bases = manifest.select("part", "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return manifest.join(bases, ["part", "shard"])


def read(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """A row for each document of the manifest's shards: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, and ids (little-endian unsigned 32-bit; null unless with_ids)."""
    id_type = manifest.schema["doc_ids"].dataType.elementType
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.repartition(tasks, "part", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.schema.field("doc_ids").type.value_type
            for row in b.to_pylist():
                system, place = common.filesystem(row["path"])
                with system.open_input_file(place) as file:
                    shard = Shard(file.read_at(row["n_bytes"], row["offset"]))
                starts, counts, sums, held = [], [], [], []
                for k, ids in enumerate(shard.documents()):
                    starts.append(row["base"] + int(shard.first_id[k]))
                    counts.append(len(ids) // 4)
                    sums.append(zlib.crc32(ids))
                    held.append(ids if with_ids else None)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], kind), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return common.map_batches(spread, run, f"doc_id {id_type.simpleString()}, start long, n_tokens long, ids_crc32 long, ids binary")


def op6_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(common.documents(spark, sf_dir), common.shared_dir(spark) + "/ids", tokens.vocabulary("word_bpe_49k.json"))
    return read(manifest, with_ids=False).drop("ids")

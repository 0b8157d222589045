"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries.

Fingerprints. A text's words are lower-cased in A-Z and parted at ASCII white space; its shingles of
`size` words, repeats included, are hashed by XXH64 with seed 42, and a bit is 1 if it is set in over
half the hashes. A text of fewer words is one shingle; a text without words has fingerprint 0.

Links. Distinct fingerprints are dealt by the bits of some blocks: of k blocks, two fingerprints
within the budget agree in k - budget at least, so dealing by every choice of that many blocks
brings each pair together. k grows with the number of fingerprints, so groups stay small on the
average at any size; groups over HOT are dealt on in the same way by the bits in which they may still
differ. In each group a binary trie is joined with itself: pairs of nodes go down together, add up
differing bits, and end once the budget is exceeded. Pairs go by their differing bits, fewest first, and
a pair of nodes whose fingerprints are all in one component already is dropped, so a dense group costs
no square. A task returns the pairs that joined two of its components, never all pairs.

Components. Pairs of all tasks are contracted in rounds. Every round's result is a table in the
shared folder.

Copies share a fingerprint, so they are linked by it alone. A null text is an empty one, and all
empty texts are one component. component_id is the smallest id of a component; null ids count only
where there is no other. Columns of the input travel in a struct, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIZE, BUDGET, SEED = 4, 4, 42
#: Fingerprints of a group on the average, at most; of a group before it is dealt on; of a task about.
GROUP, HOT, TASK = 128, 50_000, 400_000
#: Node pairs with so many fingerprint pairs are compared; about so many fingerprint pairs at once.
LEAF, COMPARE = 32, 1 << 18
#: Edges that one task contracts.
SMALL = 200_000
#: Blocks of the bits that a hot group is dealt on by.
FINE = 14
PIECE = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LANES = np.arange(8) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # high bit first


# -- fingerprints ----------------------------------------------------------------------------------


def _hashes(payload: bytes, size: int) -> Iterator[np.ndarray]:
    """The shingles' hashes, a piece of the text at a time."""
    h, before, at, none = xxhash.xxh64_intdigest, [], 0, True
    while at < len(payload):
        end = len(payload)
        if end - at > PIECE and (m := _SPACE.search(payload, at + PIECE)):
            end = m.end()
        words, at = before + payload[at:end].lower().split(), end
        if len(words) < size:
            before = words
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        n = len(words) - size + 1
        yield np.fromiter((h(joined[a : b - 1], SEED) for a, b in zip([0, *ends[: n - 1]], ends[size - 1 :], strict=True)), np.uint64, n)
        before, none = words[len(words) - size + 1 :], False
    if none and before:
        yield np.array([h(b" ".join(before), SEED)], np.uint64)


def fingerprint(payload: bytes | None, size: int = SIZE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    counts, n = np.zeros(2048, np.int64), 0
    for h in _hashes(payload or b"", size):
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048)
        n += len(h)
    ones = counts.reshape(8, 256) @ _BITS  # lane 0 is the lowest byte
    return int.from_bytes(np.packbits(ones[::-1] * 2 > n, axis=1).tobytes(), signed=True) if n else 0


def fingerprints(df: DataFrame, text_col: str = "text", carry: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """`row` with the columns of carry (None: all) and `fp`, the fingerprint as a long."""
    return common.map_texts(df, text_col, df.columns if carry is None else carry, lambda: lambda texts: ([fingerprint(t, size) for t in texts],), [("fp", "long", pa.int64())])


# -- links -----------------------------------------------------------------------------------------


def blocks_of(k: int, budget: int, within: int) -> list[int]:
    """The masks of all but `budget` of k blocks of the bits of within: two fingerprints that differ in so many of these
    bits at most agree under one of them."""
    bits = [d for d in range(64) if within >> d & 1]
    edges = [len(bits) * i // k for i in range(k + 1)]
    blocks = [sum(1 << d for d in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, k - budget)]


def masks(n: int, budget: int, group: int = GROUP) -> list[int]:
    """A mask of bits for each way to deal n fingerprints: any two within the budget agree under one of them, and a mask
    has enough bits for groups of about `group`."""
    k = budget + 1
    while k < 64 and n >> (64 * (k - budget) // k) > group:
        k += 1
    return blocks_of(k, budget, (1 << 64) - 1)


def finer(mask: int, budget: int) -> list[int]:
    """Masks that deal a group which agrees under mask, so that any two within the budget agree under one and few bits
    are left: 2 to the number of these bounds the fingerprints of a group."""
    rest = ~mask % (1 << 64)
    return [mask | m for m in blocks_of(FINE, budget, rest)] if rest.bit_count() > FINE > budget else [mask]


class Forest:
    """Union of places 0..n-1, with the least place as a component's label; edges: the pairs that joined two components."""

    def __init__(self, label: np.ndarray) -> None:
        self.label, self.edges = label, []

    def near(self, a: np.ndarray, b: np.ndarray, differ: np.ndarray | None = None) -> None:
        """Joins what a and b have in pairs, the nearest pairs first if differ says how far they are."""
        if differ is not None:
            for least in range(0, int(differ.max()) + 1, 4):
                own = (differ >= least) & (differ < least + 4)
                if own.any():
                    self.near(a[own], b[own])
            return
        x, y = self.label[a], self.label[b]
        while len(keep := np.flatnonzero(x != y)):
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.label, high, low)
            won = np.flatnonzero(self.label[high] == low)
            won = won[np.unique(high[won], return_index=True)[1]]  # a component hooks once
            self.edges.append((a[won], b[won]))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label[:] = up
            x, y = self.label[high], self.label[low]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        a, b = zip(*self.edges, strict=True) if self.edges else ([none], [none])
        return np.concatenate(a), np.concatenate(b)


def trie_join(words: np.ndarray, groups: np.ndarray, budget: int, found, leaf: int = LEAF) -> None:
    """Calls found.near(a, b, differ) with places of fingerprints of one group that differ in at most budget bits, and in how
    many, but for pairs that found.label has in one component by then. words: a row for each fingerprint, unsigned and sorted within groups;
    groups: numbers, equal ones side by side."""
    n, deep = len(words), 64 * words.shape[1]
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if n else np.zeros(0, int)
    ends = np.append(starts[1:], n)
    ones: dict[int, np.ndarray] = {}
    waiting: list[dict[int, list[np.ndarray]]] = [{} for _ in range(budget + 2)]
    waiting[0][0] = [np.stack([starts, ends, starts, ends])]
    for e in range(budget + 1):
        active = np.zeros((4, 0), int)
        for level in range(deep + 1):
            if not active.shape[1] and level not in waiting[e]:
                continue
            active = _needed(np.concatenate([active, *waiting[e].pop(level, [])], axis=1), found.label)
            active = _leaves(active, words, found, budget, leaf, level == deep)
            if level == deep or not active.shape[1]:
                continue
            if level not in ones:
                bit = words[:, level >> 6] >> np.uint64(63 - (level & 63)) & np.uint64(1)
                ones[level] = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
            one = ones[level]
            a, b, x, y = active
            m, w = b - (one[b] - one[a]), y - (one[y] - one[x])
            other = a != x
            active = np.concatenate([np.stack([a, m, x, w]), np.stack([m, b, w, y])], axis=1)
            if e < budget:
                crossed = [np.stack([a, m, w, y]), np.stack([m[other], b[other], x[other], w[other]])]
                crossed = _needed(np.concatenate(crossed, axis=1), found.label)
                if crossed.shape[1]:
                    waiting[e + 1].setdefault(level + 1, []).append(crossed)


def _needed(pairs: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Without pairs of empty nodes, of one fingerprint with itself, and of nodes in one component."""
    a, b, x, y = pairs
    pairs = pairs[:, (a < b) & (x < y) & ~((a == x) & (b - a == 1))]
    if pairs.shape[1]:
        a, b, x, y = pairs
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        joined = (change[a] == change[b - 1]) & (change[x] == change[y - 1]) & (label[a] == label[x])
        pairs = pairs[:, ~joined]
    return pairs


def _leaves(pairs: np.ndarray, words: np.ndarray, found, budget: int, leaf: int, every: bool) -> np.ndarray:
    """Compares the fingerprints of small pairs of nodes (all at the last level), tells found of those within the budget,
    and returns the other pairs."""
    if not pairs.shape[1]:
        return pairs
    a, b, x, y = pairs
    count = (b - a) * (y - x)
    small = np.ones(len(a), bool) if every else count <= leaf
    at = np.flatnonzero(small)
    total, k = np.cumsum(count[at]), 0
    while k < len(at):  # about COMPARE pairs at once
        end = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + COMPARE, "right")))
        part, k = at[k:end], end
        n = count[part]
        which = np.repeat(np.arange(len(part)), n)
        within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        wide = (y - x)[part][which]
        left, right = a[part][which] + within // wide, x[part][which] + within % wide
        ordered = left < right  # a node with itself has each pair twice
        if not ordered.all():
            left, right = left[ordered], right[ordered]
        differ = np.bitwise_count(words[left, 0] ^ words[right, 0])
        near = differ <= budget
        for w in range(1, words.shape[1]):
            left, right, differ = left[near], right[near], differ[near]
            differ = differ + np.bitwise_count(words[left, w] ^ words[right, w])
            near = differ <= budget
        if near.any():
            found.near(left[near], right[near], differ[near])
    return pairs[:, ~small]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deal(prints: DataFrame, n: int, budget: int, group: int, hot: int) -> DataFrame:
    """g, fp: fingerprints by the groups in which they meet. Groups of over `hot` are dealt on by the bits in which their
    fingerprints may still differ, so their rows grow by a fixed factor, whatever their size."""
    spark, ways = prints.sparkSession, masks(n, budget, group)
    rows = prints.select("fp", F.explode(F.array(*[F.lit(signed(m)).cast("long") for m in ways])).alias("mask"))
    rows = rows.withColumn("g", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
    large = common.table(rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > hot).select("g", F.lit(True).alias("hot")), "large")
    if large.isEmpty():
        return rows.select("g", "fp")
    rows = rows.join(large, "g", "left")
    on = spark.createDataFrame([(signed(m), [signed(x) for x in finer(m, budget)]) for m in ways], "mask long, finer array<long>")
    again = rows.where("hot").join(F.broadcast(on), "mask").select("fp", F.explode("finer").alias("mask"))
    return rows.where("hot is null").select("g", "fp").unionByName(again.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("g"), "fp"))


def links(prints: DataFrame, budget: int = BUDGET, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) within the budget that connect just what all such pairs connect; prints: a table of distinct `fp`."""
    n = prints.count()
    dealt = deal(prints, n, budget, group, hot)
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks(n, budget, group)) // TASK + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[x.to_numpy(zero_copy_only=False) for x in b.columns] for b in batches]
        if not cols:
            return
        group, fp = (np.concatenate(x) for x in zip(*cols, strict=True))
        cols.clear()
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, group))
        group, fp = group[order], fp[order]
        found = Forest(np.arange(len(fp)))
        trie_join(fp[:, None], group, budget, found)
        a, b = found.pairs()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])

    return common.map_batches(dealt.repartition(tasks, "g"), run, "a long, b long").distinct()


def connected(edges: DataFrame, small: int = SMALL) -> DataFrame | None:
    """node, root for each node of edges (a, b): the least node of its component; None if there is no edge. Each round,
    nodes hook to their least neighbour in the order of a hash, which has no long chains, and edges go on between the
    nodes they lead to, so rounds grow with the logarithm of the number of nodes. At most `small` edges are contracted in one
    task."""
    edges = common.table(edges.select("a", "b"), "edges")
    nodes = None
    while n := edges.count():
        if n <= small:
            jump = common.map_batches(edges.coalesce(1), _contract, "node long, root long")
        else:
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("node")))
            up = common.table(both.groupBy("a").agg(F.least(least, F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("node")))["node"].alias("up")), "up")
            top = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
            jump = up.join(top, "up").select("a", F.col("top").alias("up"))
            jump = jump.join(top, "up").select(F.col("a").alias("node"), F.col("top").alias("root"))
        jump = common.table(jump, "jump")
        if nodes is None:
            nodes = jump
        else:
            step = jump.select(F.col("node").alias("root"), F.col("root").alias("next"))
            nodes = common.table(nodes.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "nodes")
        if n <= small:
            break
        a, b = (jump.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        edges = common.table(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    if nodes is None or nodes is jump and n:
        return nodes
    return common.table(nodes.join(nodes.groupBy("root").agg(F.min("node").alias("least")), "root").select("node", F.col("least").alias("root")), "nodes")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of the edges of one task."""
    ends = [[x.to_numpy() for x in b.columns] for b in batches]
    if ends:
        names, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*ends, strict=True)]), return_inverse=True)
        found = Forest(np.arange(len(names)))
        found.near(*at.reshape(2, -1))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[found.label])], ["node", "root"])


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, budget: int = BUDGET) -> DataFrame:
    """id, fp, component_id, root (a fingerprint that names the component) for each row of df."""
    docs = common.table(fingerprints(df, text_col, [id_col], size).select(F.col(f"row.{id_col}").alias("id"), "fp"), "fingerprints")
    prints = common.table(docs.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    return classes(docs, prints, connected(links(prints.select("fp"), budget)))


def classes(docs: DataFrame, prints: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """id, fp, component_id, root for each row (id, fp) of docs; prints: fp, least id; nodes: what connected returns."""
    if nodes is None:
        found = prints.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    else:
        rooted = common.table(prints.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
        found = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return docs.join(found, "fp").select("id", "fp", "component_id", "root")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, budget: int = BUDGET) -> DataFrame:
    """df with one row of each component: one with the smallest id, the first by its other columns as text."""
    return one_of_each(df, components(df, id_col, text_col, size, budget), id_col, lambda rows: fingerprints(rows, text_col, df.columns, size))


def one_of_each(df: DataFrame, found: DataFrame, id_col: str, named: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with one row of each component of found (id, fp, component_id, root). Rows whose ids only kept rows have, by a
    bitmap of the others, stay where they are; only the rest is told apart, by id and by `fp`, which named gives."""
    found = common.table(found, "components")
    stays = F.col("id").eqNullSafe(F.col("component_id"))
    several = found.where(stays).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("id")).where("n > 1")
    unsure = common.share(df.sparkSession, common.bitmap(found.where(~stays).select("id").unionByName(several.select("id")).select(F.xxhash64("id").alias("key"))))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(F.col(id_col)).alias("key"))

    def part(sure: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = unsure.value.has(b.column(1).to_numpy(zero_copy_only=False))
                at = np.flatnonzero(~hit if sure else hit)
                if len(at):
                    yield b.select(["row"]).take(pa.array(at))

        return common.map_batches(rows, run, T.StructType([rows.schema["row"]])).select("row.*")

    prints = named(part(False))
    known = found.select(F.col("id").alias("__id"), F.col("fp").alias("__fp"), "component_id", "root").distinct()
    told = prints.join(known, F.col("row")[id_col].eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp")))
    told = told.where(F.col("row")[id_col].eqNullSafe(F.col("component_id")))
    first = F.min_by(F.struct("row.*"), F.xxhash64(F.col("row").cast("string"))).alias("row")
    return part(True).unionByName(told.groupBy("root").agg(first).select("row.*"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(common.documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

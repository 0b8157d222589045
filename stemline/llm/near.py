"""Near copies: SimHash finds pairs, and their sets of word shingles decide.

Sets. A text's shingles are those of SimHash (words lower-cased in A-Z, parted at ASCII white space;
a text of fewer words is one shingle), each once, as 64-bit hashes. Texts with one set are copies and
share `sid`, a hash of the set. A null text is an empty one; empty texts share the empty set.

Candidates. A set's fingerprint has BITS bits, each the majority of its shingles' hashes. Two sets of
Jaccard similarity t differ in a bit with the probability arccos(2t / (1 + t)) / pi at most, so the
budget of differing bits and the number of ways to deal follow from `least` and MISSED, the part of
pairs at just that similarity that may be missed; more similar ones are missed far less. A way deals
fingerprints by some of their bits, more bits for more fingerprints, so groups stay small on the
average at any size. In each group SimHash's trie self-join finds the pairs within the budget.

Links. Candidates are compared by their whole sets, so nothing below `least` is linked. The first
ways find most copies; what links connect doesn't meet again in the other ways. In both, a task
returns the pairs that join components of its groups, the nearest first. Some of these fail, and then
others of the component may count. So components of candidates that links don't connect whole are
searched again at the end, with their sets at hand: in each the trie self-join compares all pairs within
the budget that aren't linked by then. Nothing is listed but links.

Hot groups. Groups over HOT are dealt in parts, and their sets count as one component of candidates.
A component of over BYTES of sets is dealt in parts for the last search: the sets of the linked component
that has most of it stay in one part, and the others go to all parts.

component_id is the smallest id of a component; null ids count only where there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import acos, comb, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

BITS, MISSED = 128, 0.01
#: Ways of the first part; sets of a group on the average, and before it is dealt in parts; rows of a task; bytes of sets of a task.
FIRST, GROUP, HOT, TASK, BYTES = 3, 128, 20_000, 250_000, 24 << 20


def shingles(payload: bytes | None, size: int) -> np.ndarray:
    """The hashes of a text's shingles, made of the hashes of their words; sorted, each once."""
    words = common.word_names((payload or b"").lower())
    many = min(size, len(words))
    out = np.zeros(len(words) - many + 1 if many else 0, np.uint64)
    for k in range(many):
        out = common.mixed(out + words[k : k + len(out)] + np.uint64(many))
    return np.unique(out)


def set_id(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.astype("<u8").tobytes()) - (1 << 63)


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """Of a set, as two signed 64-bit integers: bits of the hashes, and of the hashes mixed."""
    out, h = [], own
    for _ in range(BITS // 64):
        counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + simhash._LANES).ravel(), minlength=2048) if len(h) else np.zeros(2048, int)
        ones = counts.reshape(8, 256) @ simhash._BITS
        out.append(int.from_bytes(np.packbits(ones[::-1] * 2 > len(own), axis=1).tobytes(), signed=True))
        h = common.mixed(h)
    return tuple(out)


def prints(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, sid, f0, f1 of each row."""

    def start():
        def run(texts: list) -> tuple:
            own = [shingles(t, size) for t in texts]
            words = [fingerprint(x) for x in own]
            return [set_id(x) for x in own], [x[0] for x in words], [x[1] for x in words]

        return run

    found = common.map_texts(df, text_col, [id_col], start, [(x, "long", pa.int64()) for x in ("sid", "f0", "f1")])
    return found.select(F.col(f"row.`{id_col}`").alias("id"), "sid", "f0", "f1")


def _binomial(p: float) -> list[float]:
    return [comb(BITS, d) * p**d * (1 - p) ** (BITS - d) for d in range(BITS + 1)]


def budget_of(least: Fraction) -> int:
    """Differing bits of pairs of similarity least, but for a quarter of MISSED."""
    total, chance = 0.0, _binomial(acos(float(2 * least / (1 + least))) / pi)
    for d, c in enumerate(chance):
        total += c
        if total >= 1 - MISSED / 4:
            return d
    return BITS


def ways_of(n: int, least: Fraction, group: int = GROUP) -> list[tuple[int, int]]:
    """Masks (of f0, of f1) by which n sets are dealt. Of pairs of similarity least a part of MISSED at most agrees under none."""
    width = max(1, round(log2(max(2, n / group))))
    chance, agree = _binomial(acos(float(2 * least / (1 + least))) / pi), []
    for d in range(BITS + 1):
        agree.append(comb(BITS - width, d) / comb(BITS, d) if d <= BITS - width else 0.0)
    count = 1
    while sum(c * (1 - a) ** count for c, a in zip(chance, agree, strict=True)) > 0.75 * MISSED:
        count += 1
    rng, out, order = np.random.default_rng(42), [], []
    while len(out) < count:
        if len(order) < width:
            order = rng.permutation(BITS).tolist()
        chosen, order = order[:width], order[width:]
        out.append(tuple(sum(1 << (b - at) for b in chosen if 0 <= b - at < 64) for at in (0, 64)))
    return out


def meet(g: np.ndarray, words: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by group and fingerprint, and in that order the first place of each group's rows of one root."""
    order = np.lexsort((*words.T[::-1], g))
    g, root = g[order], root[order]
    by = np.lexsort((np.arange(len(g)), root, g))
    new = np.concatenate([[True], (g[by][1:] != g[by][:-1]) | (root[by][1:] != root[by][:-1])]) if len(g) else np.zeros(0, bool)
    label = np.empty(len(g), np.int64)
    label[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, label


class Exact(simhash.Forest):
    """Joins only pairs whose sets have a similarity of least or more."""

    def __init__(self, label: np.ndarray, sets: list[np.ndarray], least: Fraction) -> None:
        super().__init__(label)
        self.sizes, self.least = np.array([len(x) for x in sets], np.int64), least
        self.starts = np.cumsum(self.sizes) - self.sizes
        names, self.flat = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
        self.mark = np.zeros(len(names), bool)

    def near(self, a: np.ndarray, b: np.ndarray, differ: np.ndarray) -> None:
        order = np.lexsort((a, differ >> 2))  # the nearest first
        a, b, step = a[order], b[order], differ[order] >> 2
        edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (step[1:] != step[:-1])]))
        for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(a)], strict=True):
            one, others = a[x], b[x:y]
            others = others[self.label[others] != self.label[one]]
            if len(others):
                near = others[self.alike(one, others)]
                super().near(np.full(len(near), one), near)

    def alike(self, one: int, others: np.ndarray) -> np.ndarray:
        own, n = self.flat[self.starts[one] : self.starts[one] + self.sizes[one]], self.sizes[others]
        ends = np.cumsum(n)
        self.mark[own] = True
        hit = np.concatenate([[0], np.cumsum(self.mark[self.flat[np.repeat(self.starts[others] - (ends - n), n) + np.arange(ends[-1])]])])
        self.mark[own] = False
        both = hit[ends] - hit[ends - n]
        return both * self.least.denominator >= self.least.numerator * (len(own) + n - both)


#: Node pairs of so many pairs of sets are compared: most groups part in few steps, and differ in half their bits.
LEAF = 256


def candidates(rows: DataFrame, ways: list[tuple[int, int]], budget: int, hot: int) -> DataFrame:
    """a, b, near: pairs of sids within the budget that join components of their groups; and, not near, the sids of a hot
    group, each with one of them. rows: sid, f0, f1, root."""
    spark = rows.sparkSession
    masks = F.array(*[F.struct(F.lit(k).alias("way"), *[F.lit(simhash.signed(m)).cast("long").alias(f"m{i}") for i, m in enumerate(w)]) for k, w in enumerate(ways)])
    dealt = rows.select("*", F.explode(masks).alias("m"))
    key = F.xxhash64("m.way", F.col("f0").bitwiseAND(F.col("m.m0")), F.col("f1").bitwiseAND(F.col("m.m1")))
    dealt = dealt.select(key.alias("g"), "sid", "f0", "f1", "root")
    sizes = dealt.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("sid").alias("one")).where(F.col("size") > hot)
    sizes = common.table(sizes.select("g", "one", F.ceil(F.col("size") / F.lit(hot)).cast("int").alias("parts")), "large")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() * len(ways) // TASK + 1)
    together = None
    if not sizes.isEmpty():
        dealt = dealt.join(sizes, "g", "left")
        together = dealt.where("one <> sid").select(F.col("one").alias("a"), F.col("sid").alias("b"), F.lit(False).alias("near"))
        dealt = dealt.withColumn("g", F.when(F.col("parts").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.pmod(F.xxhash64("sid", "g"), "parts"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[x.to_numpy(zero_copy_only=False) for x in b.columns] for b in batches]
        if not cols:
            return
        g, sid, f0, f1, root = (np.concatenate(x) for x in zip(*cols, strict=True))
        cols.clear()
        words = np.stack([f0, f1], axis=1).view(np.uint64)
        order, label = meet(g, words, root)
        found = simhash.Forest(label)
        simhash.trie_join(words[order], g[order], budget, found, LEAF)
        a, b = (sid[order[x]] for x in found.pairs())
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.ones(len(a), bool))], ["a", "b", "near"])

    found = common.map_batches(dealt.select("g", "sid", "f0", "f1", "root").repartition(tasks, "g"), run, "a long, b long, near boolean")
    return (found if together is None else found.unionByName(together)).distinct()


def sets_of(df: DataFrame, wanted: DataFrame, text_col: str, id_col: str, size: int) -> DataFrame:
    """sid, set (little-endian unsigned 64-bit) of wanted (sid, `least`: an id that has it). Only these sets are shuffled:
    a bitmap of ids tells their rows."""
    needed = common.share(df.sparkSession, common.bitmap(wanted.select(F.xxhash64("least").alias("key"))))
    rows = df.select(F.xxhash64(F.col(f"`{id_col}`")).alias("key"), common.as_bytes(f"`{text_col}`").alias("payload"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.flatnonzero(needed.value.has(b.column(0).to_numpy()))
            own = [shingles(x, size) for x in b.column(1).take(pa.array(at)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in own], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in own], pa.binary())], ["sid", "set"])

    found = common.map_batches(rows, some, "sid long, set binary").join(wanted.select("sid"), "sid", "left_semi")
    return common.table(found.groupBy("sid").agg(F.first("set").alias("set")), "sets")


def similar(df: DataFrame, ids: DataFrame, pairs: DataFrame, text_col: str, id_col: str, size: int, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of least or more. ids: sid, least."""
    wanted = common.table(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(ids, "sid").select("sid", "least"), "wanted")
    sets = sets_of(df, wanted, text_col, id_col, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                near.append(both * least.denominator >= least.numerator * ((len(x) + len(y)) // 8 - both))
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    whole = pairs.join(sets.select(F.col("sid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("set").alias("y")), "b")
    return common.map_batches(whole.select("a", "b", "x", "y"), run, "a long, b long")


def searched(df: DataFrame, ids: DataFrame, groups: DataFrame, text_col: str, id_col: str, size: int, least: Fraction, budget: int, limit: int) -> DataFrame:
    """Pairs (a, b) of linked sets that join the roots of a group wherever sets within the budget do. groups: sid, g, root."""
    spark = df.sparkSession
    rows = groups.join(ids, "sid")
    sets = sets_of(df, rows.select("sid", "least"), text_col, id_col, size)
    rows = rows.join(sets, "sid").select("g", "sid", "f0", "f1", "root", "set")
    heavy = rows.groupBy("g", "root").agg(F.sum(F.octet_length("set")).alias("b")).groupBy("g").agg(F.sum("b").alias("b"), F.max_by("root", "b").alias("major"))
    heavy = common.table(heavy.select("g", "b", "major", F.ceil(F.col("b") / F.lit(limit)).cast("int").alias("parts")), "heavy")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(heavy.agg(F.sum("b")).first()[0] or 0) // limit + 1)
    part = F.pmod(F.xxhash64("sid"), "parts").cast("int")
    rows = rows.join(heavy, "g").withColumn("part", F.explode(F.when(F.col("root") == F.col("major"), F.array(part)).otherwise(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, sets = [], []
        for x in batches:
            cols.append([x.column(k).to_numpy(zero_copy_only=False) for k in range(5)])
            sets += [np.frombuffer(y, "<u8") for y in x.column(5).to_pylist()]
        if not cols:
            return
        g, sid, f0, f1, root = (np.concatenate(x) for x in zip(*cols, strict=True))
        words = np.stack([f0, f1], axis=1).view(np.uint64)
        order, label = meet(g, words, root)
        found = Exact(label, [sets[k] for k in order.tolist()], least)
        simhash.trie_join(words[order], g[order], budget, found, LEAF)
        a, b = (sid[order[x]] for x in found.pairs())
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = rows.select(F.xxhash64("g", "part").alias("g"), "sid", "f0", "f1", "root", "set").repartition(tasks, "g")
    return common.map_batches(dealt, run, "a long, b long").distinct()


def links(df: DataFrame, ids: DataFrame, text_col: str, id_col: str, size: int, least: Fraction, first: int = FIRST, hot: int = HOT, limit: int = BYTES) -> DataFrame | None:
    """node, root of simhash.connected for the sids that have a link; None: there is none. ids: sid, f0, f1, least."""
    ways, budget = ways_of(ids.count(), least), budget_of(least)
    edges, nodes, met = None, None, None

    def rooted(rows: DataFrame) -> DataFrame:
        if nodes is None:
            return rows.withColumn("root", F.col("sid"))
        return rows.join(nodes.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))

    for part in (ways[:first], ways[first:]):
        if part:
            new = common.table(candidates(rooted(ids.select("sid", "f0", "f1")), part, budget, hot), "candidates")
            met = new if met is None else met.unionByName(new)
            pairs = new.where("near").select("a", "b")
            if not pairs.isEmpty():
                new = common.table(similar(df, ids, pairs, text_col, id_col, size, least), "links")
                edges = new if edges is None else edges.unionByName(new)
                nodes = simhash.connected(edges)
    groups = simhash.connected(met.select("a", "b"))
    if groups is None:
        return nodes
    groups = common.table(rooted(groups.select(F.col("node").alias("sid"), F.col("root").alias("g"))), "groups")
    split = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("n > 2 and x <> y")
    groups = common.table(groups.join(split.select("g"), "g", "left_semi").select("sid", "g", "root"), "split")
    if not groups.isEmpty():
        new = common.table(searched(df, ids, groups, text_col, id_col, size, least, budget, limit), "links")
        edges = new if edges is None else edges.unionByName(new)
        nodes = simhash.connected(edges)
    return nodes


def components(df: DataFrame, id_col: str, text_col: str, size: int, least: Fraction, **how) -> DataFrame:
    """id, fp (the sid), component_id, root (a sid that names the component) for each row of df."""
    found = common.table(prints(df, id_col, text_col, size), "prints")
    ids = common.table(found.groupBy("sid").agg(F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.min("id").alias("least")), "ids")
    nodes = links(df, ids, text_col, id_col, size, least, **how)
    return simhash.classes(found.select("id", F.col("sid").alias("fp")), ids.select(F.col("sid").alias("fp"), "least"), nodes)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int, least: Fraction) -> DataFrame:
    """df with one row of each component: one with the smallest id, the first by its other columns as text."""

    def named(rows: DataFrame) -> DataFrame:
        return common.map_texts(rows, text_col, df.columns, lambda: lambda texts: ([set_id(shingles(t, size)) for t in texts],), [("fp", "long", pa.int64())])

    return simhash.one_of_each(df, components(df, id_col, text_col, size, least), id_col, named)

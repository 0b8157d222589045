import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stemline.llm import simhash


def brute(text, size=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(fps, near):
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None], len(fps)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_fingerprints_equal_brute_force_for_any_piece(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", "A b", "  x  ", "É b c d e f\n\x0bg", "a b c d " * 50, "a" + " " * 500 + "b", " " * 500, "x" * 500, "a b " + " " * 200 + "c" + " " * 300]
    texts += ["".join(rng.choice("ab C  \n") for _ in range(rng.randrange(400))) for _ in range(100)]
    for piece in (simhash.PIECE, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        for t in texts:
            assert simhash.fingerprint(t.encode()) % (1 << 64) == brute(t), repr(t)


@pytest.mark.parametrize("mask", [0, 0xFF, 0xFFF << 40])
def test_trie_join_equals_brute_force(mask):
    rng = np.random.default_rng(mask % 97)
    for _ in range(15):
        n = rng.integers(1, 300)
        fps = rng.integers(0, 2**63, 3).astype(np.uint64)[rng.integers(0, 3, n)]
        for _ in range(rng.integers(0, 9)):
            fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        fps = np.unique(fps)
        key = fps & np.uint64(mask)
        order = np.lexsort((fps, key))
        fps, key = fps[order], key[order]
        number = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
        near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= 4) & (key[:, None] == key[None])
        found = simhash.Forest(np.arange(n))
        found.label = found.label[: len(fps)]
        simhash.trie_join(fps[:, None], number, 4, found)
        assert (found.label == classes(fps, near)).all()
        a, b = found.pairs()
        assert near[a, b].all() and len(a) == len(fps) - len(set(found.label.tolist()))


def test_a_dense_ball_costs_no_square():
    rng = np.random.default_rng(1)
    fps = np.repeat(rng.integers(0, 2**63, 1).astype(np.uint64), 300_000)
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64))
    fps = np.unique(fps)
    assert len(fps) > 100_000
    found = simhash.Forest(np.arange(len(fps)))
    simhash.trie_join(fps[:, None], np.zeros(len(fps), int), 4, found)
    assert not found.label.any()


def test_any_pair_within_the_budget_agrees_under_a_mask():
    rng = random.Random(1)
    for n in (10, 10**6, 10**9):
        masks = simhash.masks(n, 4)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & m for m in masks)
            assert any(not diff & m for x in masks if not diff & x for m in simhash.finer(x, 4))


@pytest.mark.parametrize("hot", [simhash.HOT, 4])
def test_components_equal_brute_force_with_and_without_hot_groups(spark, hot):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centres for _ in range(40)}
    fps = sorted(fps)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(3)
    nodes = simhash.connected(simhash.links(table, 4, 128, hot))
    root = {r["node"]: r["root"] for r in nodes.collect()}
    array = np.array(fps, np.uint64)
    want = classes(fps, np.bitwise_count(array[:, None] ^ array[None]) <= 4)
    got = [root.get(f - (1 << 64) if f >> 63 else f, f) for f in fps]
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (103, 102), (101, 103)]
    df = spark.createDataFrame(edges, "a long, b long")
    for small in (0, 3, simhash.SMALL):
        got = {r["node"]: r["root"] for r in simhash.connected(df, small).collect()}
        assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 104)}}


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    rounds, table = [], simhash.common.table
    monkeypatch.setattr(simhash.common, "table", lambda df, name="t": rounds.append(name) or table(df, name))
    got = simhash.connected(spark.range(1000).selectExpr("id as a", "id + 1 as b"), 0).collect()
    assert {r["root"] for r in got} == {0} and len(got) == 1001
    assert rounds.count("jump") <= 15


def test_a_hot_group_ten_times_over_the_limit_is_dealt_on_in_linear_rows(spark):
    rng, counts = random.Random(2), []
    base = rng.getrandbits(64)
    for n in (600, 1200):
        fps = sorted({base ^ rng.getrandbits(64) & ~(simhash.masks(n, 4)[0]) for _ in range(n)})
        prints = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
        dealt = simhash.deal(prints, len(fps), 4, 128, 60)
        assert dealt.groupBy("g").count().where("count > 60").count() == 0
        counts.append(dealt.count() / len(fps))
    assert counts[1] < 1.1 * counts[0] < 1.1 * 5 * 1001


def test_documents_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted((r["doc_id"], r["text"]) for r in rows.collect())
    fps = np.array([brute(t) for _, t in texts], np.uint64)
    label = classes(fps, np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    want = {(i, int(f), texts[k][0]) for (i, _), f, k in zip(texts, fps, label, strict=True)}
    assert {(r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.components(rows).collect()} == want


def test_odd_rows(odd, none):
    got = simhash.components(odd).collect()
    assert len(got) == odd.count()
    empty = {r["component_id"] for r in got if r["fp"] == 0}
    assert empty == {2}  # empty and null texts are one component, null ids count last
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "None", "4", "5", "6"])
    assert simhash.components(none).count() == simhash.keep_one(none).count() == 0
    assert kept.where(F.col("doc_id") == 1).count() == 1

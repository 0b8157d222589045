"""Near copies against brute force by exact Jaccard similarity."""

import random
from fractions import Fraction

import numpy as np
import pytest

from stemline.llm import near

corpus_pipeline = pytest.importorskip("corpus_pipeline")
LEAST = Fraction(4, 5)


def brute(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def want(texts):
    """The smallest id of each text's component."""
    sets, label = {k: brute(t) for k, t in texts.items()}, {k: k for k in texts}
    nearest = {a: [b for b in sets if similar(sets[a], sets[b])] for a in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            low = min(label[b] for b in nearest[a])
            changed, label[a] = changed or low < label[a], min(low, label[a])
    return label


def variants():
    """Groups of near copies on both sides of 0.8, all texts with one common passage, and texts of two shingles."""
    rng, out = random.Random(3), {}
    passage = [f"p{k}" for k in range(12)]
    for g in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 200))] + passage
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randrange(7)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            out[len(out)] = " ".join(words)
    for _ in range(60):
        out[len(out)] = " ".join(f"v{rng.randrange(4)}" for _ in range(6))
    return out


@pytest.mark.parametrize("how", [{}, {"hot": 20, "limit": 20_000}])
def test_components_equal_brute_force_whole_and_in_parts(spark, how):
    texts = variants()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    label = want(texts)
    got = {r["id"]: r["component_id"] for r in near.components(df, "doc_id", "text", 5, LEAST, **how).collect()}
    assert got == label and 6 < len(set(label.values())) < len(texts)


def test_pipeline_drops_what_is_similar_and_nothing_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    label = want(texts)
    kept = corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == [k for k in sorted(texts) if label[k] == k]


def test_pairs_at_the_least_similarity_are_within_the_budget_and_agree_under_a_way():
    rng, budget, met, close = np.random.default_rng(0), near.budget_of(LEAST), 0, 0
    ways = near.ways_of(10**6, LEAST)
    for _ in range(1000):
        words = rng.integers(0, 1 << 63, 100).astype(np.uint64)  # of 90 each 80 are shared: a similarity of 0.8
        a, b = (near.fingerprint(x) for x in (words[:90], words[10:]))
        differ = [(x ^ y) % (1 << 64) for x, y in zip(a, b, strict=True)]
        close += sum(x.bit_count() for x in differ) <= budget
        met += any(not (differ[0] & m0 or differ[1] & m1) for m0, m1 in ways)
    assert close >= 990 and met >= 980


def test_odd_rows(odd, none):
    got = {(r["id"], r["component_id"]) for r in near.components(odd, "doc_id", "text", 5, LEAST).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (None, 2), (None, None), (4, 4), (5, 5), (6, 6)}
    kept = near.keep_one(odd, size=5, least=LEAST)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "5", "6", "None"]
    assert near.keep_one(none, size=5, least=LEAST).count() == 0

"""The pipeline's stages against brute force, and its run as a whole."""

import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from stemline.llm import common, repeats  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_stages_equal_brute_force(spark):
    docs = common.documents(spark, SF)
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}

    first = common.table(corpus_pipeline.language_id(spark, docs, SF))
    assert first.columns == columns
    kept = {r["doc_id"]: r for r in first.collect()}
    assert {k for k, r in rows.items() if r["lang"] and len(r["text"]) > 20} <= set(kept) and all(kept[k] == rows[k] for k in kept)

    second = common.table(corpus_pipeline.near_dedup(spark, first, SF))
    sets = {k: shingles(r["text"]) for k, r in kept.items()}
    label = {k: k for k in kept}
    changed = True
    while changed:
        changed = False
        for a in kept:
            low = min(label[b] for b in kept if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
            changed, label[a] = changed or low < label[a], min(low, label[a])
    assert {r["doc_id"] for r in second.collect()} == {k for k in kept if label[k] == k} and second.columns == columns

    third = common.table(corpus_pipeline.suffix_dedup(spark, second, SF))
    had = {r["doc_id"]: r["text"].encode() for r in second.collect()}
    places = {k: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for k, t in had.items()}
    words = {k: [had[k][a:b] for a, b in own] for k, own in places.items()}
    seen: dict[tuple, int] = {}
    for w in words.values():
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])] = seen.get(tuple(w[i : i + 50]), 0) + 1
    want = {}
    for k, t in had.items():
        w = words[k]
        spans = repeats.union([(i, i + 50) for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] > 1])
        edges = [0, *[x for a, b in spans for x in (places[k][a][0], places[k][b - 1][1])], len(t)]
        text = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
        if not spans or text.strip():
            want[k] = text
    assert {r["doc_id"]: r["text"] for r in third.collect()} == want and third.columns == columns
    assert third.where(F.char_length("text") != F.col("n_chars")).count() == 0

    fourth = common.table(corpus_pipeline.decontaminate(spark, third, SF))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = common.words((r["text"] or "").encode())
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1)} if w else set()

    def clean(text):
        w = common.words(text.encode())
        return not any(tuple(w[k : k + m]) in windows for m in {len(x) for x in windows} for k in range(len(w) - m + 1))

    assert {r["doc_id"] for r in fourth.collect()} == {k for k, t in want.items() if clean(t)} and fourth.columns == columns

    last = corpus_pipeline.pack(spark, fourth, SF)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in fourth.collect()}


def test_run_is_its_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontaminate", "pack"]
    out = corpus_pipeline.run(spark, SF)
    sizes = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("sequence_length").alias("size"))
    assert sizes.where("n <> size or size > 1024").count() == 0
    whole = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("size"))
    assert whole.where("n <> size").count() == 0 and whole.count() > 100


def test_odd_rows_go_through_every_stage(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "score", "row", "spans", "fp", "payload", "labels", "ids", "n_words", "media", "digest")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.table(stage(spark, docs, SF), name)
    assert {r["doc_id"] for r in docs.collect()} == {1, 4, 5, None}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        empty = common.table(stage(spark, empty, SF), name)
    assert empty.count() == 0


def test_unlabelled_documents_stay(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, "...", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()] == [1]


def test_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "a " * 60, True, 120), (2, "b c", False, 3)], "doc_id long, text string, __cut boolean, n_chars long")
    got = corpus_pipeline.suffix_dedup(spark, docs, SF)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(2, "b c", False, 3)]

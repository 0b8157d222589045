import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from stemline.llm import common, grammar, packing, tokens

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def plain(name, texts):
    t = Tokenizer.from_file(tokens.vocabulary(name))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
def test_ids_are_the_library_s(name, monkeypatch):
    rng = random.Random(4)
    texts = ["", " ", "  a", "a  b c \n d", "é  　x y\u0085 z <|endoftext|> q", " x y ", "it's don 't 's", "İ ǅ ﬁ é á ́x ͅ b", "x  y", "'s'", "\n\nb'\n-éA", "2nd 3 4x", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>\n<|endoftext|> ", "<|endoftext |>"]
    texts += ["".join(rng.choice("ABaéÉ1' \n\tbs,.-́\x1c​") for _ in range(rng.randrange(30))) for _ in range(3000)]
    want = plain(name, texts)
    for parts, segments in ((400_000, 900_000), (3, 2), (0, 0)):
        monkeypatch.setattr(tokens, "PARTS", parts)
        monkeypatch.setattr(tokens, "SEGMENTS", segments)
        e = tokens.Encoder(tokens.vocabulary(name))
        for _ in range(2):
            got = e.encode([t.encode() for t in texts])
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert e.encode([None, b""]) == [b"", b""] and e.encode([]) == []


def test_parts_whose_hashes_are_equal_keep_their_own_ids(monkeypatch):
    texts = ["a bb ccc", "x bb ab aab " + "q" * 70 + " " + "é" * 20, "", " a", "z bb\u3000 c", "a ccc aab " + "é" * 20 + " " + "q" * 70]
    for mixed in (lambda h: h & np.uint64(0), lambda h: h & np.uint64(3), common.mixed):
        monkeypatch.setattr(common, "mixed", mixed)
        e = tokens.Encoder(tokens.vocabulary(NAMES[1]))
        for _ in range(3):
            assert [np.frombuffer(x, "<u4").tolist() for x in e.encode([t.encode() for t in texts])] == plain(NAMES[1], texts)
        assert e.known.n
    assert e.encode([b"a \xff\xe2\x82 b"]) == e.encode(["a \ufffd\ufffd b".encode()])


def test_shards_return_their_documents_alone_and_together():
    rng = np.random.default_rng(1)
    for first in (5, 70_000):
        for _ in range(60):
            docs = [rng.integers(0, 3, rng.integers(1, 60)) for _ in range(rng.integers(1, 6))]
            ids = np.concatenate(docs).astype("<u4")
            starts = np.cumsum([0, *[len(d) for d in docs[:-1]]])
            shard = grammar.Shard(grammar.pack(ids, starts, first))
            assert [np.frombuffer(x, "<u4").tolist() for x in shard.documents(3)] == [d.tolist() for d in docs]
            for k, d in enumerate(docs):
                a = rng.integers(0, len(d))
                b = rng.integers(a + 1, len(d) + 1)
                assert shard.document(k, a, b).tolist() == d[a:b].tolist()
                assert shard.document(k).tolist() == d.tolist()


def test_frequent_pairs_become_rules():
    ids = np.tile(np.array([3, 4, 3, 4, 9], np.uint32), 200)
    seq, starts, rules = grammar.compress(ids, np.array([0]), 10)
    assert len(seq) < len(ids) / 3 and [3, 4] in rules.tolist()
    assert grammar.expansion_lengths(10, rules).max() >= 4


def test_token_shards_equal_brute_force(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df, size in ((docs, 5000), (odd, 1 << 20)):
        manifest = grammar.write(df, common.shared_dir(spark) + "/ids", tokens.vocabulary(NAMES[0]), shard_ids=size)
        got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in grammar.read(manifest).collect()))
        rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0], r[1] is not None, (r[1] or "").encode()))
        start = 0
        for (key, text), r in zip(rows, got, strict=True):
            ids = np.array(plain(NAMES[0], [text or ""])[0] + [1], "<u4").tobytes()
            assert r == (start, key, len(ids) // 4, zlib.crc32(ids), ids)
            start += len(ids) // 4
    assert grammar.read(grammar.write(none, common.shared_dir(spark) + "/ids", tokens.vocabulary(NAMES[0]))).count() == 0


@pytest.mark.parametrize("first", [49_408, 1 << 16])
def test_rules_go_on_until_no_pair_is_frequent(first):
    rng = np.random.default_rng(0)
    copy = rng.integers(0, 40_000, 2000)
    cases = [(np.tile(copy, 260), 2000), (np.zeros(5000, int), 5000), (rng.integers(0, 9, 30_000), 300)]
    for ids, size in cases:
        starts = np.arange(0, len(ids), size)
        seq, at, rules = grammar.compress(ids, starts, first)
        assert (grammar.Grammar(first, rules).expand(seq.astype(np.int64)) == ids).all() and len(at) == len(starts)
        for k in np.unique(seq[:-1][np.diff(seq.astype(int)) != 0])[:50]:
            follow = np.flatnonzero(seq[:-1] == k)
            follow = follow[~np.isin(follow + 1, at)]
            after = seq[follow + 1]
            assert max(np.unique(after[after != k], return_counts=True)[1], default=0) < grammar.LEAST
    assert len(grammar.compress(cases[0][0], np.arange(0, 520_000, 2000), first)[0]) == 260  # a symbol a copy


def test_symbols_widen_where_that_pays():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 60_000, 400) for _ in range(100)]
    ids = np.concatenate([d for d in docs for _ in range(8)])
    starts, first = np.arange(0, len(ids), 400), (1 << 16) - 10
    seq, at, rules = grammar.compress(ids, starts, first)
    assert len(rules) > 10 and 4 * len(seq) + 12 * len(rules) < 2 * len(ids)
    shard = grammar.Shard(grammar.pack(ids, starts, first))
    assert b"".join(shard.documents()) == ids.astype("<u4").tobytes()


def check_packing(df, pool):
    rows = packing.pack(df, tokens.vocabulary(NAMES[1]), pool_ids=pool).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["row"]["doc_id"], r["row"]["text"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert set(docs) == set(want)
    for key in docs:
        ids = np.array(plain(NAMES[1], [key[1] or ""])[0] + [0], "<u4")
        whole = defaultdict(int)
        for r in docs[key]:
            assert r["doc_tokens"] == len(ids) and bytes(r["ids"]) == ids[r["start"] : r["start"] + r["length"]].tobytes()
            for k in range(r["start"], r["start"] + r["length"]):
                whole[k] += 1
        assert len(whole) == len(ids) and set(whole.values()) == {want.count(key)}
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == own[0]["sequence_length"] <= 1024 and not at & (at - 1)  # a power of two: no padding
    return sequences


@pytest.mark.parametrize("pool", [1, 3000, 1 << 20])
def test_packing_covers_every_id_once_without_padding(spark, odd, pool):
    check_packing(odd.select("doc_id", "text", "ids"), pool)
    sequences = check_packing(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1), pool)
    short = [s for s in sequences.values() if s[0]["sequence_length"] < 128]
    assert len(short) <= 7


def test_step_groups_are_even():
    windows = [[packing.Piece(0, 0, bytes(4 * n), n)] for n in [1024] * 100 + [512] * 60 + [128] * 50]
    held = defaultdict(int)
    for w, g in zip(windows, packing.steps(windows, 1 << 14), strict=True):
        held[g] += len(w[0].ids) // 4
    assert max(held.values()) - min(held.values()) <= 128


def test_nothing_to_pack(none):
    assert packing.pack(none, tokens.vocabulary(NAMES[1])).count() == 0

import random
from collections import Counter

import numpy as np
import pytest

from stemline.llm import common, repeats


def brute(texts):
    seen = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    return [repeats.union([(k, k + 400) for k in range(len(t) - 399) if seen[t[k : k + 400]] > 1]) for t in texts]


def strings(seed, alphabet):
    rng = random.Random(seed)

    def some(n):
        return bytes(rng.choices(alphabet, k=n))

    passages = [some(rng.randrange(380, 1500)) for _ in range(4)]
    out = []
    for _ in range(rng.randrange(2, 9)):
        t = b""
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            t += some(rng.randrange(300)) + p[rng.randrange(len(p) // 3) :]
            if rng.random() < 0.3:
                t += some(rng.randrange(1, 90)) * rng.randrange(3, 30)
        out.append(t)
    return out + [out[0]] * (seed % 2) + [b"", b"a" * 399, b"b" * 400]


def found(df, **options):
    out = []
    for r in repeats.remove(df, **options).collect():
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        out.append((r["row"]["doc_id"], r["n_bytes"], spans, bytes(r["kept"])))
    return sorted(out, key=lambda r: r[0])


def cut(t, spans):
    edges = [0, *[x for s in spans for x in s], len(t)]
    return b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


@pytest.mark.parametrize(("seed", "alphabet", "hot", "bits"), [(1, b"ab", repeats.HOT, 27), (2, b"abcdefgh ", 3, 20), (3, bytes(range(32, 127)), repeats.HOT, 8), (4, b"a", 2, 20)])
def test_equals_brute_force(spark, monkeypatch, seed, alphabet, hot, bits):
    monkeypatch.setattr(repeats.spans, "__defaults__", (bits, hot, False, False))
    texts = strings(seed, list(alphabet)) + strings(seed + 10, list(alphabet))
    df = spark.createDataFrame([(k, t.decode(), 1.0, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans double, kept string").repartition(3)
    assert found(df, bits=bits) == [(k, len(t), s, cut(t, s)) for k, (t, s) in enumerate(zip(texts, brute(texts), strict=True))]


def passage_texts(seed):
    rng = random.Random(seed)

    def some(n):
        return [rng.choice("ab cd efg hijkl") + str(rng.randrange(50)) for _ in range(n)]

    passages = [some(n) for n in (49, 50, 51, 80, 200)]
    out = []
    for _ in range(14):
        words = some(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            words += rng.choice(passages) + some(rng.randrange(1, 20))
        out.append("  ".join(words) if rng.random() < 0.3 else " ".join(words))
    return [*out, out[0], " ".join(["x"] * 300), "\n".join(["y", "z"] * 60) + " x" * 120, ""]


def brute_words(texts, across):
    """Spans of bytes of 50 words that come again, and of those that do in another text."""
    places = {}
    for k, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - 49):
            places.setdefault(tuple(w[i : i + 50]), []).append(k)
    out = []
    for t in texts:
        w, ends, at = t.split(), [], 0
        for x in w:
            at = t.index(x, at)
            ends.append((at, at + len(x)))
            at += len(x)
        hit = []
        for i in range(len(w) - 49):
            p = places[tuple(w[i : i + 50])]
            if len(set(p) if across else p) > 1:
                hit.append(i)
        runs = repeats.union([(i, i + 50) for i in hit])
        out.append([(ends[a][0], ends[b - 1][1]) for a, b in runs])
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_words_and_passages_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats.spans, "__defaults__", (None, hot, False, False))
    texts = passage_texts(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["row"]["doc_id"]: r for r in repeats.remove(df, words=True, passages=True).collect()}
    assert len(got) == len(texts)

    def of(k, name):
        return [(s["start"], s["end"]) for s in got[k][name]]

    assert [of(k, "spans") for k in range(len(texts))] == brute_words(texts, False)
    assert [of(k, "passages") for k in range(len(texts))] == brute_words(texts, True)
    assert any(of(k, "spans") != of(k, "passages") for k in range(len(texts)))
    plain = {r["row"]["doc_id"]: r for r in repeats.remove(df, passages=True).collect()}
    assert [[(s["start"], s["end"]) for s in plain[k]["spans"]] for k in range(len(texts))] == brute([t.encode() for t in texts])
    assert [plain[k]["passages"] for k in range(len(texts))] == [got[k]["passages"] for k in range(len(texts))]


def test_spans_cut_through_characters(spark):
    texts = ["é" * 300 + "x", "y" + "é" * 300, "ab" * 300]
    data = [t.encode() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(df) == [(k, len(t), s, cut(t, s)) for k, (t, s) in enumerate(zip(data, brute(data), strict=True))]


def test_anchors_depend_on_the_window_alone(monkeypatch):
    rng = random.Random(3)
    p = bytes(rng.choices(b"abc", k=900))
    monkeypatch.setattr(repeats, "PIECE", 100)
    a, b = repeats.anchors(b"zz" * 60 + p), repeats.anchors(p + b"q" * 500)
    one = {w - 120: int(x) - 120 for x, low, high in zip(a.place, a.low, a.high, strict=True) for w in range(low, high + 1) if w >= 120}
    two = {w: int(x) for x, low, high in zip(b.place, b.low, b.high, strict=True) for w in range(low, high + 1) if w <= 500}
    assert one == two and len(one) == 501


def test_deep_shallow_sorts_and_measures():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2, (400, 90)).astype(np.uint8)
    rows[:, :50] = rows[rng.integers(0, 5, 400), :50]
    rows[200:] = rows[rng.integers(0, 200, 200)]
    groups = rng.integers(0, 3, 400)
    order, lcp = repeats.deep_shallow(groups, rows)
    key = [(groups[k], rows[k].tobytes()) for k in order]
    assert key == sorted(key)
    for k in range(1, 400):
        (g, a), (h, b) = key[k - 1], key[k]
        assert lcp[k] == (-1 if g != h else next((i for i in range(90) if a[i] != b[i]), 90))


def test_a_text_that_repeats_itself_yields_few_contexts():
    text = b"abcdefghij" * 3000
    left, spans = repeats.settle(text, repeats.anchors(text))
    assert len(spans) == 1 and spans[0][0] < 10 and spans[0][1] == 30_000 and len(left.place) <= 3


def test_odd_rows(odd, none):
    rows = repeats.remove(odd).collect()
    assert len(rows) == odd.count() and set(rows[0]["row"].asDict()) == set(odd.columns) - {"text"}
    assert repeats.remove(none).count() == 0


def test_texts_read_together_give_what_each_gives_alone():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 31, 399, 400, 401, 900, 5000, 70_000, 600_000] * 3
    odd = [rng.integers(0, a, n).astype(np.uint8).tobytes() for n, a in zip(sizes, [1, 2, 5, 256, 256] * 6, strict=True)]
    for p, found, names in zip(odd, repeats.anchors_of(odd), common.names_of(odd), strict=True):
        alone = repeats.anchors(p)
        assert all(np.array_equal(x, y) for x, y in zip(alone, found, strict=True))
        assert (found.high[-1] == len(p) - 400 and found.low[0] == 0) if len(p) >= 400 else not len(found.place)
        assert names.tolist() == [common.word_names(w)[0] for w in p.split(None)] if len(p) < 6000 else len(names) == len(common.word_names(p))
    h = repeats._gram_hashes(np.frombuffer(odd[7], np.uint8)) & ~np.uint64(0xFFFFFF)
    a = repeats.anchors(odd[7])
    want = [w + int(h[w : w + repeats.REACH + 1].argmin()) for w in range(len(odd[7]) - 399)]
    assert np.repeat(a.place, a.high - a.low + 1).tolist() == want
    assert repeats.anchors_of([]) == common.names_of([]) == []

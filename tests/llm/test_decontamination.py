import random

import pytest

from stemline.llm import common, decontamination


def brute(text, items, n=10):
    words = common.words(text.encode() if text else None)
    hit, found = set(), set()
    for key, t in items:
        own = common.words(t.encode() if t else None)
        m = min(n, len(own))
        for k in range(len(own) - m + 1 if own else 0):
            for at in range(len(words) - m + 1):
                if words[at : at + m] == own[k : k + m]:
                    hit |= set(range(at, at + m))
                    found.add(str(key))
    return len(words), hit, sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150, 120, 25])
def test_equals_brute_force_for_any_blocks(spark, block_bytes):
    rng = random.Random(block_bytes)

    def text(n):
        return "".join(w + rng.choice([" ", ", ", "\n", "-"]) for w in rng.choices(["a", "B", "c", "é", "The"], k=n))

    items = [(k, text(rng.randrange(25))) for k in range(12)] + [(20, ""), (21, None), (22, "single"), (23, "The é"), (24, text(40))]
    docs = [(k, text(rng.randrange(60)) + (rng.choice(items)[1] or "") + text(9)) for k in range(40)] + [(50, None), (51, "x Single"), (52, "")]
    df = spark.createDataFrame([(k, t, 1.0) for k, t in docs], "doc_id long, text string, spans double").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["row"]["doc_id"]: r for r in decontamination.search(df, bench, carry=["doc_id", "spans"], block_bytes=block_bytes).collect()}
    for k, t in docs:
        n, hit, found = brute(t, items)
        r = got[k]
        assert r["n_words"] == n and r["items"] == found
        assert {x for s in r["spans"] for x in range(s["start"], s["end"])} == hit
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_tables_skip_impossible_places():
    t = decontamination.Table(10, {tuple(f"w{k}".encode() for k in range(10)): {"1"}})
    assert t.far == 9 and t.shift[b"w0", b"w1"] == 8 and t.shift[b"w8", b"w9"] == 0


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "brown fox jumps over the lazy dog under the mit license")], "item_id long, text string")
    rows = decontamination.search(odd, bench).collect()
    assert len(rows) == odd.count() and {r["row"]["doc_id"] for r in rows if r["items"]} == {1}
    assert decontamination.search(none, bench).count() == 0
    nothing = decontamination.search(odd, bench.limit(0)).collect()
    assert len(nothing) == odd.count() and not any(r["spans"] for r in nothing)

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stemline.config import Config, choose_k, parse_count, parse_size
from stemline.operators import doubling, local, runs, symbols, verify
from stemline.plans import build
from stemline.sources import sinks, texts
from stemline.sources.ranges import ByteRanges

GOLDEN = {
    b"": [0],
    b"a": [1, 0],
    b"aaaa": [4, 3, 2, 1, 0],
    b"banana": [6, 5, 3, 1, 0, 4, 2],
    b"mississippi": [11, 10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2],
    b"abracadabra": [11, 10, 7, 0, 3, 5, 8, 1, 4, 6, 9, 2],
    b"abcabcabc": [9, 6, 3, 0, 7, 4, 1, 8, 5, 2],
    b"\0\0\1\xfd\0": [5, 4, 0, 1, 2, 3],
}


def naive(s: bytes) -> list[int]:
    return sorted(range(len(s) + 1), key=lambda i: s[i:])


def random_strings(seed: int) -> list[bytes]:
    rng = random.Random(seed)
    out = [bytes(rng.randrange(a) for _ in range(rng.randrange(120))) for a in (1, 2, 3, 8, 256) for _ in range(4)]
    return [*out, b"ab" * 40, b"a" * 100, b"abaababaabaababaababa", out[-1] * 2]


def table(spark, strings):
    return spark.createDataFrame([(k, bytearray(s)) for k, s in enumerate(strings)], "sid long, b binary")


def arrays(sa):
    out = {}
    for r in sa.orderBy("sid", "rank").collect():
        out.setdefault(r["sid"], []).append(r["pos"])
    return out


def test_golden_vectors_in_tasks_and_by_doubling(spark):
    strings = list(GOLDEN)
    want = dict(enumerate(GOLDEN.values()))
    assert arrays(build.build(table(spark, strings)).sa) == want
    assert arrays(build.build(table(spark, strings), Config(local_bytes=-1)).sa) == want


@pytest.mark.parametrize(("k", "preaggregate", "piece"), [(1, False, 7), (3, True, 64), (None, False, 5)])
def test_doubling_equals_sorting_for_any_k_and_pieces(spark, k, preaggregate, piece):
    strings = random_strings(k or 9)
    t = table(spark, strings)
    got = build.from_pieces(lambda overlap: texts.pieces(t, overlap, piece), Config(k=k, preaggregate=preaggregate, chunk=1000))
    assert arrays(got.sa) == {k: naive(s) for k, s in enumerate(strings)}
    assert all(m["active_out"] < m["active_in"] for m in got.metrics[:1])


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=60).map(str.encode)))
def test_local_sort_equals_sorting(s):
    assert local.suffix_array(s).tolist() == naive(s)


def test_rounds_of_banana(spark):
    t = table(spark, [b"banana"])
    first = symbols.initial_ranks(texts.pieces(t, 0), 1)
    assert [r["rank"] for r in first.orderBy("pos").collect()] == [4, 1, 5, 1, 5, 1, 0]
    ranks = first
    for length, want in ((1, [4, 2, 5, 2, 5, 1, 0]), (2, [4, 3, 6, 2, 5, 1, 0])):
        active = ranks.where("cnt > 1").select("sid", "pos", "rank")
        new = doubling.refine(doubling.shifted(active, ranks, length))
        again = doubling.refine_counts(doubling.shifted(active, ranks, length))
        assert sorted(new.collect()) == sorted(again.collect())
        ranks = doubling.apply_ranks(ranks, new).join(new.select("sid", "pos", "cnt"), ["sid", "pos"], "left").na.fill(1)
        assert [r["rank"] for r in ranks.orderBy("pos").collect()] == want


def test_verifier_accepts_right_and_refuses_wrong(spark):
    t = table(spark, [b"mississippi", b"", b"aaaa"])
    right = build.build(t)
    codes = symbols.symbols(texts.pieces(t, 0))

    def failed(isa, sa):
        return {r["check"] for r in verify.report(codes, isa, sa).collect() if r["violations"]}

    assert failed(right.isa, right.sa) == set()
    swapped = right.isa.withColumn("rank", F.when(F.col("sid") > 0, F.col("rank")).when(F.col("rank") == 3, 4).when(F.col("rank") == 4, 3).otherwise(F.col("rank")))
    assert failed(swapped, swapped) == {"order"}
    assert "agreement" in failed(swapped, right.sa)
    twice = right.isa.withColumn("rank", F.when((F.col("sid") == 0) & (F.col("rank") == 5), 6).otherwise(F.col("rank")))
    assert "permutation" in failed(twice, twice)
    short = right.isa.where("not (sid = 2 and pos = 1)")
    assert {"length", "agreement"} <= failed(short, right.sa)
    far = right.isa.withColumn("rank", F.when((F.col("sid") == 0) & (F.col("rank") == 11), 40).otherwise(F.col("rank")))
    assert "range" in failed(far, far)


def test_strings_are_checked_where_they_are_sorted(spark):
    t = table(spark, [b"", b"banana", b"abcab" * 5, b"a" * 40, b"\xff\0" * 9])
    n = sum(len(r["b"]) + 1 for r in t.collect())

    def report(texts, result):
        return {r["check"]: (r["violations"], r["n_positions"]) for r in build.verify_build(texts, result).collect()}

    near, mixed, far = (build.build(t, Config(local_bytes=size)) for size in (1 << 20, 20, -1))
    for result in (near, mixed, far, near._replace(parts=None)):
        assert report(t, result) == dict.fromkeys(verify.CHECKS, (0, n))
    wide = table(spark, [b"x" * 70_000])
    assert report(wide, build.build(wide)) == dict.fromkeys(verify.CHECKS, (0, 70_001))
    plan = build.verify_build(t, near)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "hashpartitioning" not in plan  # only sums of what tasks found
    # tables that aren't the build's own, and numbers that come again, go through the report by positions
    swapped = near._replace(sa=near.sa.withColumn("rank", F.when(F.col("rank") < 2, 1 - F.col("rank")).otherwise(F.col("rank"))))
    assert report(t, swapped) == report(t, swapped._replace(parts=None)) and report(t, swapped)["agreement"][0]
    twice = t.unionAll(t.where("sid in (1, 4)"))
    for size in (1 << 20, 35):
        result = build.build(twice, Config(local_bytes=size))
        assert report(twice, result) == report(twice, result._replace(parts=None)) and report(twice, result)["length"][0]
    empty = t.where("sid < 0")
    assert report(empty, build.build(empty)) == dict.fromkeys(verify.CHECKS, (0, 0))


def test_one_string_is_held_to_the_same_checks(spark):
    rng = np.random.default_rng(2)
    strings, rows, want = [], [], []
    for k, s in enumerate([b"", b"aa", b"mississippi", b"abab" * 3] * 8):
        rank, pos = np.arange(len(s) + 1), local.suffix_array(s)
        if k >= 4:
            x, y = rng.integers(0, len(rank), 2)
            kind = k % 5
            if kind == 0:
                pos[[x, y]] = pos[[y, x]]
            elif kind == 1:
                pos[x] = pos[y]
            elif kind == 2:
                rank[x] += rng.integers(-3, 20)
            elif kind == 3:
                rank, pos = np.delete(rank, x), np.delete(pos, x)
            else:
                p = rng.permutation(len(rank))
                rank, pos = rank[p], pos[p]
        strings.append(s)
        rows += [(k, int(r), int(p)) for r, p in zip(rank, pos, strict=True)]
        want.append(verify.holds(s, rank, pos))
    assert True in want[4:] and False in want
    t, sa = table(spark, strings), spark.createDataFrame(rows, "sid long, rank long, pos long")
    codes = symbols.symbols(texts.pieces(t, 0))
    for k, good in enumerate(want):
        own = sa.where(F.col("sid") == k)
        if k < 4 or k % 7 == 0:
            assert good == (not any(r["violations"] for r in verify.report(codes.where(F.col("sid") == k), own.select("sid", "pos", "rank"), own).collect()))
    naive_holds = [sorted((r, p) for s, r, p in rows if s == k) == list(enumerate(naive(strings[k]))) for k in range(len(strings))]
    assert want == naive_holds


def test_bytes_over_the_limit_are_refused_only_if_asked(spark):
    t = table(spark, [b"a\xfe\xff"])
    with pytest.raises(ValueError, match="2 bytes are over 253"):
        build.build(t, Config(max_byte=253))
    assert arrays(build.build(t).sa) == {0: [3, 0, 1, 2]}


def test_no_window_over_positions_is_global(spark):
    ranks = symbols.initial_ranks(texts.pieces(table(spark, [b"banana"]), 1), 2)
    pairs = doubling.shifted(ranks.where("cnt > 1").select("sid", "pos", "rank"), ranks, 2)
    for df in (ranks, doubling.refine(pairs), doubling.refine_counts(pairs)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_byte_ranges_sinks_and_command_line(spark, tmp_path):
    from stemline import cli

    data = random.Random(1).randbytes(3000).translate(bytes(b % 5 + 97 for b in range(256))) + b"\n"
    (tmp_path / "in").write_bytes(data)
    spark.dataSource.register(ByteRanges)
    read = spark.read.format("byte_ranges").options(path=str(tmp_path / "in"), overlap=4, piece=100, task=250).load()
    assert sorted(r["pos"] for r in symbols.kmers(read, 5).collect()) == list(range(len(data) + 1))
    assert all(bytes(r["kmer"]) == data[r["pos"] : r["pos"] + 5] for r in symbols.kmers(read, 5).collect())
    assert cli.main([str(tmp_path / "in"), str(tmp_path / "out"), "1M", "--chunk-size", "1000", "--verify", "--raw"], spark) == 0
    raw = b"".join((tmp_path / "out-raw" / f"suffixarray_{k}").read_bytes() for k in range(4))
    assert np.frombuffer(raw, "<i8").tolist() == naive(data)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(data) + 1
    (tmp_path / "empty").write_bytes(b"")
    assert cli.main([str(tmp_path / "empty"), str(tmp_path / "none"), "--verify"], spark) == 0


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(2, "é", 0), (1, None, 1), (3, "x", 2)], "k long, t string, b long")
    assert {r["sid"]: bytes(r["b"]) for r in texts.from_column(df, "k", "t").collect()} == {1: b"", 2: "é".encode(), 3: b"x"}
    assert bytes(texts.joined(df, "k", "t").first()["b"]) == "é\nx".encode()
    (tmp_path / "f").write_bytes(b"abc")
    assert bytes(texts.from_files(spark, str(tmp_path / "f")).first()["b"]) == b"abc"
    nulls = texts.from_column(spark.createDataFrame([(None, "ab"), (1, "ab")], "k long, t string"), "k", "t")
    assert arrays(build.build(nulls).sa) == arrays(build.build(nulls, Config(local_bytes=-1)).sa) == {1: [2, 0, 1]}
    empty = spark.createDataFrame([], "sid long, b binary")
    assert build.build(empty).sa.count() == build.build(empty, Config(local_bytes=-1)).sa.count() == 0


def test_runs(spark):
    ranks = spark.createDataFrame([(0, k, r) for k, r in enumerate([0, 1, 1, 1, 4, 4, 6])], "sid long, pos long, rank long")
    got = {r["least"]: (r["n_runs"], r["n_positions"]) for r in runs.length_distribution(runs.rank_runs(ranks)).collect()}
    assert got == {1: (2, 2), 2: (1, 2), 3: (1, 3)}
    long = spark.createDataFrame([(0, k, c) for k, c in enumerate([4, 5, 256, 257, 1 << 16, (1 << 16) + 1, 1 << 24, (1 << 24) + 1])], "sid long, rank long, cnt long")
    assert {r["least"]: r["n_runs"] for r in runs.length_distribution(long).collect()} == {4: 1, 5: 2, 257: 2, 65537: 2, 16777217: 1}
    assert sorted(map(tuple, runs.windows(ranks.where("rank in (1, 4)"), 4).collect())) == [(0, 0, 1, 3), (0, 1, 4, 5)]
    first = spark.createDataFrame([(0, 0, 1, 2), (0, 1, 4, 1), (0, 2, 5, 1)], "sid long, run long, rank long, cnt long")
    second = spark.createDataFrame([(0, 0, 5, 2), (0, 1, 1, 2)], "sid long, run long, next long, cnt long")
    assert [tuple(r)[2:] for r in runs.joint_walk(first, second).orderBy("at").collect()] == [(1, 5, 2), (4, 1, 1), (5, 1, 1)]


def test_sizes():
    assert [parse_size(x) for x in ("8G", "512MB", "2048k", "1T", "7")] == [8 << 30, 512 << 20, 2 << 20, 1 << 40, 7]
    for bad in ("", "8X", "-1", "0", "1.5G"):
        with pytest.raises(ValueError):
            parse_size(bad)
    assert parse_count("2147483647") == 2147483647
    for bad in ("0", "2147483648", "x", "1e3"):
        with pytest.raises(ValueError):
            parse_count(bad)
    assert Config(memory=150).chunk_size == 10 and Config(chunk=10).memory_budget == 150
    assert Config().memory_budget == 15 * (1 << 24)
    assert choose_k(4, 1 << 24) == 10 and choose_k(96, 1 << 24) == 3 and choose_k(300, 10) == 1 and choose_k(0, 10) == 1

import pytest

from stemline.llm import sharding


def check(df, limit):
    rows = sharding.assign(df, limit=limit).collect()
    assert len(rows) == df.count()
    shards = {}
    for r in rows:
        shards.setdefault(r["shard_id"], []).append(r)
    for own in shards.values():
        assert sum(r["n_bytes"] for r in own) == own[0]["shard_bytes"] and len(own) == own[0]["shard_rows"]
        assert own[0]["shard_bytes"] <= limit or len(own) == 1
    prefixes = [s[1:].partition(".")[0] for s in shards]
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)  # a directory: no leaf above another
    return shards


@pytest.mark.parametrize("limit", [5_000, 60_000, 10_000_000])
def test_only_oversized_buckets_split(spark, limit):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    shards = check(df, limit)
    rows = {s: own[0] for s, own in shards.items()}
    keys = [(r["key"], r["n_bytes"]) for r in sharding.keyed(df).collect()]
    for r in rows.values():  # a shard's parent bucket was over the limit
        if r["depth"]:
            parent = [n for k, n in keys if k >> (61 - r["depth"]) == r["prefix"] >> 1]
            assert sum(parent) > limit and len(parent) > 1


def test_copies_of_a_row_are_dealt_by_ordinal(spark):
    df = spark.createDataFrame([(7, "x" * 100)] * 50 + [(k, "y" * 10) for k in range(20)], "doc_id long, text string")
    shards = check(df, 1000)
    assert sum("." in s for s in shards) == 4


def test_odd_rows(odd, none):
    check(odd, 100)
    assert sharding.assign(none).count() == 0


def test_main_path_is_native(spark):
    df = sharding.assign(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_shards_are_written_whole(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sharding.write(df, str(tmp_path / "out"), limit=100_000)
    back = spark.read.parquet(str(tmp_path / "out")).drop("shard_id")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_written_shards_keep_columns_of_any_name(spark, tmp_path):
    df = spark.createDataFrame([(k, "x" * 50, f"s{k}", k) for k in range(20)], "doc_id long, text string, shard_id string, id long")
    sharding.write(df, str(tmp_path / "out"), limit=200)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.columns) == sorted([*df.columns, "_shard_id"])
    assert sorted(tuple(r) for r in got.select(df.columns).collect()) == sorted(tuple(r) for r in df.collect())

"""Sharding by extendible hashing, with DataFrame functions only.

A row's key is 60 bits of a hash of its id and text. The directory is a binary tree over prefixes
of that key: a bucket whose bytes exceed the limit splits on one more bit, the others stay. A
bucket of one row is a shard whatever its size. Rows that are equal in id and text share all bits;
where such copies alone exceed the limit, they are dealt by their ordinal into parts.

The tree is settled STEP bits a round. Each round sums bytes for the prefixes of buckets still too
large, so the work of later rounds is only that of the oversized buckets. Neither directory nor
rows go to the driver; only the number of rows in open buckets does.

Nulls: a null id hashes as an empty string, a null text counts no bytes. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

KEY_BITS, STEP = 60, 12
LIMIT = 1 << 20


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the key: the first 60 bits of md5(id ':' md5(text))."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    return df.select(
        F.col(id_col).alias("id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
    )


def _prefix(key, bits):
    """The first `bits` bits (a column or number) of a key."""
    return F.shiftright(key, KEY_BITS - bits) if isinstance(bits, int) else F.expr(f"shiftright({key}, {KEY_BITS} - {bits})")


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, depth, prefix, part, shard_id, shard_bytes, shard_rows for each row of df. A shard
    is the rows of one (depth, prefix, part); its bytes are within limit unless it is a single row."""
    if limit < 1:
        raise ValueError("limit must be positive")
    left, done, low = common.table(keyed(df, id_col, text_col), "keys"), [], 0
    while True:
        high = min(low + STEP, KEY_BITS)
        fine = left.groupBy(_prefix(F.col("key"), high).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        fine = common.table(fine, "fine")
        levels = fine.select("fine", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(fine, {high} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
        first = F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("leaf")
        leaves = levels.select("fine", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("fine").agg(first)
        joined = left.withColumn("fine", _prefix(F.col("key"), high)).join(leaves, "fine", "left")
        done.append(joined.where("leaf is not null").select("id", "n_bytes", "key", "leaf.*", F.lit(0).cast("long").alias("part")))
        rest = joined.where("leaf is null").select("id", "n_bytes", "key")
        if rest.isEmpty():
            break
        left, low = common.table(rest, "rest"), high + 1
        if high == KEY_BITS:
            done.append(_copies(left, limit))
            break
    out = reduce(DataFrame.unionByName, done)
    bits = F.expr("if(depth = 0, '', lpad(bin(prefix), depth, '0'))")
    shard_id = F.concat(F.lit("s"), bits, F.when(F.col("part") > 0, F.concat(F.lit("."), F.col("part").cast("string"))).otherwise(""))
    return out.select("id", "n_bytes", "depth", "prefix", "part", shard_id.alias("shard_id"), "shard_bytes", "shard_rows")


def _copies(rows: DataFrame, limit: int) -> DataFrame:
    """Deals rows that agree in every bit, which are copies of one row, into parts by ordinal."""
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.max("n_bytes").over(W.partitionBy("key")))))
    rows = rows.withColumn("each", each).withColumn("part", F.floor((F.row_number().over(W.partitionBy("key").orderBy("n_bytes")) - 1) / F.col("each")))
    whole = W.partitionBy("key", "part")
    return rows.select(
        "id", "n_bytes", "key", F.lit(KEY_BITS).alias("depth"), F.col("key").alias("prefix"),
        F.sum("n_bytes").over(whole).alias("shard_bytes"), F.count(F.lit(1)).over(whole).alias("shard_rows"), F.col("part").cast("long"),
    )


def write(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Writes df's rows in a folder for each shard, by the column `shard_id` (with `_` before it as often as df has that
    name). Ids must be unique here."""
    name, key = "shard_id", "id"
    while name in df.columns:
        name = f"_{name}"
    while key in (*df.columns, name):
        key = f"_{key}"
    shards = assign(df, id_col, text_col, limit).select(F.col("id").alias(key), F.col("shard_id").alias(name))
    df.join(shards, F.col(f"`{id_col}`").eqNullSafe(F.col(key))).drop(key).repartition(F.col(name)).write.partitionBy(name).parquet(path)


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "depth", "prefix", "part", "shard_id", "shard_bytes", "shard_rows")


#: No key of the driver's tables comes twice, so parts of copies don't arise.
ORACLE = f"""
WITH k AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
n AS (
  SELECT d AS depth, key >> ({KEY_BITS} - d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM k, range(0, {KEY_BITS} + 1) r(d) GROUP BY 1, 2),
leaf AS (
  SELECT k.doc_id, k.n_bytes, k.key, min(n.depth) AS depth
  FROM k JOIN n ON n.prefix = k.key >> ({KEY_BITS} - n.depth)
  WHERE n.shard_bytes <= {LIMIT} OR n.shard_rows = 1 GROUP BY 1, 2, 3)
SELECT l.doc_id, l.n_bytes, l.depth::INTEGER AS depth, n.prefix, 0::BIGINT AS part,
       's' || CASE WHEN l.depth = 0 THEN '' ELSE right(repeat('0', 64) || bin(n.prefix), l.depth::INTEGER) END AS shard_id,
       n.shard_bytes, n.shard_rows
FROM leaf l JOIN n ON n.depth = l.depth AND n.prefix = l.key >> ({KEY_BITS} - l.depth)
"""

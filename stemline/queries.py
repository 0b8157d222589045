"""Registered queries of the suffix engine, and DuckDB SQL for their results.

All run over whole tables and whole texts. Positions and ranks count bytes; the SQL works on texts in
hexadecimal, whose order is that of the bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT_CHUNK, Config, choose_k
from .operators import doubling, runs, symbols
from .plans import build
from .sources import texts

#: Bytes of the first ranking in the queries on single rounds, of the corpus histograms, and positions of a chunk.
K, CORPUS_K, CHUNK = 2, 3, 8


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.from_column(_read(spark, sf_dir, "benchmark"), "item_id", "text")


def _documents(spark: SparkSession, sf_dir: str, overlap: int = 0) -> DataFrame:
    return texts.pieces(texts.from_column(_read(spark, sf_dir, "documents"), "doc_id", "text"), overlap)


def symbol_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbols(texts.pieces(_items(spark, sf_dir), 0))


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.byte_histogram(_documents(spark, sf_dir))


def invalid_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.check_bytes(byte_histogram(spark, sf_dir), 253)


def dense_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.dense_alphabet(byte_histogram(spark, sf_dir))


def kmer_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = byte_histogram(spark, sf_dir).count()
    return spark.createDataFrame([(sigma, sigma + 1, choose_k(sigma, DEFAULT_CHUNK))], "sigma long, base long, k long")


def kmer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.kmers(texts.pieces(_items(spark, sf_dir), K - 1), K).select("sid", "pos", F.hex("kmer").alias("kmer"))


def kmer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.kmer_histogram(_documents(spark, sf_dir, CORPUS_K - 1), CORPUS_K).select(F.hex("kmer").alias("kmer"), "cnt")


def bucket_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.bucket_starts(symbols.kmer_histogram(_documents(spark, sf_dir, CORPUS_K - 1), CORPUS_K)).select(F.hex("kmer").alias("kmer"), "cnt", "start")


def _initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.initial_ranks(texts.pieces(_items(spark, sf_dir), K - 1), K)


def initial_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _initial(spark, sf_dir).select("sid", "pos", "rank")


def initial_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rank_runs(_initial(spark, sf_dir))


def run_length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.length_distribution(initial_runs(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _initial(spark, sf_dir)
    return doubling.shifted(ranks.where("cnt > 1").select("sid", "pos", "rank"), ranks, K)


def shifted_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def rank_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.triplets(_pairs(spark, sf_dir))


def refine_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.refine(_pairs(spark, sf_dir))


def refine_once_preaggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.refine_counts(_pairs(spark, sf_dir))


def ranks_after_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.apply_ranks(initial_ranks(spark, sf_dir), refine_once(spark, sf_dir))


def resolved_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine_once(spark, sf_dir).where("cnt = 1").select("sid", "pos", "rank")


def active_after_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine_once(spark, sf_dir).where("cnt > 1").select("sid", "pos", "rank")


def active_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.windows(active_after_round(spark, sf_dir), CHUNK)


def doubling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of the benchmark's texts: active positions in and out."""
    items = _items(spark, sf_dir)
    built = build.from_pieces(lambda overlap: texts.pieces(items, overlap), Config(k=K))
    rows = [(m["length"], m["active_in"], m["active_out"]) for m in built.metrics]
    return spark.createDataFrame(rows, "length long, active_in long, active_out long")


def suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each benchmark item, sorted in tasks."""
    return build.build(_items(spark, sf_dir)).sa


def inverse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part's name, by prefix doubling."""
    names = texts.from_column(_read(spark, sf_dir, "part"), "p_partkey", "p_name")
    return build.from_pieces(lambda overlap: texts.pieces(names, overlap)).isa


def suffix_array_preaggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's name, by prefix doubling on counts of rank pairs."""
    names = texts.from_column(_read(spark, sf_dir, "customer"), "c_custkey", "c_name")
    return build.from_pieces(lambda overlap: texts.pieces(names, overlap), Config(preaggregate=True)).sa


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = texts.joined(_read(spark, sf_dir, "part"), "p_partkey", "p_name")
    return build.from_pieces(lambda overlap: texts.pieces(names, overlap)).sa


def suffix_array_single_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(spark, sf_dir).select("rank", "pos")


def rank_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the single string by bucket of 1024 ranks."""
    return _single(spark, sf_dir).groupBy(F.floor(F.col("rank") / 1024).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"))


def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the suffix arrays of all pages."""
    pages = texts.from_column(_read(spark, sf_dir, "pages"), "page_id", "html")
    return build.verify_build(pages, build.build(pages))


def suffix_array_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents: for each its number of positions and a sum over its suffix array that depends on the order."""
    sa = build.build(texts.from_column(_read(spark, sf_dir, "documents"), "doc_id", "text")).sa
    return sa.groupBy("sid").agg(F.count(F.lit(1)).alias("n_positions"), F.sum((F.col("rank") + 1) * F.col("pos") % 1_000_003).alias("order_sum"))


QUERIES = {
    f.__name__: f
    for f in (
        suffix_array, symbol_stream, byte_histogram, invalid_bytes, dense_alphabet, kmer_length, kmer_keys, kmer_histogram, bucket_starts, initial_ranks,
        initial_runs, run_length_distribution, shifted_ranks, rank_triplets, refine_once, refine_once_preaggregated, ranks_after_round, resolved_singletons,
        active_after_round, active_windows, doubling_metrics, inverse_suffix_array, suffix_array_preaggregated, suffix_array_single_string, rank_buckets,
        verify_report, suffix_array_documents,
    )
}


def _positions(table: str, sid: str, text: str) -> str:
    """p: sid, h (the text in hexadecimal), pos."""
    return f"""t AS (SELECT {sid} AS sid, hex(encode(coalesce({text}, ''))) AS h FROM {table}),
p AS (SELECT sid, h, unnest(range(0, len(h) // 2 + 1)) AS pos FROM t)"""


_ITEMS = _positions("benchmark", "item_id", "text")
_HEX = "t AS (SELECT hex(encode(coalesce(text, ''))) AS h FROM documents)"
_BYTES = f"WITH {_HEX}, p AS (SELECT unnest(regexp_extract_all(h, '..')) AS x FROM t), b AS (SELECT ('0x' || x)::INTEGER AS byte, count(*) AS cnt FROM p GROUP BY x)"
#: Each run of CORPUS_K bytes from one of CORPUS_K offsets, shorter at the end, and the empty one of the sentinel.
_KMERS = f"WITH {_HEX}, p AS (SELECT unnest(regexp_extract_all(substr(h, 2 * r + 1), '.{{1,{2 * CORPUS_K}}}')) AS kmer FROM t, range(0, {CORPUS_K}) x(r) UNION ALL SELECT '' FROM t), c AS (SELECT kmer, count(*) AS cnt FROM p GROUP BY 1)"


def _rank(length: int) -> str:
    """r: sid, pos, rank by the first `length` bytes, cnt."""
    key = f"substr(h, 2 * pos + 1, {2 * length})"
    return f"(SELECT sid, pos, rank() OVER (PARTITION BY sid ORDER BY {key}) - 1 AS rank, count(*) OVER (PARTITION BY sid, {key}) AS cnt FROM p)"


_TWO = f"WITH {_ITEMS}, r AS {_rank(K)}, q AS {_rank(2 * K)}, s AS (SELECT r.sid, r.pos, r.rank, n.rank AS next FROM r LEFT JOIN r n ON n.sid = r.sid AND n.pos = r.pos + {K} WHERE r.cnt > 1), u AS (SELECT q.* FROM q JOIN r USING (sid, pos) WHERE r.cnt > 1)"
_SA = "SELECT {sid}row_number() OVER ({part}ORDER BY substr(h, 2 * pos + 1)) - 1 AS rank, pos FROM p"
_FULL = {
    "benchmark": f"WITH {_ITEMS} " + _SA.format(sid="sid, ", part="PARTITION BY sid "),
    "part": f"WITH {_positions('part', 'p_partkey', 'p_name')} " + _SA.format(sid="sid, ", part="PARTITION BY sid "),
    "customer": f"WITH {_positions('customer', 'c_custkey', 'c_name')} " + _SA.format(sid="sid, ", part="PARTITION BY sid "),
    "single": "WITH t AS (SELECT hex(encode(string_agg(p_name, chr(10) ORDER BY p_partkey))) AS h FROM part), p AS (SELECT h, unnest(range(0, len(h) // 2 + 1)) AS pos FROM t) " + _SA.format(sid="", part=""),
}
_CASES = "WHEN cnt <= 4 THEN cnt WHEN cnt <= 256 THEN 5 WHEN cnt <= 65536 THEN 257 WHEN cnt <= 16777216 THEN 65537 ELSE 16777217"

ORACLES = {
    "symbol_stream": f"WITH {_ITEMS} SELECT sid, pos, CASE WHEN 2 * pos < len(h) THEN ('0x' || substr(h, 2 * pos + 1, 2))::INTEGER + 1 ELSE 0 END AS code FROM p",
    "byte_histogram": f"{_BYTES} SELECT * FROM b",
    "invalid_bytes": f"{_BYTES} SELECT coalesce(sum(cnt), 0)::BIGINT AS n_bytes, coalesce(sum(cnt) FILTER (byte > 253), 0)::BIGINT AS n_invalid FROM b",
    "dense_alphabet": f"{_BYTES} SELECT byte, dense_rank() OVER (ORDER BY byte)::INTEGER AS code FROM b",
    "kmer_length": f"{_BYTES}, s AS (SELECT count(*) AS sigma FROM b) SELECT sigma, sigma + 1 AS base, (SELECT max(k) FROM range(1, 25) x(k) WHERE k = 1 OR (sigma + 1.0) ** k <= {DEFAULT_CHUNK})::BIGINT AS k FROM s",
    "kmer_keys": f"WITH {_ITEMS} SELECT sid, pos, substr(h, 2 * pos + 1, {2 * K}) AS kmer FROM p",
    "kmer_histogram": f"{_KMERS} SELECT * FROM c",
    "bucket_starts": f"{_KMERS} SELECT kmer, cnt, coalesce(sum(cnt) OVER (ORDER BY kmer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c",
    "initial_ranks": f"{_TWO} SELECT sid, pos, rank FROM r",
    "initial_runs": f"{_TWO} SELECT sid, rank, count(*) AS cnt FROM r GROUP BY 1, 2",
    "run_length_distribution": f"{_TWO}, c AS (SELECT sid, rank, count(*) AS cnt FROM r GROUP BY 1, 2) SELECT (CASE {_CASES} END)::BIGINT AS least, count(*) AS n_runs, sum(cnt)::BIGINT AS n_positions FROM c GROUP BY 1",
    "shifted_ranks": f"{_TWO} SELECT sid, pos, rank, next FROM s",
    "rank_triplets": f"{_TWO} SELECT sid, rank, next, count(*) AS cnt FROM s GROUP BY 1, 2, 3",
    "refine_once": f"{_TWO} SELECT sid, pos, rank, cnt FROM u",
    "refine_once_preaggregated": f"{_TWO} SELECT sid, pos, rank, cnt FROM u",
    "ranks_after_round": f"{_TWO} SELECT sid, pos, rank FROM q",
    "resolved_singletons": f"{_TWO} SELECT sid, pos, rank FROM u WHERE cnt = 1",
    "active_after_round": f"{_TWO} SELECT sid, pos, rank FROM u WHERE cnt > 1",
    "active_windows": f"{_TWO} SELECT sid, pos // {CHUNK} AS chunk, min(pos) AS low, max(pos) AS high FROM u WHERE cnt > 1 GROUP BY 1, 2",
    "doubling_metrics": f"WITH {_ITEMS}, l AS (SELECT {K} * 2 ** i AS n FROM range(0, 20) x(i)), c AS (SELECT n, sid, substr(h, 2 * pos + 1, (2 * n)::BIGINT) AS x, count(*) AS cnt FROM p, l GROUP BY 1, 2, 3), a AS (SELECT n, coalesce(sum(cnt) FILTER (cnt > 1), 0)::BIGINT AS active FROM c GROUP BY 1) SELECT a.n::BIGINT AS length, a.active AS active_in, b.active AS active_out FROM a JOIN a b ON b.n = 2 * a.n WHERE a.active > 0",
    "suffix_array": _FULL["benchmark"],
    "inverse_suffix_array": _FULL["part"],
    "suffix_array_preaggregated": _FULL["customer"],
    "suffix_array_single_string": _FULL["single"],
    "rank_buckets": f"SELECT rank // 1024 AS bucket, count(*) AS n, min(rank) AS low, max(rank) AS high FROM ({_FULL['single']}) GROUP BY 1",
    "verify_report": "SELECT unnest(['length', 'range', 'permutation', 'agreement', 'order']) AS \"check\", 0::BIGINT AS violations, (SELECT sum(octet_length(encode(coalesce(html, ''))) + 1)::BIGINT FROM pages) AS n_positions",
}

"""Benchmark decontamination: Wu-Manber search of a benchmark's word windows in whole documents.

Windows are N consecutive words of an item; an item of fewer words is one window. Windows of one
length share a table: it shifts by how far the block of BLOCK words at the window's end is from the
end of any pattern, so impossible places are skipped; a block that ends a pattern opens its bucket,
and the bucket's patterns are compared word by word. A text's words that lie in any occurrence are
hit.

The benchmark comes to the driver in blocks of at most BLOCK_BYTES of text (a longer item is a block of its own,
cut into overlapping parts), and each block is broadcast for one pass over the documents; between passes what was found is a table in the
shared folder. So a benchmark of any size is searched whole, within bounded memory.

A null text has no words, and so no hits; a null item has no windows. Items with equal texts count
each, repeated item ids once. Columns of the input travel in a struct, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

N, BLOCK, BLOCK_BYTES = 10, 2, 1 << 20


class Table:
    """Wu-Manber tables of the patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple, set]) -> None:
        self.m, self.b = length, min(BLOCK, length)
        self.far = self.m - self.b + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set]] = {}
        for p, items in patterns.items():
            for end in range(self.b, self.m + 1):
                block = p[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.far), self.m - end)
            self.buckets.setdefault(p[self.m - self.b :], {})[p] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """Start and items of each occurrence."""
        m, n, at, far, shift = self.m, len(words), self.m, self.far, self.shift
        if self.b == 1:
            while at <= n:
                s = shift.get((words[at - 1],), far)
                if s:
                    at += s
                else:
                    yield from self._compare(words, at)
                    at += 1
            return
        while at <= n:
            s = shift.get((words[at - 2], words[at - 1]), far)
            if s:
                at += s
            else:
                yield from self._compare(words, at)
                at += 1

    def _compare(self, words: list[bytes], end: int) -> Iterator[tuple[int, set]]:
        window = tuple(words[end - self.m : end])
        if items := self.buckets[window[self.m - self.b :]].get(window):  # the dictionary compares word by word
            yield end - self.m, items


class Searcher:
    def __init__(self, items: list[tuple[str, bytes]], n: int) -> None:
        by_length: dict[int, dict[tuple, set]] = {}
        for key, text in items:
            words = common.words(text)
            size = min(n, len(words))
            for k in range(len(words) - size + 1 if words else 0):
                by_length.setdefault(size, {}).setdefault(tuple(words[k : k + size]), set()).add(key)
        self.tables = [Table(m, p) for m, p in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        spans, items = [], set()
        for t in self.tables:
            for start, found in t.search(words):
                spans.append((start, start + t.m))
                items |= found
        return spans, items


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, n: int, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of about limit bytes."""
    held, size = [], 0
    for key, text in benchmark.select(F.col(id_col).cast("string"), common.as_bytes(text_col)).toLocalIterator():
        for part in _parts(bytes(text or b""), n, limit):
            if held and size + len(part) > limit:
                yield held
                held, size = [], 0
            held.append((key if key is not None else "", part))
            size += len(part)
    if held:
        yield held


def _parts(text: bytes, n: int, limit: int) -> Iterator[bytes]:
    """The text, or if it is longer than limit its words in parts that overlap by n - 1 words."""
    if len(text) <= limit:
        yield text
        return
    words = common.words(text)
    at = 0
    while at == 0 or at + n <= len(words):
        end, size = at, 0
        while end < len(words) and (size <= limit or end < at + n):
            size += len(words[end]) + 1
            end += 1
        yield b" ".join(words[at:end])
        at = max(at + 1, end - n + 1)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def search(df: DataFrame, benchmark: DataFrame, text_col: str = "text", carry: list[str] | None = None, item_col: str = "item_id", item_text_col: str = "text", n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`row` with the columns of carry (None: all), n_words, `spans` (maximal runs of hit words, [start, end)) and
    `items` (sorted ids, as strings, of the items found)."""
    spark = df.sparkSession
    carry = df.columns if carry is None else carry
    state = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), common.as_bytes(f"`{text_col}`").alias("payload"), F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in state.schema])
    todo = blocks(benchmark, item_col, item_text_col, n, block_bytes)
    block = next(todo, [])
    while True:
        following = next(todo, None)
        state = _pass(state, schema, common.share(spark, block), n, following is not None)
        if following is None:
            return state.select("row", "n_words", "spans", "items")
        state, block = common.table(state, "pass"), following


def _pass(state: DataFrame, schema: T.StructType, shared, n: int, more: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value, n)
        for b in batches:
            counts, spans, items = [], [], []
            for payload, had, names in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                words = common.words(payload)
                new, found = searcher.search(words)
                counts.append(len(words))
                spans.append([{"start": x, "end": y} for x, y in union(new + [(h["start"], h["end"]) for h in had])])
                items.append(sorted(found.union(names)))
            payloads = b.column(1) if more else pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), payloads, pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["row", "payload", "n_words", "spans", "items"])

    return common.map_batches(state, run, schema)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    return found.select(
        "row.doc_id", "n_words", F.expr("aggregate(spans, 0L, (x, s) -> x + s.end - s.start)").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT item, w, least({N}, len(w)) AS m FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item, m, array_to_string(w[k:k + m - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM g)),
lengths AS (SELECT DISTINCT m FROM p),
o AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS x FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, lengths)),
hits AS (SELECT doc_id, k, m, item FROM o JOIN p USING (m, x)),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS place FROM (SELECT DISTINCT doc_id, k, m FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

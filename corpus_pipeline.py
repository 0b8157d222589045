"""The corpus pipeline: documents to packed training sequences.

Each stage works on all rows that its predecessor kept, written as Parquet and read again. All but the
last return the columns of documents.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.llm import common, decontamination, language, near, packing, repeats, tokens

#: Texts whose language is less certain than this are rejected.
LEAST_SCORE = 0.5
#: Near copies: words of a shingle, and the least Jaccard similarity of their sets of shingles.
SHINGLE, SIMILAR = 5, Fraction(4, 5)
#: A worker's dictionaries of ids, smaller than the packing operator's own: the other stages have used memory before.
PARTS, SEGMENTS = 100_000, 200_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach. Texts without a letter go, and so do those with a score
    under LEAST_SCORE. Where no document is labelled, only texts without a letter go."""
    model = language.fit(docs)
    found = language.predict(docs, model)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component that near copies of a similarity of SIMILAR or more link."""
    common.rest()
    return near.keep_one(docs, size=SHINGLE, least=SIMILAR)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that come again anywhere. n_chars follows the text. Documents of which
    only white space is left, having lost the rest, go."""
    common.rest()
    found = repeats.remove(docs, words=True)
    cut, text = F.size("spans") > 0, F.col("kept").cast("string")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.where(~cut | text.rlike(r"\S")).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    common.rest()
    found = decontamination.search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("spans") == 0).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    common.rest()
    pieces = packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), carry=["doc_id"], parts=PARTS, segments=SEGMENTS)
    return pieces.select("row.doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_id")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: SimHash, suffix sorting and tokenizers aren't SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents."""
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.table(docs, name)
    return docs

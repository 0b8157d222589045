"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the n-grams of 1 to ORDERS code points of the lower-cased text, hashed to 2 ** BITS
places. Fitting counts them per label in the tasks and sums the counts by label and place; the log
probabilities, labels x 2 ** BITS floats, are broadcast, and MAX_LABELS bounds them. Prediction
scores batches of texts as sparse rows: the places of a batch, gathered from the matrix and summed
by text. It covers whole texts, long ones in pieces that overlap by ORDERS - 1.

Fitting may use a bounded sample: about max_rows rows, those with the smallest hashes of their id,
of the rows that have a label. Nothing else is sampled.

A text that is null or has no letter (of Unicode category L) is `und` with score 0, and so is every text if there is no
labelled row. Rows without a label aren't learned from. Ties go to the first label in order.
Columns of the input travel in a struct, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDERS, BITS, ALPHA, MAX_ROWS, MAX_LABELS = 3, 16, 0.1, 20_000, 1000
#: Evidence counts as that of so many n-grams at most, for the score: neighbouring n-grams aren't independent.
EVIDENCE = 48
UNKNOWN = "und"
PIECE = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def places(codes: np.ndarray, fresh: int) -> np.ndarray:
    """The hashed places of the n-grams of code points; of those that end in the first `fresh` ones nothing is returned."""
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(ORDERS):
        # h at k: the hash of codes[k - n .. k]; an n-gram's order is part of its hash
        h = (np.concatenate([np.zeros(1, np.uint32), h[:-1]]) if n else h) * _MULTIPLIERS[1] + (codes + np.uint32(n + 1)) * _MULTIPLIERS[0]
        mixed = (h ^ (h >> np.uint32(15))) * _MULTIPLIERS[2]
        out.append((mixed >> np.uint32(32 - BITS))[max(n, fresh) :])
    return np.concatenate(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(payload: bytes | None) -> Iterator[np.ndarray]:
    """The places of a whole text in pieces; none if it has no letter."""
    text = payload.decode("utf-8", "replace") if payload else ""
    if not _LETTER.search(text):
        return
    codes = _codes(text)
    for k in range(0, len(codes), PIECE):
        back = min(k, ORDERS - 1)
        yield places(codes[k - back : k + PIECE], back)


class Model(NamedTuple):
    labels: list[str]
    matrix: np.ndarray  # places x labels, log probabilities
    prior: np.ndarray


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", max_rows: int | None = MAX_ROWS) -> Model:
    """Learns from df's rows that have a label: all of them if max_rows is None, else about max_rows."""
    rows = df.where(F.col(label_col).isNotNull())
    if max_rows is not None and (n := rows.count()) > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    rows = rows.select(F.col(label_col).cast("string").alias("label"), common.as_bytes(text_col).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            for label, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs[label] = docs.get(label, 0) + 1
                own = counts.setdefault(label, np.zeros(1 << BITS, np.int64))
                for p in pieces(payload):
                    own += np.bincount(p, minlength=1 << BITS)
        for label, own in counts.items():
            at = np.flatnonzero(own)
            place = np.append(at, -1).astype(np.int32)  # -1: rows of the label
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(place)), pa.array(place), pa.array(np.append(own[at], docs[label]))], ["label", "place", "n"])

    sums = common.map_batches(rows, run, "label string, place int, n long").groupBy("label", "place").agg(F.sum("n").alias("n"))
    sums = common.table(sums, "counts")
    labels = [r[0] for r in sums.where("place = -1").select("label").orderBy("label").limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"over {MAX_LABELS} labels: the model would have no bound")
    counts, prior = np.zeros((1 << BITS, len(labels))), np.zeros(len(labels))
    at = {x: k for k, x in enumerate(labels)}
    for label, place, n in sums.collect():  # labels x 2 ** BITS at most
        if place < 0:
            prior[at[label]] = n
        else:
            counts[place, at[label]] = n
    matrix = np.log((counts + ALPHA) / (counts.sum(axis=0) + ALPHA * (1 << BITS)))
    return Model(labels, matrix.astype(np.float32), np.log(prior / max(1, prior.sum())) if labels else prior)


def score(model: Model, payloads: list[bytes | None]) -> tuple[list[str], list[float]]:
    """Label and score of each text."""
    k, n = len(model.labels), len(payloads)
    sums, counts = np.zeros((n, k)), np.zeros(n)
    held: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        if held:
            starts = np.cumsum([0, *map(len, held[:-1])])
            part = np.add.reduceat(model.matrix[np.concatenate(held)], starts, axis=0, dtype=np.float64)
            for own, values in zip(owner, part, strict=True):  # pieces of a text in their order
                sums[own] += values
            held.clear()
            owner.clear()

    size = 0
    if k:
        for d, payload in enumerate(payloads):
            for p in pieces(payload):
                held.append(p)
                owner.append(d)
                counts[d] += len(p)
                size += len(p)
                if size > PIECE * ORDERS:
                    flush()
                    size = 0
        flush()
    labels, scores = [], []
    for d in range(n):
        if not counts[d]:
            labels.append(UNKNOWN)
            scores.append(0.0)
            continue
        best = int(np.argmax(sums[d] + model.prior))
        x = sums[d] * min(1.0, EVIDENCE / counts[d]) + model.prior
        labels.append(model.labels[best])
        scores.append(float(1 / np.exp(x - x[best]).sum()))
    return labels, scores


def predict(df: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row` with the columns of carry (None: all), `lang_pred` and `score` (0 to 1)."""
    shared = common.share(df.sparkSession, model)
    out = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64())]
    return common.map_texts(df, text_col, df.columns if carry is None else carry, lambda: lambda texts: score(shared.value, texts), out)


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text, mod 5, is 0. A null id counts as an empty text, so it is kept too."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    found = predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, carry=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")

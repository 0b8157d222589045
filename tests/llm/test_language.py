import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from stemline.llm import language


def test_held_out_accuracy_on_whole_tables(spark):
    out = language.op7_language_id(spark, "/root/testdata/sf0.01")
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held) > 100


def test_numbers_and_signs_are_no_letters():
    assert all(not list(language.pieces(x.encode())) for x in ("½ ²", "Ⅷ", "_ 12", "①", "")) and list(language.pieces("½ é".encode()))


def test_places_don_t_depend_on_pieces(monkeypatch):
    text = ("Ein Haus, été! " * 40).encode()
    whole = np.bincount(np.concatenate(list(language.pieces(text))), minlength=1 << language.BITS)
    for piece in (1, 2, 3, 50):
        monkeypatch.setattr(language, "PIECE", piece)
        assert (np.bincount(np.concatenate(list(language.pieces(text))), minlength=1 << language.BITS) == whole).all()


def test_scores_equal_brute_force_and_don_t_depend_on_the_batch(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(w, k=rng.randrange(1, 30))), lang) for k, (lang, w) in enumerate([("aa", ["foo", "bar"]), ("bb", ["bar", "baz"]), ("cc", ["qux", "été"])] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.labels == ["aa", "bb", "cc"]
    texts = [t.encode() for _, t, _ in rows]
    labels, scores = language.score(model, texts)
    for k, t in enumerate(texts):
        assert language.score(model, [t]) == ([labels[k]], [scores[k]])
        sums = model.prior + sum(model.matrix[p].astype(float) for piece in language.pieces(t) for p in piece)
        assert labels[k] == model.labels[int(np.argmax(sums))]
    counts = np.zeros(1 << language.BITS)
    for (_, _, lang), t in zip(rows, texts, strict=True):
        if lang == "aa":
            for piece in language.pieces(t):
                counts += np.bincount(piece, minlength=1 << language.BITS)
    want = np.log((counts + language.ALPHA) / (counts.sum() + language.ALPHA * (1 << language.BITS)))
    assert np.allclose(model.matrix[:, 0], want, atol=1e-5) and np.allclose(np.exp(model.prior), 1 / 3)


def test_a_sample_is_bounded(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit("en").alias("lang"))
    model = language.fit(df, max_rows=100)
    assert model.labels == ["en"]


def test_odd_rows(odd, none):
    model = language.fit(odd)
    found = {(r["row"]["doc_id"], r["row"]["text"] is None): r for r in language.predict(odd, model).collect()}
    assert found[2, False]["lang_pred"] == found[3, True]["lang_pred"] == found[6, False]["lang_pred"] == "und"
    assert found[None, False]["lang_pred"] == "de" and found[4, False]["score"] > 0.5
    assert language.predict(none, model).count() == 0
    blank = language.fit(none)
    assert not blank.labels and {r["lang_pred"] for r in language.predict(odd, blank).collect()} == {"und"}

import zlib

import numpy as np
from tests.oracle import SF_DIR

from sourcelens.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = langid.op9_langid(spark, SF_DIR).collect()
    assert len(got) == len(truth)
    right = total = far = 0
    for r in got:
        lang, text = truth[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und"
        elif r.held_out and lang is not None:
            total, right, far = total + 1, right + (r.lang_pred == lang), far + r.rejected
    assert total > 200 and right >= 0.97 * total and far <= 0.05 * total, (right, total, far)


def test_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    a, b = langid.fit(docs), langid.fit(docs.repartition(5))
    assert a.langs == b.langs and np.allclose(a.centroids, b.centroids)


ROWS = [(1, "the cat and the dog", "en"), (2, None, "en"), (None, "", None), (3, "12 !?", "fr"), (4, "le chat et le chien", "fr"), (4, "le chat et le chien", "fr"), (5, "der Hund", None), (6, "日本語", "ja")]


def test_small_rows(spark):
    docs = spark.createDataFrame([(*r, "x", 2.0) for r in ROWS], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(docs).collect()
    assert len(got) == len(ROWS)
    assert all((r.lang_pred == "und") == (r.doc_id in (2, None, 3)) for r in got)
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


def test_blocks_do_not_matter(monkeypatch):
    text = "Été à la plage, 42 fois... encore une fois! " * 50
    want = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK_CHARS", 37)
    assert np.array_equal(langid.counts(text), want)


def test_rejection(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "日本語のテキストです。" * 20)], "doc_id long, text string")
    r = langid.predict(odd, model, ["doc_id"], reject_as="other").first()
    assert r.rejected and r.lang_pred == "other"


def test_every_language_is_learned(spark):
    """More languages than fit in a few hundred, one of them a single text repeated many times; equal samples in every run."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(300):
        a, b, c = alphabet[k % 26], alphabet[k // 26], alphabet[(7 * k + 3) % 26]
        rows += [(len(rows) + i, f"{a}{b}{c} {b}{a}{a} {c}{c}{b} " * (5 + i), f"l{k:03d}") for i in range(2)]
    rows += [(10_000 + i, "zq zq xx " * 9, "one") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 301 and "one" in model.langs
    again = langid.fit(docs.repartition(7))
    assert (again.centroids == model.centroids).all() and (again.of == model.of).all()


def test_nearest_centroid_brute_force(spark):
    """Predictions and scores of the query are those of a plain search over all centroids."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(docs.doc_id)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.op9_langid(spark, SF_DIR).collect():
        c = langid.counts(texts[r.doc_id])
        if c is None:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        v = np.log1p(c) * model.idf.astype(float)
        cosine = [float(v @ m) / np.linalg.norm(v) / np.linalg.norm(m) for m in model.centroids.astype(float)]
        assert abs(max(cosine) - r.score) < 1e-5
        assert max(x for x, k in zip(cosine, model.of) if model.langs[k] == r.lang_pred) >= max(cosine) - 1e-5

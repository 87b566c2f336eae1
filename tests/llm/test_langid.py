import zlib

import numpy as np
from pyspark.sql import functions as F

from profuse.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op3_language(spark, SF).collect()
    lang = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_spectrum_is_the_set_of_ngrams(monkeypatch):
    text = "Ab, ab!! 12 çd " * 9

    def brute(text):
        import re
        flat = " " + re.sub(r"[^a-zç]+", " ", text.lower()).strip() + " "
        return {flat[i:i + n] for n in langid.LENGTHS for i in range(len(flat) - n + 1)}

    whole = langid.spectrum(text)
    assert len(whole) == len(brute(text))
    monkeypatch.setattr(langid, "PIECE", 5)
    assert (langid.spectrum(text) == whole).all()


def test_solution_is_kernel_ridge_regression():
    texts = [("x", "abc abd abe"), ("y", "xyz xyw xyv"), ("x", "abc abf"), ("y", "xyz uvw")]
    found = [(lang, langid.spectrum(t)) for lang, t in texts]
    model = langid.solve(found, 4)
    kernel = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for _, a in found] for _, b in found])
    y = np.array([[lang == "x", lang == "y"] for lang, _ in found], dtype=float)
    order = [0, 1, 2, 3]
    alpha = np.linalg.solve(kernel.T @ kernel + 1e-3 * 4 * kernel + 4e-8 * np.eye(4), kernel.T @ y)
    langs, scores = model.predict([t for _, t in texts])
    assert langs == [lang for lang, _ in texts]
    assert np.allclose(scores, np.clip((kernel[:, order] @ alpha).max(1), 0, 1), atol=1e-4)


def test_odd_rows(odd, empty):
    model = langid.learn(odd.select("doc_id", "text", "lang"))
    got = {(r[0], r[1]): r for r in langid.predict(odd, model, F.col("doc_id"), F.col("text")).collect()}
    assert len(got) == odd.select("doc_id", "text").distinct().count()
    for (_, text), r in got.items():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    nothing = langid.learn(empty.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing, F.col("doc_id")).collect()} == {"und"}
    assert langid.predict(empty, model, F.col("doc_id")).count() == 0


def test_rows_that_share_a_key_or_text_stay_few(spark):
    """Repeated keys are no way around the bound, and copies of a text teach once."""
    from profuse.llm import langid

    rows = [(1 if k % 2 else None, f"text number {k} of {k % 97} words", "ab"[k % 2]) for k in range(4000)] + [(7, "the same text", "a")] * 3000
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    solve = langid.solve
    try:
        langid.solve = lambda found, landmarks: seen.append(found) or solve(found, landmarks)
        langid.learn(frame, per_language=50)
    finally:
        langid.solve = solve
    assert {lang for lang, _ in seen[0]} == {"a", "b"} and 60 <= len(seen[0]) <= 100

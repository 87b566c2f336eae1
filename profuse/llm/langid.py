"""Language identification with a string kernel, Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the number of character n-grams (a blended spectrum
of lengths 1 to 4) that both hold, over the root of the product of their counts.
N-grams are hashed to 2^18 places.  One ridge regression per language is solved
over the kernel values with landmark texts.  Scores of a batch of texts are one
matrix product: presence matrix (texts x n-grams) times landmark presences,
scaled, times the solution; the last two factors are multiplied once.

Learning takes at most ``per_language`` texts of each language, chosen by hash,
and ``landmarks`` of them as landmarks.  Prediction reads whole texts only.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS = 18
LENGTHS = (1, 2, 3, 4)
PIECE = 1 << 20
BATCH = 64
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _mark(text: str, seen: np.ndarray) -> bool:
    """Set the places of the text's n-grams in ``seen``; False if it has no letter.

    Letters are lower-cased and every run of other characters reads as one
    space.  Long texts go piece by piece, with the overlap that n-grams need.
    """
    letters, any_letter, tail = _letters(), False, np.array([32], dtype=np.uint64)
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = letters[code]
        any_letter |= bool(letter.any())
        code = np.where(letter, code, 32)
        code = np.concatenate([tail, code[letter | np.concatenate(([True], letter[:-1]))].astype(np.uint64)])
        if len(tail) and tail[-1] == 32 and len(code) > len(tail) and code[len(tail)] == 32:
            code = np.delete(code, len(tail))
        if at + PIECE >= len(text) and code[-1] != 32:
            code = np.concatenate([code, np.array([32], dtype=np.uint64)])
        rolled = np.zeros(len(code), dtype=np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            if len(code) < n:
                break
            rolled = rolled[:len(code) - n + 1] * np.uint64(1_000_003) + code[n - 1:] + np.uint64(n)
            if n in LENGTHS:
                seen[(rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)] = 1
        tail = code[-(max(LENGTHS) - 1):]
    return any_letter


def spectrum(text: str) -> np.ndarray:
    """Places of the text's n-grams, ascending."""
    seen = np.zeros(1 << BITS, dtype=np.uint8)
    _mark(text, seen)
    return np.flatnonzero(seen).astype(np.int32)


class Model:
    """Weights per n-gram place and language, folded from landmarks and the ridge solution."""

    def __init__(self, languages: list, places: np.ndarray, weights: np.ndarray) -> None:
        self.languages, self.places, self.weights = languages, places, weights

    def predict(self, texts: list) -> tuple[list, np.ndarray]:
        seen = np.zeros(1 << BITS, dtype=np.uint8)
        present = np.zeros((len(texts), len(self.places)), dtype=np.float32)
        size, known = np.ones(len(texts)), np.zeros(len(texts), dtype=bool)
        for k, text in enumerate(texts):
            if text:
                seen[:] = 0
                known[k] = _mark(text, seen)
                size[k] = max(1, np.count_nonzero(seen))
                present[k] = seen[self.places]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        scores = (present @ self.weights) / np.sqrt(size)[:, None]
        best = scores.argmax(axis=1)
        top = np.clip(scores[np.arange(len(texts)), best], 0, 1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, top, 0.0)


def solve(found: list[tuple[str, np.ndarray]], landmarks: int, ridge: float = 1e-3) -> Model:
    """Kernel ridge regression on the kernel values with landmarks.

    ``found`` holds (language, places) in a fixed order; landmarks are its first
    rows of each language in turn.
    """
    languages = sorted({lang for lang, _ in found})
    if not languages:
        return Model([], np.zeros(0, dtype=np.int32), np.zeros((0, 0), dtype=np.float32))
    turn, order = dict.fromkeys(languages, 0), []
    for k, (lang, _) in enumerate(found):
        order.append((turn[lang], lang, k))
        turn[lang] += 1
    marks = [found[k][1] for _, _, k in sorted(order)[:landmarks]]
    places = np.unique(np.concatenate(marks))
    if not len(places):
        return Model(languages, np.zeros(0, dtype=np.int32), np.zeros((0, len(languages)), dtype=np.float32))
    index = np.full(1 << BITS, -1, dtype=np.int64)
    index[places] = np.arange(len(places))

    def rows(some):
        out = np.zeros((len(some), len(places)), dtype=np.float32)
        for k, x in enumerate(some):
            at = index[x]
            out[k, at[at >= 0]] = 1 / np.sqrt(max(1, len(x)))
        return out

    base = rows(marks)
    k_nm = np.concatenate([rows([x for _, x in found[k:k + BATCH]]) @ base.T for k in range(0, len(found), BATCH)]).astype(np.float64)
    k_mm = (base @ base.T).astype(np.float64)
    y = np.array([[float(lang == other) for other in languages] for lang, _ in found])
    left = k_nm.T @ k_nm + ridge * len(found) * k_mm + 1e-8 * len(found) * np.eye(len(marks))
    return Model(languages, places, (base.T @ np.linalg.solve(left, k_nm.T @ y)).astype(np.float32))


def _spectra(batches):
    for batch in batches:
        places = [spectrum(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rank"), batch.column("lang"), pa.array([p.tobytes() for p in places], pa.binary())],
            names=["rank", "lang", "places"])


def learn(labelled: DataFrame, per_language: int = 256, landmarks: int = 160, max_languages: int = 400) -> Model:
    """Fit on (text, lang) rows; null or empty texts and null languages teach nothing.

    The sample of a language is its distinct texts of least hash, whatever their
    keys, so copies and repeated keys are one text and the rows collected stay
    near ``per_language``; a text with several labels may teach each.  Other
    columns are not read.  An empty table gives a model that predicts ``und``.
    More than ``max_languages`` different labels are refused.
    """
    rows = labelled.select("text", "lang").where("lang is not null and text is not null and text <> ''").withColumn(
        "rank", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("rank", 0.02).alias("count")).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return solve([], landmarks)
    # A few more than wanted pass the hash bound; the surplus is cut in hash order.
    bound = F.lit(None).cast("long")
    for r in counts:
        bound = F.when(F.col("lang") == r["lang"], F.lit(min(1 << 40, int((1 << 40) * 1.3 * per_language / r["count"]) + 1))).otherwise(bound)
    picked = rows.where(F.col("rank") < bound).groupBy("rank", "lang").agg(F.min("text").alias("text")).mapInArrow(
        _spectra, "rank long, lang string, places binary").collect()
    taken: dict = {}
    for r in sorted(picked, key=lambda r: (r["rank"], r["lang"], bytes(r["places"]))):
        if len(mine := taken.setdefault(r["lang"], [])) < per_language:
            mine.append((r["rank"], r["lang"], np.frombuffer(bytes(r["places"]), dtype=np.int32)))
    found = sorted((x for mine in taken.values() for x in mine), key=lambda x: (x[0], x[1]))
    return solve([(lang, places) for _, lang, places in found], landmarks)


def predict(docs: DataFrame, model: Model, *keys: Column, text: str = "text") -> DataFrame:
    """The key columns, ``lang_pred`` and ``score`` of every row.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned.
    Ties between languages go to the first in code point order.  Repeated rows
    each get a row, other columns are not read, an empty table gives an empty result.
    """
    rows = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["lang_pred string", "score double"])

    def score(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                langs, scores = model.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[*part.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(score, schema)

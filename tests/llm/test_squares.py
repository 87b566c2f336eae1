import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from profuse.llm import queries, squares

from .conftest import LONG, SF


def brute_runs(words, min_length=24, exponent=3):
    """Every stretch of equal words at every distance; a longer period with the same ends is a multiple."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute_collapse(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("min_length,exponent", [(24, 3), (2, 2), (6, 2), (30, 2), (9, 3), (40, 4)])
def test_runs_in_any_stretches(min_length, exponent):
    rng, some = random.Random(min_length), 0
    for _ in range(60):
        n = rng.randrange(0, 200)
        words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
        for _ in range(rng.randrange(4) if n > 10 else 0):
            s, q = rng.randrange(n - 5), rng.randrange(1, 40)
            for i in range(s + q, min(n, s + rng.randrange(1, n))):
                words[i] = words[i - q]
        want, ids = brute_runs(words, min_length, exponent), np.array(words, dtype=np.int64)
        some += bool(want)
        for stretch in (1, rng.randrange(2, 60), 1 << 16):
            assert list(map(tuple, squares.runs_of(ids, min_length, exponent, stretch).tolist())) == want
    assert some > 10


def test_appending_word_by_word_catches_the_same_squares():
    words = np.array([k % 5 for k in range(60)] + list(range(10, 50)) + [k % 17 for k in range(90)], dtype=np.int64)

    def caught(step):
        catchers = squares.Catchers()
        return sorted((a, q) for k in range(0, len(words), step) for _, s, p in catchers.append(words[k:k + step]) for a, q in zip(s.tolist(), p.tolist()))

    assert caught(1) == caught(7) == caught(1000)


def test_hashes_only_filter(monkeypatch):
    """With a hash that lets everything collide the runs are the same."""
    monkeypatch.setattr(squares, "scatter", lambda x: x * np.uint64(0))
    monkeypatch.setattr(squares, "_pair", lambda a, b: a * np.uint64(0))
    words = [k % 3 for k in range(40)] + list(range(100, 130)) + [k % 9 for k in range(31)]
    assert list(map(tuple, squares.runs_of(np.array(words), 24, 3).tolist())) == brute_runs(words)


def test_long_periodic_texts_are_quick():
    for words in (np.zeros(300_000, dtype=np.int64), np.arange(300_000) % 1000, np.array([bin(k).count("1") & 1 for k in range(1 << 17)])):
        found = squares.runs_of(words)
        assert len(found) <= 1


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows)
    planted = 0
    for r in rows:
        w, h = split(r["text"]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], planted + 1
        runs, mine = brute_runs(w) if n < 3000 else None, got[r["doc_id"]]
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (mine["n_runs"], mine["start"], mine["length"], mine["period"]) == (len(runs), *best)
        assert mine["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert mine["runs_sha256"] == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert mine["collapsed_sha256"] == sha(brute_collapse(w, runs))
    assert planted > 5 and any(r["n_runs"] for r in got.values())


def test_odd_rows(spark, odd, empty):
    got = squares.find_runs(odd, "doc_id", "position").collect()
    assert len(got) == odd.count() and squares.find_runs(empty, "doc_id").count() == 0
    for r, x in zip(sorted(odd.collect(), key=str), sorted(got, key=str)):
        assert r is not None and x["position"] == "clash"
    by_text = {r["collapsed"] for r in got}
    assert "" in by_text and "déjà vu été" in by_text
    # A long text of one word is one run; what follows it stays.
    assert "Wordy a@b.co " + "x" * 50_000 + " 10.0.0.1" in by_text and LONG.startswith("Wordy Wordy")

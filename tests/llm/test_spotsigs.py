import hashlib
import random
import re

import numpy as np

from profuse.llm import components, queries, spotsigs

from .conftest import SF


def brute_set(text):
    words = re.findall(r"\w+", text.lower())
    of = lambda i, content: (words[i], *[words[j] for j in content if j > i][:3])
    content = [k for k, w in enumerate(words) if w not in spotsigs.ANCHORS]
    found = {of(i, content) for i, w in enumerate(words) if w in spotsigs.ANCHORS}
    found = {x for x in found if len(x) > 1}
    if not found and words:
        found = {of(i, range(len(words))) for i in range(len(words) - 1)} or {(words[0],)}
    return found


def brute_likeness(a, b):
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, (r[0] for r in rows)))
    mine = {r["doc_id"]: r for r in got}
    for k, (key, text) in enumerate(order):
        text, after, r = text or "", order[(k + 1) % len(order)][1] or "", mine[key]
        n = len(text)
        new = text[:n - n // 2] + after[:n // 2]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        sets = [brute_set(t) for t in (text, new, after)]
        assert len(r["fingerprint"]) == 16 * len(sets[0]) and len(r["edited_fingerprint"]) == 16 * len(sets[1])
        assert r["near_edited"] == brute_likeness(sets[0], sets[1]) and r["near_next"] == brute_likeness(sets[0], sets[2])
    return mine


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    mine = check(rows, queries.op12_spotsigs(spark, SF).collect())
    by_text = {}
    for key, text in rows:
        assert by_text.setdefault(text, mine[key]["fingerprint"]) == mine[key]["fingerprint"]
    long = [mine[k] for k, t in rows if len(t) > 800]
    assert np.mean([r["near_edited"] for r in long]) > 0.25 and np.mean([r["near_next"] for r in long]) < 0.1


def test_order_does_not_depend_on_the_partitions(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["", None, "one", "日本語", "the", "the cat", "of the and"] + [" ".join(rng.choices(["the", "of", "a", "dog", "tree", "sun", "le", "und"], k=rng.randrange(60))) for _ in range(90)]
    rows = [(k * 3 - 50, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    for parts in (1, 7):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        for together in (1 << 19, 40):
            monkeypatch.setattr(spotsigs, "TOGETHER", together)
            check(rows, spotsigs.compare_next(frame).collect())
    check(rows[:1], spotsigs.compare_next(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect())


def test_equal_rows_and_null_keys(spark, odd, empty):
    """A hot key or copy is cut into several stretches, yet each row follows its like and the last one the next key."""
    rows = [(5, "the same long text of many words")] * 500 + [(None, "a null key of the table")] * 200 + [(k, f"text number {k} of the others") for k in range(60) if k != 5]
    got = spotsigs.compare_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == len(rows)
    likes = lambda key: sorted(r["near_next"] == 1 for r in got if r["doc_id"] == key)
    assert likes(5) == [False] + [True] * 499 and likes(None) == [False] + [True] * 199
    assert spotsigs.compare_next(odd).count() == odd.count() and spotsigs.compare_next(empty).count() == 0
    assert spotsigs.fingerprints(odd, "doc_id", "score").count() == odd.count() and spotsigs.fingerprints(empty).count() == 0


def test_near_copies_are_those_of_brute_force(spark):
    rng, rows = random.Random(4), []
    vocabulary = [f"w{k}" for k in range(3000)]
    for _ in range(25):
        words = [w for k in range(60) for w in (rng.choice(["the", "of", "and"]), rng.choice(vocabulary), rng.choice(vocabulary))]
        for changes in (0, 0, 2, 5, 9, 14, 30):
            new = list(words)
            for at in rng.sample(range(len(new)), changes):
                new[at] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(new[:len(new) - rng.randrange(0, 20)])))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "the")]
    prints = spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    sets = [brute_set(t or "") for _, t in rows]
    near = np.array([[bool(a and b) and brute_likeness(a, b) >= 0.8 for b in sets] for a in sets])
    want = np.arange(len(rows))
    components.merge(want, *np.nonzero(near))
    for block in (256, 3):
        links = [(r["a"], r["b"]) for r in spotsigs.near_copies(prints, block=block).collect()]
        assert all(near[a, b] for a, b in links)
        # Equal fingerprints are one row of the search.
        same = {}
        links += [(k, same.setdefault(frozenset(s), k)) for k, s in enumerate(sets) if s]
        got = np.arange(len(rows))
        components.merge(got, *np.array(links).T)
        assert (got == want).all()
    assert spotsigs.near_copies(prints.limit(0)).count() == 0
    assert spotsigs.likeness(np.arange(3, dtype=np.uint64), np.arange(10, dtype=np.uint64), 0.8) == 0.0

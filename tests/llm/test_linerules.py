import collections
import re

from profuse.llm import linerules

from .conftest import SF


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, inside, seen, dup = collections.Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            inside |= set(range(i, i + 5))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n)


def check(frame):
    got = linerules.judge(frame).collect()
    assert sorted(map(str, ((r[0], *r[1:7]) for r in got))) == sorted(map(str, ((r[0], *brute(r[1])) for r in frame.select("doc_id", "text").collect())))
    assert not any(r["kept"] and r["base_failed"] for r in got)
    return got


def test_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    verdict = {r["doc_id"]: r for r in check(frame)}
    labels = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").collect()}
    good = [verdict[k] for k, q in labels.items() if q == 1 and not verdict[k]["base_failed"]]
    bad = [verdict[k] for k, q in labels.items() if q == 0]
    assert not [r for r in good if not r["kept"]]
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


def test_odd_rows(spark, odd, empty):
    check(odd)
    assert linerules.judge(empty).count() == 0
    six = "a b c d e f"
    check(spark.createDataFrame([(k, t) for k, t in enumerate([six, f"{six} {six}", f"x {six} {six} y {six}", "w " * 300, "a\na\n\n \na\nb", "a b c d e a b c d e a"])], "doc_id long, text string"))


PROSE = "This is a sentence of ordinary prose with some words. And here is another one, a bit longer than that.\n"


def kept_text(spark, text):
    rows = linerules.clean(spark.createDataFrame([(1, text, "v")], "doc_id long, text string, kept string")).collect()
    return rows[0]["text"] if rows else None


def test_lines_go_and_documents_with_them(spark):
    assert kept_text(spark, PROSE * 1) == PROSE
    assert kept_text(spark, PROSE + "Home | About | Contact\n" + "Licensed under the Apache License, Version 2.0.") == PROSE[:-1]
    assert kept_text(spark, PROSE[:50] + "\n" + "word | list | more | " * 20) is None
    assert kept_text(spark, "THE END!! IS!! NEAR!! AND!! MORE!! WORDS!! FOR!! ALL!! OF!! YOU!! NOW!!") is None
    assert kept_text(spark, "no no no no two two two two six six six six ten ten ten ten.") is None
    assert kept_text(spark, None) is None


def test_boilerplate_counts_as_lost(spark):
    notice = "All rights reserved. The terms of use of this site are licensed under a licence of this site.\n"
    assert kept_text(spark, PROSE + notice * 19) is None
    assert kept_text(spark, PROSE * 1 + notice.strip()) == PROSE[:-1]


def test_columns_stay(odd):
    assert linerules.clean(odd).columns == odd.columns


def test_stops_of_other_scripts_are_punctuation(spark):
    words = " ".join(f"شبد{k}" for k in range(24))
    for stop in "۔।։።،":
        assert kept_text(spark, f"{words}{stop}") == f"{words}{stop}"
    for sign in ("", " #", " it's", " a-b"):
        assert kept_text(spark, words + sign) is None

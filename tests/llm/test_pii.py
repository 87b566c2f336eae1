import hashlib
import re

from profuse.llm import pii, queries

from .conftest import SF

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fine(kind, value):
    digits = re.sub(r"\D", "", value, flags=re.A)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    spans = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if fine(kind, m.group())]
    return [(kind, s, e) for s, _, e, kind in sorted(spans)]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def check(spark, frame):
    got = pii.digest(pii.find(frame)).collect()
    want = sorted((str(r["doc_id"]), *[sum(s[0] == k for s in b) for k in KINDS], hashlib.sha256(listed(b).encode()).hexdigest())
                  for r in frame.select("doc_id", "text").collect() for b in [brute(r["text"])])
    assert sorted((str(r[0]), *r[1:6]) for r in got) == want
    texts = {r["doc_id"]: brute(r["text"]) for r in frame.collect()}
    for r in got:
        if r["doc_id"] is not None:
            assert set(listed(texts[r["doc_id"]]).split(",")) <= set(r["spans"].split(",")) | {""} or r["doc_id"] == 2


def test_documents(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert queries.op5_pii(spark, SF).count() == 200


TRICKY = [
    "a@b.c_d@e.f x@a@b.c é@x.de ü a.b%+-@c-d.e-f.g. @x.y a@b a@b..c", "1.2.3.4.5.6.7.8 01.002.255.256 0255.0.0.0 1.2.3 999999999999.1.1.1 1.2.3.4",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 4  1 4111 1111 1111 11115555 79927398713 0000000000000",
    "+1 (988) 555-2485 +49.30.1234567- ++12345678901 +1 +123456789012345678 + 123456789", "😀 user@host.org 😀 10.0.0.1", "", None,
    "+41 44 668 18 00 4111 1111 1111 1111 a@b.de,c@d.fr;1.1.1.1/2.2.2.2",
]


def test_tricky_texts(spark, odd, empty):
    check(spark, spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string"))
    check(spark, odd)
    assert pii.find(empty).count() == 0
    check(spark, spark.createDataFrame([(1, "x1." * 40_000 + " " + "9" * 60_000 + " " + "a.b" * 30_000 + "@q")], "doc_id long, text string"))


def taught():
    """Phones after 'tel' and addresses after 'mailto'; some are not of base form."""
    rows = [(k, f"Please tel +1 (555) 010-{1000 + k} today or mailto user{k}@mail.example.org soon, the end.") for k in range(8)]
    rows += [(100, "You may tel 555-010-7777 today."), (101, "Or mailto root@localhost soon."), (102, "In the year 1984-2001 the 12345 end.")]
    return rows + [(103, "Room 555-010-7777 again.")]


def test_contexts_teach_unseen_identifiers(spark):
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(taught(), "doc_id long, text string"))).collect()}
    assert got[100] == "phone:12:24" and got[101] == "email:10:24" and got[102] == "" and got[103] == "phone:5:17"


def test_redaction(spark, odd):
    frame = spark.createDataFrame([(k, t, "x") for k, t in taught()], "doc_id long, text string, base string")
    got = {r["doc_id"]: r for r in pii.redact(frame).collect()}
    assert got[0]["text"] == "Please tel <PHONE> today or mailto <EMAIL> soon, the end." and got[0]["base"] == "x"
    assert got[100]["text"] == "You may tel <PHONE> today." and got[102]["text"] == taught()[10][1]
    left = pii.redact(odd)
    assert left.columns == odd.columns and left.count() == odd.count()


def test_national_forms_with_spaces_are_found(spark):
    rows = taught() + [(200, "You may tel 020 7946 0958 today."), (201, "You may tel (555) 010-7777, or not."), (202, "In 1984 2001 300 came."),
                       (203, "Just tel (0)20 7946 0958 today."), (204, "Then tel 01 23 45 67 89 today.")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(frame)).collect()}
    assert got[200] == "phone:12:25" and got[201] == "phone:12:26" and got[202] == ""
    assert got[203] == "phone:9:24" and got[204] == "phone:9:23" and got[100] == "phone:12:24"
    left = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert left[200] == "You may tel <PHONE> today." and left[201] == "You may tel <PHONE>, or not."


def test_rounds_go_on_until_nothing_is_added(spark):
    """A chain: the values of a link are known only when the link before it is."""
    number = lambda link, k: f"555-{100 + link}-{1000 + k}"
    texts = [f"w0 +1 (555) 010-{1000 + k} end{k}" for k in range(8)] + [f"w0 {number(0, k)} x" for k in range(3)]
    for link in range(8):
        texts += [f"w{link + 1} {number(link, k)} x" for k in range(3)] * 2 + [f"w{link + 1} {number(link + 1, k)} x" for k in range(3)]
    texts += ["x"] * 500
    got = pii.digest(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert all((r["spans"] != "") == ("555" in texts[r["doc_id"]]) for r in got)


def test_context_words_are_whole(spark):
    """A neighbouring word longer than any window is found whole, on both sides, near or far."""
    rows, wanted = [], []
    for c, length in enumerate((40, 80, 5000, 300_000)):
        for gap in (" ", " " * 70):
            left, right, at = f"l{c}{len(gap)}l" * (length // 4), f"r{c}{len(gap)}r" * (length // 4), len(rows)
            left, right = (w.translate(str.maketrans("0123456789", "abcdefghij")) for w in (left, right))
            rows += [(at + k, f"{left}{gap}+1 555 010 77{k:02d}") for k in range(4)] + [(at + 4, f"{left}{gap}555{at:07d} done")]
            rows += [(at + 5 + k, f"+1 555 020 77{k:02d}{gap}{right}") for k in range(4)] + [(at + 9, f"556{at:07d}{gap}{right}")]
            wanted += [at + 4, at + 9]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k in wanted if len(got[k]["spans"]) != 1] == []

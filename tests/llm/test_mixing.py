import math
import re

import pytest
import xxhash

from profuse.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def check(frame):
    rows = frame.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    want = brute_targets(sizes)
    got = mixing.mix(frame).collect()
    again = mixing.mix(frame.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r["doc_id"]), size(r["text"])) for r in rows)
    by_goal = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert len(r["positions"]) == -(-r["taken"] // r["size"]) if r["taken"] else not r["positions"]
        assert all(0 <= p <= 1 for p in r["positions"])
        by_goal.setdefault((r["source_size"], round(r["target"], 6)), [0])[0] += r["taken"]
    goals = {}
    for s in sizes:
        goals.setdefault((sizes[s], round(want[s], 6)), []).append(want[s])
    assert set(by_goal) == set(goals)
    for k, (taken,) in by_goal.items():
        assert taken == pytest.approx(sum(goals[k]), abs=len(goals[k]))


def test_documents(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))
    got = queries.op9_mixing(spark, SF).collect()
    assert len(got) == 1000 and len({r["doc_id"] for r in got}) == 1000
    passes = sorted((r[f"position_{k}"], r["doc_id"], r[f"place_{k}"]) for r in got for k in (1, 2) if r[f"position_{k}"] is not None)
    # Ranks are gapless and follow the positions, then the keys; positions are those of the plan.
    assert [p for _, _, p in passes] == list(range(len(passes)))
    plan = {r["doc_id"]: r["positions"] for r in mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all([r[f"position_{k}"] for k in (1, 2) if r[f"position_{k}"] is not None] == plan[r["doc_id"]] for r in got)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_positions_invert_the_demand(spark):
    """Documents of a source in hash order: the demand's integral at a document's position is its first word's share."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(frame).collect()
    source = {r["doc_id"]: r["source"] for r in frame.select("doc_id", "source").collect()}
    runs, by_source = math.isqrt(len(rows)), {}
    for r in rows:
        first = xxhash.xxh64_intdigest(r["doc_id"].to_bytes(8, "little", signed=True), 42)
        order = signed(xxhash.xxh64_intdigest(r["text_hash"].to_bytes(8, "little", signed=True), first))
        by_source.setdefault(source[r["doc_id"]], []).append(((order >> 20) % runs, order, r))
    names = sorted(by_source)
    for s, mine in by_source.items():
        slope, at = mixing.SLOPES[names.index(s) % 3], 0
        for _, _, r in sorted(mine, key=lambda x: x[:2]):
            goal, want, taken = math.floor(r["target"] + 0.5), [], 0
            for k in range(2):
                start = at + k * r["source_size"]
                take = max(0, min(r["size"], goal - start))
                taken += take
                if take:
                    want.append(min(start / r["target"], 1.0))
            share = [(1 - slope) * t + slope * t * t for t in r["positions"]]
            assert share == pytest.approx(want, abs=1e-9) and taken == r["taken"]
            at += r["size"]


def test_capped_sources(spark):
    text = lambda n: "w " * n
    rows = [(k, text(5 + k), "abcde"[0 if k < 3 else k % 5]) for k in range(60)] + [(99, "", "zero"), (98, text(4), None), (97, text(3), "é"), (96, text(3), "😀"), (95, text(2), "\uffff")]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_odd_rows(odd, empty):
    check(odd)
    assert mixing.mix(empty).count() == 0 and mixing.places(mixing.mix(empty)).count() == 0
    placed = mixing.places(mixing.mix(odd)).collect()
    assert len(placed) == odd.count() and sorted(p for r in placed for p in r["places"]) == list(range(sum(len(r["positions"]) for r in placed)))
    got = mixing.training_set(odd)
    assert got.columns == odd.columns
    assert mixing.training_set(empty).count() == 0


def test_training_set_takes_what_the_mix_takes(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {r["doc_id"]: r for r in mixing.mix(frame).collect()}
    taken = {}
    for r in mixing.training_set(frame).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert taken == {k: r["taken"] for k, r in plan.items() if r["taken"]}


def test_schedules_move_sources_in_time(spark):
    rows = [(k, "w " * 10, "abc"[k % 3]) for k in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    mean = lambda s: sum(sum(r["positions"]) for r in got if r["doc_id"] % 3 == s) / sum(len(r["positions"]) for r in got if r["doc_id"] % 3 == s)
    assert mean(0) < 0.5 < mean(2)

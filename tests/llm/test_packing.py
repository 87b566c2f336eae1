import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from profuse.llm import packing, queries

SF = "/root/testdata/sf0.01"
FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def plain_ids(texts):
    tokenizer = Tokenizer.from_file(FILES[0])
    return [x.ids + [1] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check(rows, got, window=2048, most_padding=0.01):
    """Pieces rebuild every document once; sequences are gapless and nearly full."""
    ids = {}
    for r, x in zip(rows, plain_ids([r["text"] or "" for r in rows])):
        ids.setdefault((r["doc_id"], len(x)), []).append(np.array(x, dtype="<u4"))
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for key, mine in pieces.items():
        crc = lambda r, x: zlib.crc32(x[r["start"]:r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in mine) == key[1] * len(ids[key])
        assert all(any(crc(r, x) == r["ids_crc32"] for x in ids[key]) for r in mine)
        starts = sorted((r["start"], r["length"]) for r in mine)
        if len(ids[key]) == 1:
            assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(starts)) and starts[0][0] == 0
    assert sorted(sequences) == list(range(len(sequences)))
    used = padded = 0
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts))
        length = sum(n for _, n in parts)
        assert length <= window
        used += length
        padded += 0 if length & (length - 1) == 0 else window - length
    assert padded <= most_padding * used


def test_documents(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet").collect(), queries.op8_packing(spark, SF).collect())


def test_odd_rows(odd, empty):
    check(odd.collect(), packing.pack(odd, *FILES).collect(), most_padding=0.02)
    assert packing.pack(empty, *FILES).count() == 0


def test_both_libraries_and_pieces_give_the_same_ids(spark, monkeypatch):
    rng = random.Random(4)
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choice(" \n\t'aZé1.😀<|endoftext|>don't  \r\u00a0\u3000") for _ in range(rng.randrange(300))) for _ in range(400)]
    texts += ["<|endoftext|>", "a" * 5000, " " * 5000, "\n" * 3000 + "x"]
    want = plain_ids(texts)
    for encoder, piece in ((packing.Encoder(*FILES), 1 << 20), (packing.Encoder(FILES[0], None, None), 50), (packing.Encoder(*FILES), 50)):
        monkeypatch.setattr(packing, "PIECE", piece)
        assert all(encoder.ids(t).tolist() == w for t, w in zip(texts, want))


def test_special_literals_have_the_tokenizers_own_id():
    encoder = packing.Encoder(*FILES)
    assert encoder.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 1]
    assert [encoder.ids("a <|endoftext|> b").tolist()] == plain_ids(["a <|endoftext|> b"])


def test_boundaries_are_preferred_to_strides():
    encoder = packing.Encoder(*FILES)
    ids = encoder.ids("One two three four five. " * 3000)
    at, cost = packing.cut_costs(ids, encoder.ends, encoder.opens)
    assert set(cost.tolist()) == {0, packing.SENTENCE_COST} and all(encoder.ends[ids[k - 1]] for k in at[:-1])
    # A sentence of 50 tokens offers a stride; a boundary less than 64 tokens off is taken nevertheless.
    ids = encoder.ids(("word " * 49 + "end. ") * 300)
    at, cost = packing.cut_costs(ids, encoder.ends, encoder.opens)
    assert packing.STRIDE_COST in cost
    cuts = packing.best_cuts(at.tolist(), cost.tolist())
    assert len(cuts) > 5 and all(encoder.ends[ids[k - 1]] for k in cuts[:-1])
    ids = encoder.ids("One two. " + "word " * 3000 + "end. Next one.")
    at, _ = packing.cut_costs(ids, encoder.ends, encoder.opens)
    assert np.diff(np.r_[0, at]).max() <= packing.STRIDE


def test_cuts_are_the_best():
    rng = random.Random(2)
    for _ in range(60):
        at = sorted(rng.sample(range(1, 60), rng.randrange(3, 12)))
        cost = [rng.randrange(0, 6) for _ in at]
        cost[-1] = 0
        if max(b - a for a, b in itertools.pairwise([0, *at])) > 20:
            continue
        spent = lambda cuts: sum(20 - (b - a) for a, b in itertools.pairwise([0, *cuts[:-1]])) + sum(cost[at.index(c)] for c in cuts)
        every = ([*some, at[-1]] for k in range(len(at)) for some in itertools.combinations(at[:-1], k))
        best = min(spent(c) for c in every if max(b - a for a, b in itertools.pairwise([0, *c])) <= 20)
        assert spent(packing.best_cuts(at, cost, 20)) == best


@pytest.mark.parametrize("stretch", [4096, 1 << 18])
def test_stretches_lose_nothing(monkeypatch, stretch):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    packer, pieces, rng = packing.Packer(packing.Encoder(*FILES)), [], random.Random(1)
    texts = ["Some words. " * rng.randrange(0, 900) for _ in range(60)]
    for k, t in enumerate(texts):
        pieces += packer.add(k, t)
    pieces += packer.finish()
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    check([{"doc_id": k, "text": t} for k, t in enumerate(texts)], [dict(zip(names, p)) for p in pieces])


def test_sequences_follow_the_written_order(spark, tmp_path):
    """Files of very different sizes, which a scan deals by size, keep their order."""
    n = 400
    rows = [(k, f"Text number {k}. " * (1 + (k * 7 // 50) % 40)) for k in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id")
    frame.write.parquet(str(tmp_path / "t"))
    again = spark.read.parquet(str(tmp_path / "t"))
    assert [r["doc_id"] for r in again.collect()] != list(range(n))
    got = packing.pack(again, *FILES, written=True).collect()
    check(again.collect(), got, most_padding=0.02)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])) if r["start"] == 0] == list(range(n))
    assert not packing.reads_files(again.groupBy("doc_id").count()) and not packing.reads_files(frame)

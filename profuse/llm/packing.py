"""Order-preserving packing of tokenised documents into sequences.

Each input partition is a run: its documents follow each other in their order,
as one stream of token ids, and a dynamic programme chooses where windows end.
Cuts are allowed at document ends, at sentence ends (small penalty) and, in a
long sentence, at fixed strides (a penalty as large as 64 tokens of padding).  The cost of a window is
its padding, which is linear in its two ends, so the best start of each window
is the least element of a monotone queue.  What is left at the end of a run is
cut into powers of two, which need no padding.

A run is worked through in stretches of bounded length, so memory holds one
stretch and one document.  Nothing is shuffled; sequence numbers follow from the
runs' counts.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from profuse.session import stored

WINDOW = 2048
END_OF_TEXT = 1
STRIDE = 32
STRETCH = 1 << 18
SENTENCE_COST, STRIDE_COST = 4, 64
PIECE = 1 << 20


class Encoder:
    """Ids of the byte-level vocabulary, and which ids may end or follow a sentence.

    ``ranks`` holds the same vocabulary as ``tokenizer``; its library gives the
    same ids several times faster and is used unless it fails on a text or the
    text holds the literal of a special token, which only the tokenizer maps to
    its own id.
    """

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.marks = tuple(t.content for t in self.slow.get_added_tokens_decoder().values())
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        vocabulary = self.slow.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens = np.zeros_like(self.ends)
        for token, k in vocabulary.items():
            self.ends[k] = token.endswith((".", "!", "?", "Ċ"))
            self.opens[k] = token.startswith(("Ġ", "Ċ"))

    def _encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(mark in text for mark in self.marks):
            try:
                return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
            except Exception:  # noqa: BLE001 - the pattern engine gives up on some very long runs
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def ids(self, text: str) -> np.ndarray:
        """Ids of the text and the end mark.

        Long texts are cut before white space that follows a letter or sign, where
        the vocabulary's pattern always ends a token.
        """
        parts, at = [], 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and not (text[end].isspace() and not text[end - 1].isspace()):
                end += 1
            parts.append(self._encode(text[at:end]))
            at = end
        return np.concatenate([*parts, np.array([END_OF_TEXT], dtype=np.uint32)])


def cut_costs(ids: np.ndarray, ends: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in tokens) where a document may be cut, ascending, and the penalty of each.

    A stride inside a long sentence costs as much as 64 tokens of padding, so it
    is taken only where no boundary lies near enough to the window's end.
    """
    sentence = np.flatnonzero(ends[ids[:-1]] & opens[ids[1:]]) + 1
    sentence = sentence[sentence < len(ids)]
    marks = np.concatenate([[0], sentence, [len(ids)]])
    gaps = np.diff(marks)
    wide = np.flatnonzero(gaps > STRIDE)
    strides = [np.arange(marks[k] + STRIDE, marks[k + 1], STRIDE) for k in wide]
    at = np.concatenate([sentence, *strides, [len(ids)]]).astype(np.int64)
    cost = np.full(len(at), STRIDE_COST, dtype=np.int64)
    cost[:len(sentence)] = SENTENCE_COST
    cost[-1] = 0
    order = np.argsort(at, kind="stable")
    return at[order], cost[order]


def best_cuts(at: list[int], cost: list[int], window: int = WINDOW) -> list[int]:
    """Window ends (from ``at``) that cover 0..at[-1] with the least padding plus penalties.

    best[j] = min over i with at[j] - at[i] <= window of best[i] + at[i], plus
    window - at[j] + cost[j]; the minimum runs over a monotone queue.  The last
    window is open: it costs no padding.
    """
    points = [0, *at]
    best, back = [0] * len(points), [0] * len(points)
    queue = deque([(0, 0)])
    for j in range(1, len(points)):
        while queue and points[j] - points[queue[0][1]] > window:
            queue.popleft()
        value, back[j] = queue[0]
        best[j] = value + window - points[j] + cost[j - 1]
        key = best[j] + points[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = len(points) - 1
    back[j] = min((k for k in range(bisect_left(points, points[j] - window), j)), key=lambda k: best[k])
    cuts = []
    while j:
        cuts.append(points[j])
        j = back[j]
    return cuts[::-1]


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Turns a run of documents into pieces: (row, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, encoder: Encoder, window: int = WINDOW) -> None:
        self.encoder, self.window, self.sequence = encoder, window, 0
        self.docs = []           # (row, ids, first token not yet packed)
        self.at, self.cost, self.length = [], [], 0

    def add(self, row, text: str | None) -> list:
        ids = self.encoder.ids(text or "")
        at, cost = cut_costs(ids, self.encoder.ends, self.encoder.opens)
        self.at += (at + self.length).tolist()
        self.cost += cost.tolist()
        self.length += len(ids)
        self.docs.append((row, ids, 0))
        return self._settle(False) if self.length >= STRETCH else []

    def finish(self) -> list:
        return self._settle(True) if self.length else []

    def _settle(self, last: bool) -> list:
        """Pack all but the last few windows of the stretch (all of them at the end of the run)."""
        cuts = best_cuts(self.at, self.cost, self.window)
        if last:
            before = cuts[-2] if len(cuts) > 1 else 0
            rest = cuts[-1] - before
            cuts = cuts[:-1] + (before + np.cumsum(_powers(rest))).tolist()
        else:
            cuts = cuts[:-8]
        pieces, done = [], 0
        docs, k = self.docs, 0
        for cut in cuts:
            offset = 0
            while done < cut:
                row, ids, start = docs[k]
                take = min(len(ids) - start, cut - done)
                part = ids[start:start + take]
                pieces.append((row, start, take, zlib.crc32(part.astype("<u4").tobytes()), len(ids), self.sequence, offset))
                offset, done = offset + take, done + take
                docs[k] = (row, ids, start + take)
                k += start + take == len(ids)
            self.sequence += 1
        self.docs = docs[k:]
        gone = np.searchsorted(np.array(self.at), done, side="right")
        self.at = [x - done for x in self.at[gone:]]
        self.cost, self.length = self.cost[gone:], self.length - done
        return pieces


def reads_files(docs: DataFrame) -> bool:
    """Whether the rows are those of files, so that file name and row index are their order."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    if not plan.children().isEmpty():
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
         key: str = "doc_id", text: str = "text", window: int = WINDOW, written: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one end mark.  Ties do not arise: the order is that
    of the table's partitions and rows, repeated rows are packed each, null keys
    stay null.  Other columns are not read; an empty table has no sequence.

    Reading files again deals their splits by size, so partitions lose the order
    in which a table was written.  With ``written``, a table that is read
    directly from files is packed in the order of file names and rows: each
    stretch of consecutive rows of a file is a run.
    """
    by_file = written and reads_files(docs)
    place = ["_metadata.file_path", "_metadata.row_index"] if by_file else [F.lit("").alias("file_path"), F.lit(None).cast("long").alias("row_index")]
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), *place)
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches):
        encoder, packer, before, part = Encoder(tokenizer, ranks, pattern), None, None, TaskContext.get().partitionId()

        def out(pieces, origin):
            columns = list(zip(*pieces))
            types = [key_type, *[pa.int64()] * 6]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            runs = [pa.array([x] * len(pieces), t) for x, t in zip(origin, (pa.string(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*arrays, *runs], names=names)

        names, key_type = ["_key", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset", "file", "first"], None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for row, value, file, index in zip(*batch.columns):
                here = (file.as_py(), index.as_py() if by_file else part)
                if packer is None or (by_file and here != (before[0], before[1] + 1)):
                    if packer and (pieces := packer.finish()):
                        yield out(pieces, origin)
                    packer, origin = Packer(encoder, window), here
                before = here
                if pieces := packer.add(row.as_py(), value.as_py()):
                    yield out(pieces, origin)
        if packer and (pieces := packer.finish()):
            yield out(pieces, origin)

    found = stored(rows.mapInArrow(
        run, f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long, file string, first long"), "pieces")
    # One row per input partition or stretch of a file.
    counts = found.groupBy("file", "first").agg((F.max("sequence") + 1).alias("n"))
    before = Window.orderBy("file", "first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(F.broadcast(offsets), ["file", "first"]).select(
        F.col("_key").alias(key), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("sequence")).alias("sequence_id"), "offset")

"""Periodic runs in word sequences, by online dyadic square catching.

Words are appended in stretches of any length.  Each completed block of 2^k
words leaves a catcher, which knows the block's hash.  Every appended word
advances the suffix comparisons: at each level the hash of the last 2^k words
is compared with the catchers whose distance lies in that level's range of
periods, so a word meets one or two catchers a level.  A match is the seed of a
square; its stretch of equal words is extended exactly, and squares of one
period that overlap merge into a run.  Hashes are only a filter: equal blocks
always match, and what is reported is compared word by word.

Work is O(n log n) for n words, state is O(n) for the longest text; texts of a
batch are appended to one sequence with separators that equal nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MIN_LENGTH, EXPONENT = 24, 3
#: Words that are appended at a time.
STRETCH = 1 << 16
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def scatter(x: np.ndarray) -> np.ndarray:
    """64-bit mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _K1) ^ (b + _K3)
    x = (x ^ (x >> np.uint64(32))) * _K2
    return x ^ (x >> np.uint64(29))


class Level:
    """Catchers of the blocks of ``size`` words, for periods ``low`` .. ``high`` - 1."""

    def __init__(self, size: int, low: int, high: int) -> None:
        self.size, self.low, self.high = size, low, high
        self.halves = self.caught = np.zeros(0, dtype=np.uint64)

    def windows(self, halves: np.ndarray) -> np.ndarray:
        """Hashes of the windows of ``size`` words that end in the appended words, from those of half the size."""
        if self.size == 1:
            return halves
        half, both = self.size // 2, np.concatenate([self.halves, halves])
        self.halves = both[-half:]
        return _pair(both[:-half], both[half:]) if len(both) > half else both[:0]

    def compare(self, windows: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(block start, period) where a window equals a block that lies a period of this level before it."""
        start = end - self.size - len(windows) + 1
        self.caught = np.concatenate([self.caught, windows[-start % self.size::self.size]])
        at = np.arange(start, start + len(windows))
        starts, periods = [at[:0]], [at[:0]]
        for k in range(-(-(self.high - self.low) // self.size)):
            block = (at - self.low) // self.size - k
            fits = np.flatnonzero((block >= 0) & (at - block * self.size < self.high))
            hit = fits[self.caught[block[fits]] == windows[fits]]
            starts.append(block[hit] * self.size)
            periods.append(at[hit] - starts[-1])
        return np.concatenate(starts), np.concatenate(periods)


class Catchers:
    """The catchers of all levels; says which squares the appended words bring.

    A run of period q has a stretch of at least (exponent - 1) * q and
    min_length - q equal pairs.  Blocks of B words belong to the periods whose
    stretches have 2 B - 1 pairs or more, for these hold a whole aligned block.
    """

    def __init__(self, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> None:
        if exponent < 2 or min_length < 2:
            raise ValueError("a run repeats its period and has two words at least")
        self.repeats, self.least = exponent - 1, (exponent - 1) * min_length // exponent
        self.n, self.levels = 0, []

    def _level(self) -> Level:
        size = 1 << len(self.levels)
        low = self.levels[-1].high if self.levels else 1
        # The next size takes over where every stretch holds one of its blocks.
        high = max(low, 1 if self.least >= 4 * size - 1 else -(-(4 * size - 1) // self.repeats))
        return Level(size, low, high)

    def append(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per level that has some: block size, and block start and period of the squares caught."""
        self.n += len(words)
        windows, k = scatter(words.astype(np.uint64)), 0
        while len(windows):
            if k == len(self.levels):
                self.levels.append(self._level())
            level = self.levels[k]
            windows = level.windows(windows)
            if len(windows):
                starts, periods = level.compare(windows, self.n)
                if len(starts):
                    yield level.size, starts, periods
            k += 1


def _stretch(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The widest [a, b) around ``at`` with ids[i] == ids[i + period], empty if they differ there."""
    a, step = at, 64
    while a > 0:
        low = max(0, a - step)
        differ = np.flatnonzero(ids[low:a] != ids[low + period:a + period])
        if len(differ):
            a = low + int(differ[-1]) + 1
            break
        a, step = low, step * 2
    b, step, last = at, 64, len(ids) - period
    while b < last:
        high = min(last, b + step)
        differ = np.flatnonzero(ids[b:high] != ids[b + period:high + period])
        if len(differ):
            return a, b + int(differ[0])
        b, step = high, step * 2
    return a, b


def merge_squares(ids: np.ndarray, starts: np.ndarray, periods: np.ndarray, size: int, known: dict, min_length: int, exponent: int) -> None:
    """Extends the squares of one level to runs and adds those that are long enough to ``known``, {(start, end): period}.

    A square inside a known run whose period divides its own is that run again.
    """
    order = np.lexsort((starts, periods))
    starts, periods = starts[order], periods[order]
    if known:
        table = np.array(sorted((a, b, q) for (a, b), q in known.items()), dtype=np.int64)
        last = np.searchsorted(table[:, 0], starts, side="right") - 1
        row = table[np.maximum(last, 0)]
        inside = (last >= 0) & (starts + periods + size <= row[:, 1]) & (periods % row[:, 2] == 0)
        starts, periods = starts[~inside], periods[~inside]
    period, end = 0, 0
    # Neighbouring blocks with one period lie in one stretch: only the first is extended.
    head = np.ones(len(starts), dtype=bool)
    head[1:] = (periods[1:] != periods[:-1]) | (starts[1:] != starts[:-1] + size)
    heads = np.flatnonzero(head)
    for h, stop in zip(heads.tolist(), [*heads[1:].tolist(), len(starts)]):
        i = h
        while i < stop:
            at, q = int(starts[i]), int(periods[i])
            if q == period and at < end:
                a, b = 0, end
            else:
                a, b = _stretch(ids, at, q)
                period, end = q, b
                if b - a + q >= max(min_length, exponent * q):
                    known[a, b + q] = min(q, known.get((a, b + q), q))
            # Where the words end earlier than the hashes said, the rest starts anew.
            i = max(i + 1, h + -(-(b - int(starts[h])) // size)) if b > at else i + 1


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT, stretch: int = STRETCH) -> np.ndarray:
    """(start, length, period) of the maximal runs of ``ids``, by start and period.

    Each run has its smallest period; a longer one is a multiple with the same ends.
    """
    catchers, known = Catchers(min_length, exponent), {}
    for k in range(0, len(ids), stretch):
        for size, starts, periods in catchers.append(ids[k:k + stretch]):
            merge_squares(ids, starts, periods, size, known, min_length, exponent)
    found = sorted((a, b - a, q) for (a, b), q in known.items())
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def _several(words: list[list[bytes]], min_length: int, exponent: int) -> list[np.ndarray]:
    """The runs of several texts, found in one sequence with separators."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    ids = np.empty(int(sizes.sum()) + len(words), dtype=np.int64)
    ends = starts + sizes
    ids[ends] = -1 - np.arange(len(words))
    inside = np.ones(len(ids), dtype=bool)
    inside[ends] = False
    ids[inside] = pa.array([x for w in words for x in w], pa.large_binary()).dictionary_encode().indices.to_numpy()
    found = runs_of(ids, min_length, exponent)
    cuts = np.searchsorted(found[:, 0], starts[1:])
    parts = np.split(found, cuts)
    for part, start in zip(parts, starts):
        part[:, 0] -= start
    return parts


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by single spaces."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[k] for k in kept.tolist()])


def find_runs(docs: DataFrame, *keys: str, text: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """The key columns, ``runs`` (array of start, length, period by start and period) and ``collapsed`` of every row.

    Words are the stretches without ASCII white space; null and empty texts have
    none, no run and an empty collapsed text.  A run is a stretch of words with
    smallest period q that no neighbouring word continues, of at least
    ``min_length`` and ``exponent`` * q words.  ``collapsed`` drops what a run
    holds after its first q words.  Every row is judged by itself, so repeated
    rows, ties of the key and null keys give a row each; other columns are not
    read; an empty table gives an empty result.  One map over whole texts, no shuffle.
    """
    rows = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_pf_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
                       + ["runs array<struct<start:bigint,length:bigint,period:bigint>>", "_pf_collapsed binary"])

    def search(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at = 0
            while at < batch.num_rows:
                words, total, first = [], 0, at
                while at < batch.num_rows and total < STRETCH:
                    # bytes.split() parts at the six ASCII white space signs.
                    words.append(texts[at].as_py().split())
                    total += len(words[-1])
                    at += 1
                runs = _several(words, min_length, exponent)
                every = np.concatenate(runs)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                    [pa.array(every[:, k]) for k in range(3)], names=["start", "length", "period"]))
                collapsed = pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.binary())
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, collapsed], names=[*part.schema.names[:-1], "runs", "_pf_collapsed"])

    found = rows.mapInArrow(search, schema)
    return found.select(*keys, "runs", F.col("_pf_collapsed").cast("string").alias("collapsed"))

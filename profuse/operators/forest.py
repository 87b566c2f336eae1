"""Random forests of a whole grid in one scan of binned rows.

Every task holds the binned rows (a byte a value) and grows its share of the
trees, a level at a time and many trees side by side.  A tree cut at a lesser
depth is the upper part of a deeper one and a smaller forest the beginning of a
larger one, so depths and sizes cost no trees of their own.  Rows to be predicted
descend with the tree, which is then forgotten: neither trees nor rows are
collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from profuse.operators.arrays import matrix_of, mixed_hash, mixed_uniform, numbers_of, poisson_weights, row_hash
from profuse.session import stored

BINS = 64
BYTES = 1 << 27  # of binned rows that a task may hold; larger tables are for ``trees.fit_forest``
COLUMNS = 100  # whose quantiles come from one aggregate
CHUNK = 25  # trees of a unit of work
PAIRS = 1 << 18  # values of the rows of all trees that grow side by side
CELLS = 1 << 17  # of histograms, or of their keys, in a core's cache
SMALL = 25  # nodes of fewer rows are sorted instead of counted by bin


def columns_per_split(value, width: int) -> int:
    """Columns tried at a split, as the engine counts them; 'auto' and None mean all."""
    if value in (None, "auto"):
        return width
    return math.ceil(math.sqrt(width)) if value == "sqrt" else max(1, math.ceil(math.log2(width))) if value == "log2" else min(int(value), width)


def cut_points(df: DataFrame, width: int, x: str = "x", bins: int = BINS) -> list[np.ndarray]:
    """Values that may part a column: its distinct quantiles but the largest value."""
    steps, out = [i / bins for i in range(1, bins)], []
    for at in range(0, width, COLUMNS):
        found = df.agg(*[F.struct(F.percentile_approx(F.col(x)[j], steps).alias("q"), F.max(F.col(x)[j]).alias("top")).alias(f"c{j}")
                         for j in range(at, min(at + COLUMNS, width))]).first()
        out += [np.array(sorted({v for v in c["q"] or () if v < c["top"]}), dtype=float) for c in found]
    return out


def binned(df: DataFrame, cuts: Sequence[np.ndarray], seed=0, x: str = "x", y: str = "y", fold: str = "fold") -> DataFrame:
    """(no, fold, y, h, codes) of every row: its number ``no``, its hash and a byte per column."""
    source = df.select("no", F.col(fold).cast("int").alias("fold"), F.col(y).cast("double").alias("y"),
                       row_hash(seed).alias("h"), F.col(x).alias("x"))

    def code(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            whole = matrix_of(batch.column("x"))
            codes = np.column_stack([np.searchsorted(c, whole[:, j]).astype(np.uint8) for j, c in enumerate(cuts)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("no", "fold", "y", "h")], pa.array([r.tobytes() for r in codes], pa.binary())],
                                             ["no", "fold", "y", "h", "codes"])

    return stored(source.mapInArrow(code, "no bigint, fold int, y double, h bigint, codes binary"), "forest")


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("no", F.monotonically_increasing_id())


def prediction_sums(coded: DataFrame, families: Sequence[tuple[int, int]], sizes: Sequence[int], depths: Sequence[int], groups: Sequence[int],
                    seed: int = 0) -> DataFrame:
    """(family, fold, no, y, p) of the rows of every fold in ``groups``: predictions by forests of the other folds.

    A family is (least rows of a leaf, columns of a split).  ``p`` holds a
    prediction per size and depth (depths of a size side by side).  Rows of fold 0
    take no part in any fit.
    """
    sizes, depths = sorted(set(sizes)), sorted(set(depths))
    edges = [0, *sizes]
    units = [(i, f, b, t, min(t + CHUNK, edges[b + 1])) for i in range(len(families)) for f in groups
             for b in range(len(sizes)) for t in range(edges[b], edges[b + 1], CHUNK)]
    units.sort(key=lambda u: (-families[u[0]][1], families[u[0]][0], u))  # costly ones first
    parts = min(len(units), 4 * coded.sparkSession.sparkContext.defaultParallelism)
    shares = [units[k::parts] for k in range(parts)]

    def work(batches):
        held: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                for k in np.unique(batch.column("part").to_numpy()):
                    held.setdefault(int(k), []).append(batch.filter(pa.array(batch.column("part").to_numpy() == k)))
        for k in sorted(held):
            yield from _grown(pa.Table.from_batches(held.pop(k)).sort_by([("h", "ascending"), ("no", "ascending")]), shares[k], families, depths, seed)

    dealt = coded.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartitionByRange(parts, "part")
    found = dealt.mapInArrow(work, "family int, fold int, band int, no bigint, y double, v array<double>")
    sums = found.groupBy("family", "fold", "no").agg(
        F.first("y").alias("y"),
        *[F.sum(F.when(F.col("band") <= b, F.col("v")[d]) / F.lit(float(size))).alias(f"p{b}_{d}") for b, size in enumerate(sizes) for d in range(len(depths))])
    return sums.select("family", "fold", "no", "y", F.array(*[f"p{b}_{d}" for b in range(len(sizes)) for d in range(len(depths))]).alias("p"))


def _grown(table: pa.Table, units, families, depths, seed: int):
    """A batch of summed predictions per unit."""
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype=np.uint8).reshape(table.num_rows, -1)
    base, fold = table.column("h").to_numpy().view(np.uint64), table.column("fold").to_numpy()
    no, y = table.column("no").to_numpy(), numbers_of(table.column("y"))
    middle = float(y[fold > 0].mean()) if (fold > 0).any() else 0.0
    # Whole numbers, whose sums are exact: equal splits are equal to the last bit, whatever grows beside them.
    centred = np.where(fold > 0, y - middle, 0.0)
    unit = 2.0 ** (math.frexp(float(np.abs(centred).max(initial=0.0)))[1] + math.ceil(math.log2(4 * len(y))) - 52)
    centred = np.rint(centred / unit)
    for i, f, band, first, last in units:
        used, asked = np.flatnonzero((fold > 0) & (fold != f)), np.flatnonzero(fold == f)
        if not len(asked) or not len(used):
            continue
        total, batch = np.zeros((len(depths), len(asked))), max(1, PAIRS // (len(used) * families[i][1]))
        for t in range(first, last, batch):
            trees = range(t, min(t + batch, last))
            counts = np.zeros((len(trees), len(y)))
            for own, tree in zip(counts, trees):
                own[used] = poisson_weights(mixed_uniform(base[used], tree))
                if not own.any():
                    own[used] = 1.0
            keys = mixed_hash(np.full(len(trees), seed, dtype=np.uint64), np.array(trees))
            total += grow(codes, centred, counts, asked, depths, *families[i], keys)
        total = total * unit + (last - first) * middle
        n = len(asked)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(np.full(n, value, dtype=np.int32)) for value in (i, f, band)], pa.array(no[asked]), pa.array(y[asked]),
             pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(depths)), pa.array(np.ascontiguousarray(total.T).ravel()))],
            ["family", "fold", "band", "no", "y", "v"])


# ---- growing -----------------------------------------------------------------

def grow(codes: np.ndarray, y: np.ndarray, counts: np.ndarray, asked: np.ndarray, depths: Sequence[int], least: int, columns: int,
         keys: np.ndarray) -> np.ndarray:
    """Predictions for the rows ``asked``, summed over the trees: a line per (ascending) depth.

    ``counts`` has a line per tree, the times each row was drawn; ``keys`` a hash
    per tree, from which the columns of its nodes are drawn.  A split has the
    least squared error among those that leave ``least`` drawn rows on each side.
    """
    trees, width = len(counts), codes.shape[1]
    bins = int(codes.max(initial=0)) + 1
    node, row = np.nonzero(counts)  # rows of a node side by side, at every level
    w = counts[node, row]
    wy = w * y[row]
    tiny = 1e-12 * float(wy @ y[row]) / max(w.sum(), 1.0)
    who, at, which = np.arange(trees * len(asked)), np.repeat(np.arange(trees), len(asked)), np.tile(asked, trees)
    value, out = np.zeros(trees * len(asked)), []
    n, s = np.bincount(node, w, trees), np.bincount(node, wy, trees)
    for level in range(depths[-1] + 1):
        value[who] = (s / n)[at]
        if level in depths:
            out.append(value.reshape(trees, -1).sum(axis=0))
        if level == depths[-1]:
            break
        gain, column, cut = _best_splits(codes, bins, node, row, w, wy, n, s, least, columns, keys)
        split = gain > tiny * n
        if not split.any():
            break
        rank = np.cumsum(split) - 1
        keep = split[node]
        node, row, w, wy = node[keep], row[keep], w[keep], wy[keep]
        child = 2 * rank[node] + (codes[row, column[node]] > cut[node])
        order = np.argsort(child, kind="stable")
        node, row, w, wy = child[order], row[order], w[order], wy[order]
        keep = split[at]
        who, at, which = who[keep], at[keep], which[keep]
        at = 2 * rank[at] + (codes[which, column[at]] > cut[at])
        keys = mixed_hash(np.repeat(keys[split], 2), np.tile(np.array([width, width + 1]), int(split.sum())))
        n, s = np.bincount(node, w, 2 * int(split.sum())), np.bincount(node, wy, 2 * int(split.sum()))
    return np.vstack([*out, *[value.reshape(trees, -1).sum(axis=0)] * (len(depths) - len(out))])


def _best_splits(codes, bins, node, row, w, wy, n, s, least, columns, keys):
    """Gain, column and last code on the left of every node's best split; gain 0 without one."""
    count, width = len(n), codes.shape[1]
    gain, column, cut = np.zeros(count), np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    rows = np.bincount(node, minlength=count)
    able = (n >= 2 * least) & (rows > 1)
    for few, most in ((False, max(1, CELLS // (columns * bins))), (True, max(1, (1 << 16) // bins))):
        chosen = np.flatnonzero(able & ((rows < SMALL) == few))
        if not len(chosen):
            continue
        place = np.full(count, -1)
        place[chosen] = np.arange(len(chosen))
        mine = np.flatnonzero(place[node] >= 0)
        ends = np.r_[0, np.cumsum(rows[chosen])]
        for a in range(0, len(chosen), most):
            ids = chosen[a:a + most]
            pairs = mine[ends[a]:ends[a + len(ids)]]
            local = place[node[pairs]] - a
            drawn = None
            if columns < width:
                order = np.argpartition(mixed_hash(keys[ids][:, None], np.arange(width)), columns - 1, axis=1)[:, :columns]
                drawn = np.sort(order, axis=1)
            find = _by_sorting if few else _by_bins
            found, slot, last = find(codes, bins, row[pairs], local, w[pairs], wy[pairs], n[ids], s[ids], least, columns, drawn)
            gain[ids], cut[ids] = found - s[ids] ** 2 / n[ids], last
            column[ids] = slot if drawn is None else drawn[np.arange(len(ids)), slot]
    return gain, column, cut


def _scores(left_n, left_s, n, s, least, parts=None) -> np.ndarray:
    """Sum over both sides of (sum of y)^2 / rows; -inf where a side has too few rows.  The sums are used up."""
    right_n, right_s = n - left_n, s - left_s
    unfit = left_n < least
    unfit |= right_n < least
    if parts is not None:
        unfit |= ~parts
    with np.errstate(divide="ignore", invalid="ignore"):
        left_s *= left_s
        left_s /= left_n
        right_s *= right_s
        right_s /= right_n
    left_s += right_s
    left_s[unfit] = -np.inf
    return left_s


def _by_bins(codes, bins, row, local, w, wy, n, s, least, columns, drawn):
    """Best splits from a histogram per node and column."""
    size = columns * bins
    heap_n, heap_s = np.zeros(len(n) * size), np.zeros(len(n) * size)
    step, offset = max(1, CELLS // columns), np.arange(columns) * bins
    for a in range(0, len(row), step):
        here, of = row[a:a + step], local[a:a + step]
        key = (codes[here] if drawn is None else codes[here[:, None], drawn[of]]) + offset
        key += (of * size)[:, None]
        first, last = int(of[0]) * size, (int(of[-1]) + 1) * size
        key = key.ravel() - first
        heap_n[first:last] += np.bincount(key, np.repeat(w[a:a + step], columns), last - first)
        heap_s[first:last] += np.bincount(key, np.repeat(wy[a:a + step], columns), last - first)
    left_n, left_s = (np.cumsum(h, axis=2, out=h) for h in (heap_n.reshape(-1, columns, bins), heap_s.reshape(-1, columns, bins)))
    found = _scores(left_n, left_s, n[:, None, None], s[:, None, None], least).reshape(len(n), size)
    best = found.argmax(axis=1)
    return found[np.arange(len(n)), best], best // bins, best % bins


def _by_sorting(codes, bins, row, local, w, wy, n, s, least, columns, drawn):
    """Best splits of small nodes from their rows in the order of each column."""
    key = (codes[row] if drawn is None else codes[row[:, None], drawn[local]]).T.astype(np.uint16)
    key += (local * bins).astype(np.uint16)
    order = np.argsort(key, axis=1, kind="stable")
    key = np.take_along_axis(key, order, 1)
    starts = np.r_[0, np.flatnonzero(np.diff(local)) + 1]
    before = starts[local] - 1  # the sums until there are those of the nodes before
    left_n, left_s = (np.pad(v[order].cumsum(axis=1), ((0, 0), (1, 0))) for v in (w, wy))
    left_n, left_s = (v[:, 1:] - v[:, before + 1] for v in (left_n, left_s))
    parts = np.ones(key.shape, dtype=bool)
    parts[:, :-1] = key[:, 1:] != key[:, :-1]
    found = _scores(left_n, left_s, n[local], s[local], least, parts)
    top = np.maximum.reduceat(found, starts, axis=1)
    slot = top.argmax(axis=0)
    top = top[slot, np.arange(len(n))]
    hits = np.flatnonzero(found[slot[local], np.arange(len(local))] == top[local])
    hits = hits[np.unique(local[hits], return_index=True)[1]]
    return top, slot, key[slot, hits].astype(np.int64) - np.arange(len(n)) * bins


# ---- one forest --------------------------------------------------------------

@dataclass
class Forest:
    """Lazy learner: trees grow on the training rows where other rows are predicted."""

    train: DataFrame
    cuts: list[np.ndarray]
    size: int
    depth: int
    least: int
    columns: int
    seed: int = 0

    def transform(self, df: DataFrame, x: str = "x", out: str = "prediction") -> DataFrame:
        asked = stored(numbered(df), "asked")
        rows = numbered(self.train).select("no", "sample_id", "x", "y", F.lit(1).alias("fold")).unionByName(
            asked.select("no", F.lit("").alias("sample_id"), F.col(x).alias("x"), F.lit(None).cast("double").alias("y"), F.lit(0).alias("fold")))
        found = prediction_sums(binned(rows, self.cuts, self.seed), [(self.least, self.columns)], [self.size], [self.depth], [0], self.seed)
        return asked.join(found.select("no", F.col("p")[0].alias(out)), "no").drop("no")

"""Low-rank kernel features and multiple-kernel weights.

A kernel matrix is never built.  Landmark rows (at most a few hundred) are
collected and broadcast; each row's features are a function of the row and them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from profuse.functions.hashing import seeded_hash
from profuse.functions.kernels import PART, Kernel
from profuse.operators.arrays import list_of, matrix_of, numbers_of, row_blocks, sum_partials, vector_to_number, vector_to_vector
from profuse.operators.gram import Moments, check_width, moments
from profuse.operators.linear import LinearModel, ridge

MAX_LANDMARKS = 1_024


def landmark_rows(df: DataFrame, rank: int, seed, key: str = "sample_id", x: str = "x") -> np.ndarray:
    """``rank`` rows of smallest seeded hash (top-k, no full sort)."""
    if rank > MAX_LANDMARKS:
        raise ValueError(f"at most {MAX_LANDMARKS} landmarks")
    rows = df.select(x, key).orderBy(seeded_hash(seed, key), key).limit(rank).collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


@dataclass
class LowRankMap:
    """Row -> K(row, landmarks) @ mix, an n x r factor of the kernel matrix."""

    kernel: Kernel
    landmarks: np.ndarray
    mix: np.ndarray
    residuals: list[float] | None = None

    @property
    def rank(self) -> int:
        return self.mix.shape[1]

    def features(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x, self.landmarks) @ self.mix

    def residual(self, x: np.ndarray) -> np.ndarray:
        """K_ii - |g_i|^2, what the factor misses of the diagonal."""
        g = self.features(x)
        return self.kernel.diagonal(x) - np.einsum("ij,ij->i", g, g)


@dataclass
class Drawn:
    """A kernel map that reads drawn features only; ``marks`` are the landmarks before the draw."""

    columns: np.ndarray
    mapping: LowRankMap
    marks: np.ndarray | None = None

    @property
    def rank(self) -> int:
        return self.mapping.rank

    def features(self, x: np.ndarray) -> np.ndarray:
        return self.mapping.features(x[:, self.columns])


def each_features(maps: Sequence, x: np.ndarray) -> Iterator[np.ndarray]:
    """Features of every map in turn (None: the rows themselves).

    Kernels on the same landmarks share their products and distances, draws from
    the same landmarks theirs, and a map that is named again is not repeated.
    """
    parts: dict[tuple, np.ndarray] = {}
    drawn: dict[tuple, dict[int, int]] = {}  # per kind and landmarks: place of every draw
    counts: dict[tuple, np.ndarray] = {}
    for m in maps:
        if isinstance(m, Drawn) and _shares_draws(m):
            key = (m.mapping.kernel.part, id(m.marks))
            drawn.setdefault(key, {}).setdefault(id(m), len(drawn.get(key, ())))
    for m in maps:
        if isinstance(m, Drawn) and _shares_draws(m):
            key = (m.mapping.kernel.part, id(m.marks))
            if key not in counts:
                counts[key] = np.zeros((x.shape[1], len(drawn[key])))
            counts[key][:, drawn[key][id(m)]] = np.bincount(m.columns, minlength=x.shape[1])
    last, found = None, None
    for m in maps:
        if m is None:
            yield x
            continue
        if m is not last:
            if isinstance(m, Drawn):
                if _shares_draws(m):
                    key = (m.mapping.kernel.part, id(m.marks))
                    if key not in parts:
                        parts[key] = _drawn_parts(key[0], x, m.marks, counts[key])
                    found = m.mapping.kernel.from_part(parts[key][drawn[key][id(m)]]) @ m.mapping.mix
                else:
                    found = m.features(x)
            elif getattr(m, "kernel", None) is not None and m.kernel.part:
                key = (m.kernel.part, id(m.landmarks), m.kernel.start, m.kernel.stop)
                if key not in parts:
                    parts[key] = PART[m.kernel.part](m.kernel.block(x), m.kernel.block(m.landmarks))
                found = m.kernel.from_part(parts[key]) @ m.mix
            else:
                found = m.features(x)
            last = m
        yield found


def _shares_draws(m: Drawn) -> bool:
    kernel = m.mapping.kernel
    return m.marks is not None and kernel.part is not None and kernel.start == 0 and kernel.stop is None


def _drawn_parts(part: str, x: np.ndarray, marks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(draws, rows, landmarks): a draw's product or distance is the sum over columns of its counts times theirs."""
    out = np.empty((len(marks), len(x), counts.shape[1]))
    for i, z in enumerate(marks):
        gap = x * z if part == "product" else x - z
        np.matmul(gap * gap if part == "square" else np.abs(gap) if part == "absolute" else gap, counts, out=out[i])
    return np.ascontiguousarray(out.transpose(2, 1, 0))


def kernel_values(df: DataFrame, kernel: Kernel, landmarks: np.ndarray, x: str = "x", out: str = "k") -> DataFrame:
    """Kernel values between every row and the landmarks."""
    return df.withColumn(out, vector_to_vector(lambda m: kernel(m, landmarks), x))


def apply_maps(df: DataFrame, maps: Sequence[LowRankMap], x: str = "x", out: str = "g", scale: Sequence[float] | None = None) -> DataFrame:
    """Concatenated features of several kernels (their sum), optionally weighted."""
    factors = np.sqrt(np.ones(len(maps)) if scale is None else np.asarray(scale, dtype=float))
    blocks = [(m, f) for m, f in zip(maps, factors) if f > 0]
    return df.withColumn(out, vector_to_vector(lambda m: np.hstack([b.features(m) * f for b, f in blocks]), x))


def inverse_root(k: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    keep = values > 1e-10 * max(values.max(), 1e-300)
    return vectors[:, keep] / np.sqrt(values[keep])


def nystrom(df: DataFrame, kernel: Kernel, rank: int, seed=0, x: str = "x", landmarks: np.ndarray | None = None) -> LowRankMap:
    """G = K(:, A) K(A, A)^(-1/2) for hash-drawn landmarks A."""
    a = landmark_rows(df, rank, seed, x=x) if landmarks is None else landmarks
    return LowRankMap(kernel, a, inverse_root(kernel(a, a)))


def cholesky_map(kernel: Kernel, pivots: np.ndarray) -> LowRankMap:
    """G = K(:, P) L^-T with K(P, P) = L L'."""
    k = kernel(pivots, pivots)
    lower = np.linalg.cholesky((k + k.T) / 2 + 1e-12 * np.eye(len(k)) * max(np.trace(k) / len(k), 1e-300))
    return LowRankMap(kernel, pivots, np.linalg.inv(lower).T)


def incomplete_cholesky(df: DataFrame, kernel: Kernel, rank: int = 15, tol: float = 1e-8, x: str = "x",
                        key: str = "sample_id") -> LowRankMap:
    """Greedy pivots: each pass takes the row with the largest residual diagonal.

    A row's features follow from the pivots, so nothing is kept between passes.
    The aggregate also returns the trace of what is still missing.  A kernel
    whose diagonal is zero (or an empty table) gives a factor of rank 0.
    """
    row = df.select(x).first()
    width = len(row[0]) if row else 0
    pivots, traces = np.zeros((0, width)), []
    current = None
    for _ in range(rank + 1):
        left = kernel.diagonal if current is None else current.residual
        top = df.select(key, x, vector_to_number(left, x).alias("left")).agg(
            F.max(F.struct("left", key, x)).alias("top"), F.sum("left").alias("trace")).first()
        traces.append(float(top["trace"] or 0.0))
        if len(pivots) == rank or top["top"] is None or top["top"]["left"] <= tol:
            break
        pivots = np.vstack([pivots, np.array(top["top"][x], dtype=np.float64)])
        current = cholesky_map(kernel, pivots)
    if current is None:
        current = LowRankMap(kernel, pivots, np.zeros((0, 0)))
    current.residuals = traces
    return current


def trace_residual(df: DataFrame, fit: LowRankMap, x: str = "x") -> DataFrame:
    """Sum of K_ii - |g_i|^2: the trace norm of K - GG'."""
    return df.agg(F.sum(vector_to_number(fit.residual, x)).alias("residual"))


@dataclass
class KernelRidge:
    """Ridge on low-rank features; several maps mean their (weighted) sum kernel."""

    maps: list[LowRankMap]
    model: LinearModel
    weights: np.ndarray

    def transform(self, df: DataFrame, x: str = "x", out: str = "prediction") -> DataFrame:
        scaled = apply_maps(df, self.maps, x, "_g", self.weights)
        return self.model.transform(scaled, "_g", out).drop("_g")


def kernel_ridge(df: DataFrame, maps: Sequence[LowRankMap], alpha: float = 1.0, weights: Sequence[float] | None = None,
                 x: str = "x") -> KernelRidge:
    mu = np.ones(len(maps)) if weights is None else np.asarray(weights, dtype=float)
    m = moments(apply_maps(df, maps, x, "g", mu), x="g")["all"]
    return KernelRidge(list(maps), ridge(m, alpha), mu)


def map_moments(df: DataFrame, maps: Sequence[LowRankMap], by: str = "fold", x: str = "x", y: str = "y") -> dict[tuple[int, str], Moments]:
    """Moments of each map's features per value of ``by``, all from one scan; keys are (map number, value)."""
    check_width(max(m.rank for m in maps), len(maps))
    cols = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.col(by).cast("string").alias("g"))

    def partial(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xs, ys, groups = matrix_of(batch.column("x")), numbers_of(batch.column("y")), batch.column("g").to_numpy(zero_copy_only=False).astype(str)
            for g in np.unique(groups):
                mine = np.flatnonzero(groups == g)
                for at in row_blocks(len(mine)):
                    part, own = xs[mine[at]], ys[mine[at]]
                    for i, features in enumerate(each_features(maps, part)):
                        z = np.column_stack([np.ones(len(part)), features, own])
                        total[f"{i}|{g}"] = total.get(f"{i}|{g}", 0.0) + z.T @ z
        return total

    found = sum_partials(cols, partial)
    return {(int(i), g): Moments(z) for name, z in found.items() for i, g in [name.split("|", 1)]}


def fold_r2(df: DataFrame, maps: Sequence[LowRankMap], weights: dict[str, list[np.ndarray]], fold: str = "fold", x: str = "x", y: str = "y") -> list[np.ndarray]:
    """Mean R2 over folds of every map's linear models, from their predictions, in one scan.

    ``weights[f][i]`` holds a column (intercept, coefficients) per model of map i
    for the rows of fold f.  Sums of Grams would lose the error of badly scaled kernels.
    """
    cols = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.col(fold).cast("string").alias("g"))

    def partial(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xs, ys, groups = matrix_of(batch.column("x")), numbers_of(batch.column("y")), batch.column("g").to_numpy(zero_copy_only=False).astype(str)
            for f, models in weights.items():
                mine = np.flatnonzero(groups == f)
                for at in row_blocks(len(mine)):
                    part = ys[mine[at]]
                    gaps = [((part[:, None] - b[0] - z @ b[1:]) ** 2).sum(axis=0) for z, b in zip(each_features(maps, xs[mine[at]]), models)]
                    sums = np.concatenate([[len(part), part.sum(), (part * part).sum()], *gaps])[None]
                    total[f] = total.get(f, 0.0) + sums
        return total

    scores = []
    for sums in sum_partials(cols, partial).values():
        n, total, squares = sums[0, :3]
        scores.append(1.0 - sums[0, 3:] / (squares - total * total / n))
    edges = np.cumsum([0, *[b.shape[1] for b in next(iter(weights.values()))]])
    mean = np.mean(scores, axis=0)
    return [mean[a:b] for a, b in zip(edges[:-1], edges[1:])]


# ---- kernel weights ----------------------------------------------------------

def block_moments(df: DataFrame, maps: Sequence[LowRankMap], x: str = "x") -> tuple[Moments, list[slice]]:
    m = moments(apply_maps(df, maps, x), x="g")["all"]
    edges = np.cumsum([0, *[f.rank for f in maps]])
    return m, [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def alignment_parts(m: Moments, blocks: Sequence[slice]) -> tuple[np.ndarray, np.ndarray]:
    """Centred alignments with the response and between kernels, from factors."""
    gg, gy, _ = m.centred()
    a = np.array([float(gy[b] @ gy[b]) for b in blocks])
    between = np.array([[float((gg[p, q] ** 2).sum()) for q in blocks] for p in blocks])
    return a, between


def align(m: Moments, blocks: Sequence[slice], power: float = 1.0) -> np.ndarray:
    """Independent weights <K_c, yy'>^power."""
    return alignment_parts(m, blocks)[0] ** power


def alignf(m: Moments, blocks: Sequence[slice], kind: str = "linear") -> np.ndarray:
    """Weights that maximise the alignment of the combination, summing to one.

    ``convex`` keeps them non-negative (coordinate descent on the small system).
    """
    a, between = alignment_parts(m, blocks)
    scale = float(np.abs(between).max())
    between, a = between / scale, a / scale
    if kind == "linear":
        mu = np.linalg.pinv(between, rcond=1e-10, hermitian=True) @ a
    elif kind == "convex":
        mu = np.zeros(len(a))
        for _ in range(10_000):
            before = mu.copy()
            for j in range(len(a)):
                mu[j] = max(0.0, mu[j] + (a[j] - between[j] @ mu) / max(between[j, j], 1e-300))
            if np.abs(mu - before).max() <= 1e-12 * max(np.abs(mu).max(), 1e-300):
                break
    else:
        raise ValueError("kind is 'linear' or 'convex'")
    return mu / mu.sum()


# ---- least-angle multiple-kernel selection -----------------------------------

@dataclass
class KernelPath:
    """Columns chosen greedily across kernels and the ridge on them."""

    model: KernelRidge
    chosen: list[tuple[int, float]]  # (kernel, gain) per step


def _candidates(df: DataFrame, fits: list[LowRankMap | None], kernels: Sequence[Kernel], ahead: int, key: str, x: str) -> list[np.ndarray]:
    """The ``ahead`` rows of largest residual diagonal for every kernel, one pass.

    Each task sends its best rows only, so the second step ranks tasks x ahead
    rows per kernel.
    """
    count = len(kernels)

    def best(batches):
        kept: list[list] = [[] for _ in range(count)]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows, ids = matrix_of(batch.column(x)), batch.column(key).to_pylist()
            for q in range(count):
                left = kernels[q].diagonal(rows) if fits[q] is None else fits[q].residual(rows)
                near = np.argsort(-left, kind="stable")[:ahead * 2]
                merged = kept[q] + [(float(left[i]), ids[i], rows[i]) for i in near]
                kept[q] = sorted(merged, key=lambda t: (-t[0], t[1]))[:ahead]
        out = [(q, *t) for q in range(count) for t in kept[q]]
        if out:
            yield pa.RecordBatch.from_arrays([
                pa.array([t[0] for t in out], pa.int32()), pa.array([t[1] for t in out]),
                pa.array([t[2] for t in out], pa.string()), list_of(np.array([t[3] for t in out]))],
                ["q", "left", "id", "row"])

    top = df.select(F.col(key).cast("string").alias(key), x).mapInArrow(best, "q int, left double, id string, row array<double>")
    order = Window.partitionBy("q").orderBy(F.desc("left"), "id")
    rows = top.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= ahead).collect()
    found: list[list] = [[] for _ in range(count)]
    for r in sorted(rows, key=lambda r: (r["q"], r["place"])):
        if r["left"] > 1e-9:
            found[r["q"]].append(np.array(r["row"], dtype=np.float64))
    return [np.array(f) if f else np.zeros((0, 0)) for f in found]


def _trials(df: DataFrame, pivots, fits, kernels: Sequence[Kernel], ahead: int, key: str, x: str) -> list[tuple[int, np.ndarray, LowRankMap]]:
    """(kernel, pivots with one more, factor with one more column) of every candidate."""
    trials = []
    for q, rows in enumerate(_candidates(df, fits, kernels, ahead, key, x)):
        for row in rows:
            grown = row[None] if pivots[q] is None else np.vstack([pivots[q], row])
            trials.append((q, grown, cholesky_map(kernels[q], grown)))
    return trials


@dataclass
class LeastAngle:
    """State of least-angle regression on unit columns: active columns in order of entry, and their weights."""

    active: list[int]
    weights: np.ndarray

    def advance(self, gram: np.ndarray, cy: np.ndarray, candidates: Sequence[int], lam: float) -> tuple[int | None, float]:
        """Moves along the bisector until a candidate has the correlation of the active columns; (it, that correlation).

        ``gram`` and ``cy`` are the products of the unit columns with each other and
        with the response.  The direction lowers all active correlations in
        proportion, which is the bisector when they are equal.  A candidate that
        correlates more already joins without a step.  Without candidates the step
        is a whole one, which ends at the (ridge) least squares of the active columns.
        """
        a = self.active
        inner = gram[np.ix_(a, a)] + lam * np.eye(len(a))
        own = cy[a] - inner @ self.weights
        rest = np.array([j for j in candidates if j not in a], dtype=int)
        if not a:
            top = rest[np.argmax(np.abs(cy[rest]))] if len(rest) else None
            if top is None:
                return None, 0.0
            self._join(int(top))
            return int(top), float(abs(cy[top]))
        level, direction = float(np.abs(own).max()), np.linalg.solve(inner, own)
        step, best = 1.0, None
        if len(rest):
            c = cy[rest] - gram[np.ix_(rest, a)] @ self.weights
            slope = gram[np.ix_(rest, a)] @ direction
            with np.errstate(divide="ignore", invalid="ignore"):
                steps = np.stack([(level - c) / (level - slope), (level + c) / (level + slope)])
            steps[~np.isfinite(steps) | (steps < 0) | (steps > 1)] = 2.0
            steps = np.where(np.abs(c) >= level, 0.0, steps.min(axis=0))
            k = int(np.argmin(steps))
            if steps[k] <= 1.0:
                step, best = float(steps[k]), int(rest[k])
        self.weights = self.weights + step * direction
        if best is not None:
            self._join(best)
        return best, float((1.0 - step) * level)

    def _join(self, column: int) -> None:
        self.active.append(column)
        self.weights = np.append(self.weights, 0.0)


def least_angle_kernels(df: DataFrame, kernels: Sequence[Kernel], rank: int = 15, lam: float = 0.0, ahead: int = 10,
                        key: str = "sample_id", x: str = "x") -> KernelPath:
    """Least-angle multiple-kernel learning: ``rank`` columns across all kernels, then the whole step on them.

    A column is the next one of a kernel's partial Cholesky factor, centred and of
    unit length; ``ahead`` pivots of largest residual diagonal are its candidates.
    A step takes one pass for the candidates and one for the products of active
    columns, candidates and response; bisector and step length follow on the driver
    from that small matrix.  ``chosen`` holds the kernel and the correlation at entry.
    """
    pivots: list[np.ndarray | None] = [None] * len(kernels)
    fits: list[LowRankMap | None] = [None] * len(kernels)
    entered: list[tuple[int, int]] = []  # (kernel, column of its factor) in order of entry
    weights, chosen = np.zeros(0), []
    while True:
        trials = _trials(df, pivots, fits, kernels, ahead, key, x) if len(entered) < rank else []
        live = [q for q, f in enumerate(fits) if f is not None]
        starts = dict(zip(live, np.cumsum([0, *[fits[q].rank for q in live]])))
        used = sum(fits[q].rank for q in live)
        if not used + len(trials):
            break
        check_width(used + len(trials), 1)
        factors = [fits[q] for q in live]

        def columns(m, factors=factors, trials=trials):
            return np.hstack([*[f.features(m) for f in factors], *[t[2].features(m)[:, -1:] for t in trials]])

        found = moments(df.withColumn("_c", vector_to_vector(columns, x)), x="_c")["all"]
        gg, gy, _ = found.centred()
        length = np.sqrt(np.maximum(np.diag(gg), 0.0))
        # A candidate that is constant, or within the others of its kernel, has no direction.
        alive = [used + k for k in range(len(trials)) if length[used + k] > 1e-6 * max(length.max(), 1e-300)]
        unit = np.maximum(length, 1e-150)
        state = LeastAngle([starts[q] + k for q, k in entered], weights)
        best, level = state.advance(gg / np.outer(unit, unit), gy / unit, alive, lam)
        weights = state.weights
        if best is None:
            break
        q, pivots_q, fit = trials[best - used]
        entered.append((q, fit.rank - 1))
        pivots[q], fits[q] = pivots_q, fit
        chosen.append((q, level))
    coef = np.zeros(used)
    for (q, k), w in zip(entered, weights):
        coef[starts[q] + k] = w / unit[starts[q] + k]
    intercept = found.mean_y - float(found.mean_x[:used] @ coef) if entered else 0.0
    return KernelPath(KernelRidge(factors, LinearModel(coef, intercept), np.ones(len(factors))), chosen)


def forward_kernels(df: DataFrame, kernels: Sequence[Kernel], rank: int = 15, lam: float = 0.0, ahead: int = 10,
                        key: str = "sample_id", x: str = "x") -> KernelPath:
    """Choose ``rank`` kernel columns by their correlation with the residual.

    Each step looks at ``ahead`` candidate pivots of every kernel.  One pass finds
    the candidates, one sums the products of chosen columns, candidates and
    response; gains are then computed on the driver from that small matrix.
    """
    pivots: list[np.ndarray | None] = [None] * len(kernels)
    fits: list[LowRankMap | None] = [None] * len(kernels)
    chosen: list[tuple[int, float]] = []
    for _ in range(rank):
        trials = _trials(df, pivots, fits, kernels, ahead, key, x)
        if not trials:
            break
        live = [f for f in fits if f is not None]
        used = sum(f.rank for f in live)
        check_width(used + len(trials), 1)

        def columns(m, live=live, trials=trials):
            return np.hstack([*[f.features(m) for f in live], *[t[2].features(m)[:, -1:] for t in trials]])

        gg, gy, _ = moments(df.withColumn("_c", vector_to_vector(columns, x)), x="_c")["all"].centred()
        base = gg[:used, :used] + lam * np.eye(used)
        solve = np.linalg.pinv(base, rcond=1e-12, hermitian=True) if used else np.zeros((0, 0))
        cross = gg[:used, used:]
        left = gy[used:] - cross.T @ (solve @ gy[:used])
        size = np.diag(gg)[used:] - np.einsum("ij,ij->j", cross, solve @ cross) + lam
        gain = np.where(size > 1e-10, left ** 2 / np.maximum(size, 1e-300), -1.0)
        best = int(np.argmax(gain))
        q, grown, fit = trials[best]
        pivots[q], fits[q] = grown, fit
        chosen.append((q, float(gain[best])))
    live = [f for f in fits if f is not None]
    return KernelPath(kernel_ridge(df, live, max(lam, 1e-12), x=x), chosen)

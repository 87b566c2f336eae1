"""Low-rank imputation by alternating least squares on a soft-thresholded SVD.

Rows stay distributed.  A row's factor is a pure function of the row and of the
matrices broadcast so far, so a pass replays the steps since the last stored
state instead of keeping a growing lineage; every ``store_every`` steps the
factors are written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from profuse.operators.arrays import list_of, matrix_of, mixed_uniform, row_hash, sum_partials, vector_to_vector
from profuse.session import stored


@dataclass
class Step:
    """One half-step pair: rotate the old factor, refill, project on ``v``."""

    turn: np.ndarray   # old row factor a -> u * d in the basis of v
    v: np.ndarray      # p x r
    shrink: np.ndarray  # r


def _refill(x: np.ndarray, low_rank: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), low_rank, x)


def _advance(x: np.ndarray, a: np.ndarray, steps: list[Step]) -> tuple[np.ndarray, np.ndarray | None]:
    """Row factor after ``steps``; also the last basis."""
    v = None
    for step in steps:
        v = step.v
        a = (_refill(x, (a @ step.turn) @ v.T) @ v) * step.shrink
    return a, v


def _start_factor(h: np.ndarray, rank: int) -> np.ndarray:
    """Standard normal row factors from the row hash (Box-Muller)."""
    base = h.view(np.uint64)
    columns = []
    for j in range(rank):
        u1, u2 = mixed_uniform(base, 2 * j), mixed_uniform(base, 2 * j + 1)
        columns.append(np.sqrt(-2.0 * np.log(1.0 - u1)) * np.cos(2 * np.pi * u2))
    return np.column_stack(columns)


@dataclass
class LowRankImputer:
    rows: DataFrame
    steps: list[Step]
    v: np.ndarray
    turn: np.ndarray
    ratios: list[float]

    def transform(self, mode: str = "fill") -> DataFrame:
        """``fill`` replaces gaps only; ``reconstruct`` returns the low-rank fit itself."""
        if mode not in ("fill", "reconstruct"):
            raise ValueError("mode is 'fill' or 'reconstruct'")
        steps, width = self.steps, len(self.v)

        def apply(batches):
            for batch in batches:
                x, a = matrix_of(batch.column("x"), width), matrix_of(batch.column("a"))
                if len(x) == 0:
                    continue
                a, v = _advance(x, a, steps)
                low_rank = a @ v.T
                out = _refill(x, low_rank) if mode == "fill" else low_rank
                yield pa.RecordBatch.from_arrays([batch.column("sample_id"), list_of(out)], ["sample_id", "x"])

        return self.rows.mapInArrow(apply, "sample_id string, x array<double>")


def soft_impute(vectors: DataFrame, rank: int = 2, thresh: float = 1e-5, lam: float = 0.0, max_steps: int = 100,
                seed: int = 0, store_every: int = 10) -> LowRankImputer:
    """Fit; one scan per iteration, stopping on the Frobenius ratio of the change."""
    base = vectors.select("sample_id", F.col("x").alias("x"), row_hash(seed).alias("h"))
    base = stored(base, "impute")

    def first(batches):
        # start factor Gram and feature means in one pass
        out = {"uu": 0.0, "sum": 0.0, "n": 0.0}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix_of(batch.column("x"))
            u = _start_factor(batch.column("h").to_numpy(), rank)
            out["uu"] = out["uu"] + u.T @ u
            out["sum"] = out["sum"] + np.nansum(x, axis=0)[None]
            out["n"] = out["n"] + (~np.isnan(x)).sum(axis=0, dtype=float)[None]
        return out if np.ndim(out["uu"]) else {}

    found = sum_partials(base, first)
    means = (found["sum"] / np.maximum(found["n"], 1.0))[0]
    # orthonormal start: u (uu)^-1/2
    values, vectors_ = np.linalg.eigh(found["uu"])
    white = vectors_ / np.sqrt(np.maximum(values, 1e-300))

    def first_b(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix_of(batch.column("x"))
            u = _start_factor(batch.column("h").to_numpy(), rank) @ white
            total = total + u.T @ _refill(x, means[None, :])
        return {"b": total} if np.ndim(total) else {}

    b = sum_partials(base, first_b)["b"]

    def start(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            u = _start_factor(batch.column("h").to_numpy(), rank) @ white
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("x"), list_of(u)],
                                             ["sample_id", "x", "a"])

    schema = "sample_id string, x array<double>, a array<double>"
    state = base.mapInArrow(start, schema)
    steps: list[Step] = []
    to_u = np.eye(rank)               # u = a @ to_u
    d, ratios = np.ones(rank), []
    shrink = d / (d + lam) if lam > 0 else np.ones(rank)
    v_old = np.zeros((len(means), rank))
    for iteration in range(max_steps):
        left, new_d, right = np.linalg.svd((b * shrink[:, None]).T, full_matrices=False)
        v = left
        keep = new_d / (new_d + lam) if lam > 0 else np.ones(rank)
        steps = [*steps, Step(to_u @ right.T * new_d, v, keep)]
        replay, to_old = list(steps), to_u

        def pass_(batches, replay=replay, to_old=to_old, v=v):
            out = {"aa": 0.0, "ax": 0.0, "ua": 0.0}
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                x, a = matrix_of(batch.column("x")), matrix_of(batch.column("a"))
                before, _ = _advance(x, a, replay[:-1])
                after, _ = _advance(x, before, replay[-1:])
                out["aa"] = out["aa"] + after.T @ after
                out["ax"] = out["ax"] + after.T @ _refill(x, after @ v.T)
                out["ua"] = out["ua"] + (before @ to_old).T @ after
            return out if np.ndim(out["aa"]) else {}

        sums = sum_partials(state, pass_)
        # svd of the n x r factor A from its Gram: A = u diag(s) r'
        values, rot = np.linalg.eigh(sums["aa"])
        order = np.argsort(values)[::-1]
        s, rot = np.sqrt(np.maximum(values[order], 0.0)), rot[:, order]
        inverse = np.where(s > 1e-12 * max(s.max(), 1e-300), 1.0 / np.maximum(s, 1e-300), 0.0)
        to_u = rot * inverse
        # change between old and new fit
        vd = d[:, None] * (v_old.T @ (v @ rot))
        cross = float(np.trace((s[:, None] * (sums["ua"] @ to_u).T) @ vd))
        denom = float((d ** 2).sum())
        ratio = (denom + float((s ** 2).sum()) - 2.0 * cross) / max(denom, 1e-9)
        ratios.append(ratio)
        b = to_u.T @ sums["ax"]
        d, v_old = s, v @ rot
        shrink = d / (d + lam) if lam > 0 else np.ones(rank)
        if ratio <= thresh:
            break
        if len(steps) >= store_every and iteration + 1 < max_steps:
            state, steps = _store(state, steps, schema), []
    if not steps:
        raise AssertionError("the last step is always kept for transform")
    return LowRankImputer(state, steps, v_old, to_u, ratios)


def _store(state: DataFrame, steps: list[Step], schema: str) -> DataFrame:
    def apply(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, _ = _advance(matrix_of(batch.column("x")), matrix_of(batch.column("a")), steps)
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("x"), list_of(a)],
                                             ["sample_id", "x", "a"])

    return stored(state.mapInArrow(apply, schema), "impute")

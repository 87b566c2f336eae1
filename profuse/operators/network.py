"""Multi-input regression networks trained data-parallel.

A network is a nested description: ``Dense``, ``Experts``, ``Dropout``,
``Concat`` and ``Gated`` nodes over named ``Input`` blocks of the fused vector.
Every training step is one Spark job that sums gradients over rows; several
networks (settings, folds, repeats) share the scan of a step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from profuse.operators.arrays import matrix_of, mixed_hash, mixed_uniform, numbers_of, row_blocks, row_hash, sum_partials, vector_to_number

MAX_WEIGHTS = 1 << 25
LINE = 1_024  # numbers of a record of sums


# ---- description -------------------------------------------------------------

@dataclass(frozen=True)
class Input:
    name: str


@dataclass(frozen=True)
class Dense:
    source: object
    units: int
    activation: str = "linear"


@dataclass(frozen=True)
class Experts:
    """Mixture of experts: y_u = sum_k gate_k(x) f(W x + b)_uk; softmax runs over experts."""

    source: object
    units: int
    experts: int = 3
    activation: str = "linear"
    gate: str = "softmax"


@dataclass(frozen=True)
class Dropout:
    source: object
    rate: float


@dataclass(frozen=True)
class Concat:
    sources: tuple


@dataclass(frozen=True)
class Gated:
    """Gate times expert, summed over the experts of each class."""

    gate: object
    expert: object
    classes: int = 1


def activate(kind: str, z: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """``out`` may be ``z`` itself, if nobody needs that any more."""
    if kind == "relu":
        return np.maximum(z, 0.0, out=out)
    if kind == "tanh":
        return np.tanh(z, out=out)
    if kind == "logistic":
        out = np.clip(z, -500, 500, out=out)
        np.negative(out, out=out)
        np.exp(out, out=out)
        out += 1.0
        return np.divide(1.0, out, out=out)
    if kind == "softmax":
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)
    if kind == "linear":
        return z
    raise ValueError(f"unknown activation {kind!r}")


def activation_slope(kind: str, a: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Gradient at the input from the activation's output ``a`` and its gradient ``g``."""
    if kind == "relu":
        return g * (a > 0)
    if kind == "tanh":
        slope = a * a
        np.subtract(1.0, slope, out=slope)
        slope *= g
        return slope
    if kind == "logistic":
        slope = g * a
        slope *= 1.0 - a
        return slope
    if kind == "softmax":
        return a * (g - (g * a).sum(axis=-1, keepdims=True))
    return g


# ---- weights and passes ------------------------------------------------------

@dataclass
class Network:
    root: object
    blocks: dict[str, tuple[int, int]]
    weights: list[np.ndarray] = field(default_factory=list)
    l2: float = 0.0

    @classmethod
    def build(cls, root, blocks: dict[str, tuple[int, int]], seed: int = 0, l2: float = 0.0) -> "Network":
        """Draw Glorot-scaled weights for a description."""
        net = cls(root, blocks, l2=l2)
        rng = np.random.default_rng(seed)
        net._width(root, {}, rng)
        if sum(w.size for w in net.weights) > MAX_WEIGHTS:
            raise ValueError(f"more than {MAX_WEIGHTS} weights: reduce features first")
        return net

    def _width(self, node, seen: dict, rng) -> int:
        if id(node) in seen:
            return seen[id(node)]
        if isinstance(node, Input):
            start, stop = self.blocks[node.name]
            width = stop - start
        elif isinstance(node, Dense):
            p, width = self._width(node.source, seen, rng), node.units
            self._draw(rng, (p, width), p + width)
            self.weights.append(np.zeros((1, width)))
        elif isinstance(node, Experts):
            p, width = self._width(node.source, seen, rng), node.units
            self._draw(rng, (p, width * node.experts), p + width)
            self.weights.append(np.zeros((1, width * node.experts)))
            self._draw(rng, (p, node.experts), p + 1)
            self.weights.append(np.zeros((1, node.experts)))
        elif isinstance(node, Dropout):
            width = self._width(node.source, seen, rng)
        elif isinstance(node, Concat):
            width = sum(self._width(s, seen, rng) for s in node.sources)
        else:
            gate, expert = self._width(node.gate, seen, rng), self._width(node.expert, seen, rng)
            if gate != expert or gate % node.classes:
                raise ValueError("gate and expert need the same width, a multiple of the classes")
            width = node.classes
        seen[id(node)] = width
        return width

    def _draw(self, rng, shape, fans: float) -> None:
        limit = np.sqrt(6.0 / max(fans, 2.0))
        self.weights.append(rng.uniform(-limit, limit, shape))

    def run(self, x: np.ndarray, noise=None) -> tuple[np.ndarray, list]:
        """Output and the tape of (node, backward) pairs; ``noise(layer, width)`` drops units."""
        tape: list = []
        values: dict[int, np.ndarray] = {}
        cursor = [0]
        self._forward(self.root, x, values, tape, cursor, noise)
        return values[id(self.root)], tape

    def _take(self, cursor, n: int) -> tuple[int, list[np.ndarray]]:
        at = cursor[0]
        cursor[0] += n
        return at, self.weights[at:at + n]

    def _forward(self, node, x, values, tape, cursor, noise) -> np.ndarray:
        if id(node) in values:
            return values[id(node)]
        go = lambda s: self._forward(s, x, values, tape, cursor, noise)
        if isinstance(node, Input):
            start, stop = self.blocks[node.name]
            out = x[:, start:stop]
        elif isinstance(node, Dense):
            h = go(node.source)
            at, (w, b) = self._take(cursor, 2)
            z = h @ w
            z += b
            out = activate(node.activation, z, z)

            def back(g, node=node, h=h, w=w, at=at, out=out):
                z = activation_slope(node.activation, out, g)
                flow = [] if isinstance(node.source, Input) else [(node.source, z @ w.T)]
                return flow, {at: h.T @ z, at + 1: z.sum(axis=0, keepdims=True)}
            tape.append((node, back))
        elif isinstance(node, Experts):
            h = go(node.source)
            at, (w, b, v, c) = self._take(cursor, 4)
            expert = activate(node.activation, (h @ w + b).reshape(len(h), node.units, node.experts))
            gate = activate(node.gate, h @ v + c)
            out = np.einsum("nue,ne->nu", expert, gate)

            def back(g, node=node, h=h, w=w, v=v, at=at, expert=expert, gate=gate):
                ze = activation_slope(node.activation, expert, g[:, :, None] * gate[:, None, :]).reshape(len(h), -1)
                zg = activation_slope(node.gate, gate, np.einsum("nu,nue->ne", g, expert))
                grads = {at: h.T @ ze, at + 1: ze.sum(axis=0, keepdims=True), at + 2: h.T @ zg, at + 3: zg.sum(axis=0, keepdims=True)}
                return [] if isinstance(node.source, Input) else [(node.source, ze @ w.T + zg @ v.T)], grads
            tape.append((node, back))
        elif isinstance(node, Dropout):
            h = go(node.source)
            keep = None if noise is None else (noise(len(tape), h.shape[1]) >= node.rate) / (1.0 - node.rate)
            out = h if keep is None else h * keep
            tape.append((node, lambda g, node=node, keep=keep: ([(node.source, g if keep is None else g * keep)], {})))
        elif isinstance(node, Concat):
            parts = [go(s) for s in node.sources]
            out = np.hstack(parts)
            edges = np.cumsum([0, *[p.shape[1] for p in parts]])
            tape.append((node, lambda g, node=node, edges=edges: (
                [(s, g[:, a:b]) for s, a, b in zip(node.sources, edges[:-1], edges[1:])], {})))
        else:
            gate, expert = go(node.gate), go(node.expert)
            shape = (len(gate), node.classes, -1)
            out = (gate * expert).reshape(shape).sum(axis=2)

            def back(g, node=node, gate=gate, expert=expert):
                wide = np.repeat(g, gate.shape[1] // node.classes, axis=1)
                return [(node.gate, wide * expert), (node.expert, wide * gate)], {}
            tape.append((node, back))
        values[id(node)] = out
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.run(x)[0][:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray, noise=None) -> tuple[float, list[np.ndarray]]:
        """Summed squared error and its gradient over the rows."""
        out, tape = self.run(x, noise)
        gap = out[:, 0] - y
        pending = {id(self.root): 2.0 * gap[:, None]}
        grads: list = [None] * len(self.weights)
        for node, back in reversed(tape):
            g = pending.pop(id(node), None)
            if g is None:
                continue
            flows, own = back(g)
            for i, value in own.items():
                grads[i] = value if grads[i] is None else grads[i] + value
            for source, value in flows:
                if not isinstance(source, Input):
                    pending[id(source)] = pending[id(source)] + value if id(source) in pending else value
        return float(gap @ gap), [np.zeros_like(w) if g is None else g for g, w in zip(grads, self.weights)]

    def transform(self, df: DataFrame, x: str = "x", out: str = "prediction") -> DataFrame:
        return df.withColumn(out, vector_to_number(self.predict, x))


# ---- training ----------------------------------------------------------------

@dataclass
class Job:
    """One network to train: rows of fold ``left_out`` are kept out (0: none).

    With ``patience`` a hashed share ``hold`` of the other rows validates instead
    of training: training ends when their error has not fallen by ``tol`` (as a
    share) for so many epochs, and the network keeps the weights of its best epoch.
    """

    net: Network
    epochs: int = 10
    left_out: int = 0
    rate: float = 1e-3
    seed: int = 0
    patience: int = 0
    hold: float = 0.1
    tol: float = 1e-4
    losses: list[float] = field(default_factory=list)
    curve: list[float] = field(default_factory=list)  # validation error before epoch 0, 1, ...
    best_epoch: int = 0
    best: list[np.ndarray] | None = None
    stopped: bool = False
    first: list[np.ndarray] | None = None
    second: list[np.ndarray] | None = None
    steps: int = 0

    def judge(self, epoch: int, error: float) -> None:
        """Takes the validation error of the weights after ``epoch`` epochs."""
        self.curve.append(error)
        if self.best is None or error < self.curve[self.best_epoch] * (1.0 - self.tol):
            self.best, self.best_epoch = list(self.net.weights), epoch
        self.stopped = not np.isfinite(error) or epoch - self.best_epoch >= self.patience

    def adam(self, grads: list[np.ndarray], b1: float = 0.9, b2: float = 0.999, eps: float = 1e-7) -> None:
        if self.first is None:
            self.first = [np.zeros_like(w) for w in grads]
            self.second = [np.zeros_like(w) for w in grads]
        self.steps += 1
        scale = self.rate * np.sqrt(1 - b2 ** self.steps) / (1 - b1 ** self.steps)
        new = []
        for i, g in enumerate(grads):
            self.first[i] = b1 * self.first[i] + (1 - b1) * g
            self.second[i] = b2 * self.second[i] + (1 - b2) * g * g
            new.append(self.net.weights[i] - scale * self.first[i] / (np.sqrt(self.second[i]) + eps))
        self.net.weights = new


def train(df: DataFrame, jobs: Sequence[Job], batches: int = 1, x: str = "x", y: str = "y", fold: str | None = None,
          key: str = "sample_id", validate: int | None = None) -> Sequence[Job]:
    """Synchronous training of all jobs; an epoch has ``batches`` steps on hashed parts of the rows.

    The first step of an epoch also sums the validation errors of the jobs that
    stop early, so they cost no scan but one after the last epoch. The rows of fold
    ``validate``, if given, take the place of their hashed shares.
    """
    source = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), row_hash(0, key).alias("h"),
                       (F.col(fold).cast("int") if fold else F.lit(-1)).alias("f"))
    for epoch in range(max(job.epochs for job in jobs) + 1):
        active = [(i, job) for i, job in enumerate(jobs) if not job.stopped and epoch < job.epochs + (job.patience > 0)]
        for part in range(batches):
            task = [(i, job.net, job.left_out, job.seed, job.hold if job.patience else 0.0, epoch < job.epochs)
                    for i, job in active if not job.stopped and (part == 0 or epoch < job.epochs)]
            if not task:
                break
            sums = sum_partials(source, lambda b, t=task, e=epoch, k=part: _gradients(b, t, e, k, batches, validate))
            for i, *_, learns in task:
                job, found = jobs[i], sums[str(i)].ravel() if str(i) in sums else np.zeros(4)
                n, sse, held, held_sse = found[:4]
                if held:
                    job.judge(epoch, float(held_sse / held))
                if job.stopped or not learns or not n:
                    continue
                job.losses.append(float(sse / n))
                edges = np.cumsum([4, *[w.size for w in job.net.weights]])
                job.adam([found[a:b].reshape(w.shape) / n + 2.0 * job.net.l2 * w / n for a, b, w in zip(edges, edges[1:], job.net.weights)])
    for job in jobs:
        if job.best is not None:
            job.net.weights = job.best
    return jobs


def held_out(base: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Rows that validate: a hashed share, the same in every pass and partitioning."""
    return mixed_uniform(mixed_hash(base, seed), 104_729) < share


def mean_gradient(df: DataFrame, net: Network, x: str = "x", y: str = "y") -> tuple[float, list[np.ndarray]]:
    """Mean squared error and its gradient over all rows, without dropout."""
    source = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"))

    def partial(batches):
        out: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sse, grads = net.gradient(matrix_of(batch.column("x")), numbers_of(batch.column("y")))
            out["n"] = out.get("n", 0.0) + np.array([[batch.num_rows, sse]])
            for k, g in enumerate(grads):
                out[str(k)] = out.get(str(k), 0.0) + g
        return out

    sums = sum_partials(source, partial)
    n, sse = sums["n"][0]
    return float(sse / n), [sums[str(k)] / n for k in range(len(net.weights))]


def _gradients(batches, task, epoch: int, part: int, parts: int, validate: int | None = None) -> dict[str, np.ndarray]:
    """Of every network [rows, squared error, rows that validate, their squared error, gradient], in lines of ``LINE`` numbers.

    The lines are the records that travel: rows of the weight matrices would be many short ones.
    """
    out: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        whole = matrix_of(batch.column("x")), numbers_of(batch.column("y")), batch.column("h").to_numpy().view(np.uint64), batch.column("f").to_numpy()
        for at in row_blocks(len(whole[0])):
            _block_gradients(out, *(column[at] for column in whole), task, epoch, part, parts, validate)
    return {str(i): np.pad(sums, (0, -len(sums) % LINE)).reshape(-1, LINE) for i, sums in out.items()}


def _block_gradients(out: dict[int, np.ndarray], xs, ys, base, fold, task, epoch: int, part: int, parts: int, validate: int | None) -> None:
    """Adds the sums of a block of rows, whose layers stay in a core's cache."""
    mine = np.floor(mixed_uniform(base, 7919 + epoch) * parts) == part
    picked: dict[tuple, tuple] = {}  # rows that validate and those that train, for all networks that share them
    for i, net, left_out, seed, hold, learns in task:
        key = (left_out, seed if hold else None, hold)
        if key not in picked:
            own = fold != left_out if left_out else np.ones(len(xs), dtype=bool)
            checked = np.zeros(len(xs), dtype=bool)
            if hold:
                aside = held_out(base, seed, hold) if validate is None else fold == validate
                checked, own = own & aside & (part == 0), own & ~aside
            use = own & mine
            picked[key] = xs[checked], ys[checked], xs[use], ys[use], base[use]
        x_held, y_held, x, y, rows = picked[key]
        if i not in out:
            out[i] = np.zeros(4 + sum(w.size for w in net.weights) * learns)
        sums = out[i]
        if len(y_held):
            gap = net.predict(x_held) - y_held
            sums[2:4] += len(y_held), gap @ gap
        if not learns or not len(y):
            continue

        def noise(layer, width, rows=rows, seed=seed):
            # Hashed one after the other, so no two (seed, step, layer) share a stream at any depth or width.
            own = mixed_hash(mixed_hash(mixed_hash(rows, seed), epoch * parts + part), layer)
            return np.column_stack([mixed_uniform(own, u) for u in range(width)])

        sse, grads = net.gradient(x, y, noise)
        sums[:2] += len(y), sse
        sums[4:] += np.concatenate([g.ravel() for g in grads])


def errors(df: DataFrame, jobs: Sequence[Job], x: str = "x", y: str = "y", fold: str | None = None) -> list[float]:
    """Mean squared error of every job, on its left-out fold or on all rows: one pass."""
    return [float(row[3] / row[0]) for row in _fit_sums(df, jobs, x, y, fold)]


def fold_scores(df: DataFrame, jobs: Sequence[Job], x: str = "x", y: str = "y", fold: str | None = None) -> list[float]:
    """R2 of every job, on its left-out fold or on all rows: one pass."""
    return [float(1.0 - sse / max(squares - total ** 2 / n, 1e-300)) for n, total, squares, sse in _fit_sums(df, jobs, x, y, fold)]


def _fit_sums(df: DataFrame, jobs: Sequence[Job], x: str, y: str, fold: str | None) -> np.ndarray:
    """Count, sum of y, sum of squares and squared error of every job's rows."""
    source = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("f"))
    task = [(job.net, job.left_out) for job in jobs]

    def partial(batches):
        total = np.zeros((len(task), 4))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xs, ys, fs = matrix_of(batch.column("x")), numbers_of(batch.column("y")), batch.column("f").to_numpy()
            for i, (net, left_out) in enumerate(task):
                use = fs == left_out if left_out else np.ones(len(xs), dtype=bool)
                if use.any():
                    total[i] += [use.sum(), ys[use].sum(), (ys[use] ** 2).sum(), ((net.predict(xs[use]) - ys[use]) ** 2).sum()]
        return {"t": total}

    return sum_partials(source, partial)["t"]


# ---- fusion layouts ----------------------------------------------------------

def branch(name: str, units: int, experts: int = 3, activation: str = "relu", gate: str = "softmax", depth: int = 4, dropout: float = 0.0):
    """A profile's stack of expert layers, each followed by dropout if any."""
    node = Input(name)
    for _ in range(depth):
        node = Experts(node, units, experts, activation, gate)
        if dropout:
            node = Dropout(node, dropout)
    return node


def tower(node, units: int, depth: int, activation: str, dropout: float = 0.0):
    for _ in range(depth):
        node = Dense(node, units, activation)
        if dropout:
            node = Dropout(node, dropout)
    return node


def one_stage(profiles: Sequence[str], units: int = 100, head: int = 100, depth: int = 4, head_depth: int = 5):
    """Branches joined once, then a dense head."""
    joined = Concat(tuple(Dense(branch(p, units, depth=depth), units, "relu") for p in profiles))
    return Dense(tower(joined, head, head_depth, "relu"), 1, "relu")


def two_stage(profiles: Sequence[str], late: str, units: int = 75, head: int = 100, depth: int = 4, head_depth: int = 5, late_depth: int = 4):
    """Branches of ``profiles`` joined first; the ``late`` profile joins after the first head."""
    arm = lambda p: Dense(branch(p, units, activation="tanh", depth=depth), units, "relu")
    first = tower(Concat(tuple(arm(p) for p in profiles)), head, head_depth, "relu")
    return Dense(tower(Concat((first, arm(late))), head, late_depth, "relu"), 1, "relu")


def all_profiles(profiles: Sequence[str], units: int, dropout: float, activation: str, experts: int = 10, depth: int = 12):
    """Deep branches for every profile with dropout, joined under a deep head."""
    joined = Concat(tuple(branch(p, units, experts, activation, activation, depth, dropout) for p in profiles))
    return Dense(tower(joined, units, depth, activation, dropout), 1, activation)


def gate_expert(gate: str, expert: str, experts: int, classes: int = 1, depth: int = 1, activation: str = "softmax"):
    """Gate from one profile, experts from another."""
    width = experts * classes
    return Gated(Dense(Input(gate), width, "softmax"), branch(expert, width, 3, activation, "softmax", depth), classes)


def two_gates(first: str, second: str, expert: str, experts: int, classes: int, units: int):
    """Two gates over shared experts, joined under a small head with a linear output."""
    width = experts * classes
    shared = Experts(Input(expert), width, 3, "softmax", "softmax")
    joined = Concat(tuple(Gated(Dense(Input(g), width, "softmax"), shared, classes) for g in (first, second)))
    return Dense(tower(joined, units, 2, "softmax"), 1, "linear")


def perceptron(profile: str, sizes: Sequence[int], activation: str = "relu"):
    """Feed-forward network on one block."""
    node = Input(profile)
    for units in sizes:
        node = Dense(node, units, activation)
    return Dense(node, 1, "linear")


# Search grid of the feed-forward network.
GRID = {"hidden": [(100, 3), (200, 30), (50, 10), (100, 50)], "activation": ["linear", "logistic", "tanh", "relu"], "alpha": [0.0001, 0.001]}

"""Kernel functions between rows and landmarks (numpy, used inside tasks)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


def squared_distance(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """|x - z|^2 without the cancellation of the expanded form."""
    out = np.zeros((len(x), len(z)))
    for j in range(x.shape[1]):
        gap = x[:, j, None] - z[None, :, j]
        out += gap * gap
    return out


def absolute_distance(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(z)))
    for j in range(x.shape[1]):
        out += np.abs(x[:, j, None] - z[None, :, j])
    return out


def linear(x, z, b=0.0):
    return x @ z.T + b


def whole_power(x: np.ndarray, degree: int) -> np.ndarray:
    """x ** degree by repeated squaring; the general power costs many products."""
    if degree != int(degree) or degree < 1:
        return x ** degree
    out, degree = None, int(degree)
    while True:
        if degree & 1:
            out = x if out is None else out * x
        degree >>= 1
        if not degree:
            return out
        x = x * x


def poly(x, z, degree=3, b=0.0, gamma=1.0):
    return whole_power(gamma * (x @ z.T) + b, degree)


def rbf(x, z, sigma=1.0):
    return np.exp(-squared_distance(x, z) / (2.0 * sigma ** 2))


def sigmoid(x, z, c=1.0, b=0.0):
    return np.tanh(c * (x @ z.T) + b)


def exponential(x, z, sigma=2.0):
    return np.exp(-absolute_distance(x, z) / (2.0 * sigma ** 2))


def periodic(x, z, sigma=1.0, per=1.0):
    return np.exp(-2.0 * np.sin(np.pi * np.sqrt(squared_distance(x, z)) / per) ** 2 / sigma ** 2)


def matern(x, z, nu=1.5):
    d = np.sqrt(squared_distance(x, z))
    if nu == 0.5:
        return np.exp(-d)
    if nu == 1.5:
        return (1.0 + np.sqrt(3.0) * d) * np.exp(-np.sqrt(3.0) * d)
    if nu == 2.5:
        return (1.0 + np.sqrt(5.0) * d + 5.0 * d * d / 3.0) * np.exp(-np.sqrt(5.0) * d)
    raise ValueError("nu is 0.5, 1.5 or 2.5")


def laplacian(x, z, gamma=1.0):
    return np.exp(-gamma * absolute_distance(x, z))


KERNELS = {"linear": linear, "poly": poly, "rbf": rbf, "sigmoid": sigmoid, "exponential": exponential,
           "periodic": periodic, "matern": matern, "laplacian": laplacian}


# What a kernel computes of row and landmark, and its value from that: kernels on the same landmarks share the first.
PARTS = {"linear": "product", "poly": "product", "sigmoid": "product", "rbf": "square", "laplacian": "absolute"}
PART = {"product": lambda x, z: x @ z.T, "square": squared_distance, "absolute": absolute_distance}
FROM_PART = {
    "linear": lambda d, b=0.0: d + b,
    "poly": lambda d, degree=3, b=0.0, gamma=1.0: whole_power(gamma * d + b, degree),
    "sigmoid": lambda d, c=1.0, b=0.0: np.tanh(c * d + b),
    "rbf": lambda d, sigma=1.0: np.exp(-d / (2.0 * sigma ** 2)),
    "laplacian": lambda d, gamma=1.0: np.exp(-gamma * d),
}


@dataclass(frozen=True)
class Kernel:
    """A named or user-supplied kernel on a block of the fused vector.

    A user function takes two row matrices and returns their kernel matrix, so
    sums of kernels are ordinary Python functions.
    """

    kind: str | Callable
    params: dict = field(default_factory=dict)
    start: int = 0
    stop: int | None = None

    def block(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.start:self.stop]

    def __call__(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        function = self.kind if callable(self.kind) else KERNELS[self.kind]
        return function(self.block(x), self.block(z), **self.params)

    @property
    def part(self) -> str | None:
        """The product or distance that this kernel is a function of, if it can be shared."""
        return None if callable(self.kind) else PARTS.get(self.kind)

    def from_part(self, values: np.ndarray) -> np.ndarray:
        return FROM_PART[self.kind](values, **self.params)

    def diagonal(self, x: np.ndarray) -> np.ndarray:
        if self.kind in ("rbf", "exponential", "periodic", "matern", "laplacian"):
            return np.ones(len(x))
        b = self.block(x)
        if self.kind in ("linear", "poly", "sigmoid"):
            same = np.einsum("ij,ij->i", b, b)
            if self.kind == "linear":
                return same + self.params.get("b", 0.0)
            if self.kind == "poly":
                return (self.params.get("gamma", 1.0) * same + self.params.get("b", 0.0)) ** self.params.get("degree", 3)
            return np.tanh(self.params.get("c", 1.0) * same + self.params.get("b", 0.0))
        return np.array([self.kind(b[i:i + 1], b[i:i + 1], **self.params)[0, 0] for i in range(len(b))])


def gamma_kernel(kind: str, gamma: float, degree: int = 3, coef0: float = 0.0) -> Kernel:
    """Kernels in the (gamma, degree, coef0) parametrisation."""
    if kind == "linear":
        return Kernel("linear")
    if kind == "poly":
        return Kernel("poly", {"degree": degree, "b": coef0, "gamma": gamma})
    if kind == "rbf":
        return Kernel("rbf", {"sigma": float(np.sqrt(0.5 / gamma))})
    if kind == "sigmoid":
        return Kernel("sigmoid", {"c": gamma, "b": coef0})
    return Kernel("laplacian", {"gamma": gamma})

"""Linear models from sums: one pass over the rows gives every fold's moments, and all fits are made of those.

A fold's moments are its count and the sums of products of (1, features, target). Training rows of a fold of time-ordered
validation are those of the folds before, so their moments are sums, too; errors on held-out rows follow from
theirs. A grid of penalties costs no further pass, and the driver holds one small matrix for each fold. Features are
shifted and scaled by their mean and deviation first, so that differences of sums lose no digits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numbers import number

#: A deviation below this is none: the feature is divided by 1.
FLAT = 1e-12


def feature(name: str) -> Column:
    """A feature as models see it: what is missing is 0."""
    return F.coalesce(number(name), F.lit(0.0))


@dataclass(frozen=True)
class Moments:
    """Sums of products of (1, features, target), of features less ``shift`` over ``unit``."""

    sums: np.ndarray
    shift: np.ndarray
    unit: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.sums + other.sums, self.shift, self.unit)

    @property
    def n(self) -> float:
        return self.sums[0, 0]

    def deviations(self) -> np.ndarray:
        """Population deviations of the features (in units), 1 where there is none."""
        mean = self.sums[0, 1:-1] / self.n
        sd = np.sqrt(np.maximum(np.diag(self.sums)[1:-1] / self.n - mean**2, 0.0))
        return np.where(sd * self.unit <= FLAT, 1.0, sd)

    def normal(self, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Covariances of the features over ``sd`` with each other and with the target."""
        mean, y = self.sums[0, 1:-1] / self.n, self.sums[0, -1] / self.n
        g = (self.sums[1:-1, 1:-1] / self.n - np.outer(mean, mean)) / np.outer(sd, sd)
        return g, (self.sums[1:-1, -1] / self.n - mean * y) / sd

    def intercept(self, w: np.ndarray) -> float:
        """For weights of the features (in units)."""
        return float((self.sums[0, -1] - self.sums[0, 1:-1] @ w) / self.n)

    def squared_error(self, w: np.ndarray, b: float) -> float:
        """Sum of squared errors of these rows under a model."""
        v = np.concatenate([[-b], -w, [1.0]])
        return float(v @ self.sums @ v)


def total(parts: Iterable[Moments]) -> Moments:
    first, *rest = parts
    return sum(rest, first)


def moments(df: DataFrame, features: Sequence[str], y: str, part: str) -> dict[int, Moments]:
    """The moments of each value of ``part`` (an int); rows without a target are left out."""
    rows = df.where(F.col(y).isNotNull() & F.col(part).isNotNull()).select(F.col(part).cast("int").alias("part"), F.col(y).alias("y"), *[feature(f).alias(f"x{i}") for i, f in enumerate(features)])
    p = len(features)
    head = rows.agg(F.array(*[F.avg(f"x{i}") for i in range(p)]).alias("m"), F.array(*[F.stddev_pop(f"x{i}") for i in range(p)]).alias("s")).head()
    if head is None or not p or head["m"][0] is None:
        return {}
    shift, sd = np.array(head["m"]), np.array(head["s"])
    unit = np.where(sd <= FLAT, 1.0, sd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            parts = b.column(0).to_numpy()
            z = np.column_stack([np.ones(b.num_rows), *[(b.column(2 + i).to_numpy() - shift[i]) / unit[i] for i in range(p)], b.column(1).to_numpy()])
            for k in np.unique(parts):
                own = z[parts == k]
                found[int(k)] = found.get(int(k), 0) + own.T @ own
        for k, s in found.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k] * (p + 2), pa.int32()), "i": pa.array(range(p + 2), pa.int32()), "row": pa.array(list(s), pa.list_(pa.float64()))})

    sums = rows.mapInArrow(run, "part int, i int, row array<double>").groupBy("part", "i").agg(F.array(*[F.sum(F.get("row", F.lit(j))) for j in range(p + 2)]).alias("row"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():  # a small matrix for each part
        out.setdefault(r["part"], np.zeros((p + 2, p + 2)))[r["i"]] = r["row"]
    return {k: Moments(s, shift, unit) for k, s in out.items()}


def descend(g: np.ndarray, q: np.ndarray, l1: float, l2: float, start: np.ndarray | None = None, tolerance: float = 1e-11, most: int = 100_000) -> np.ndarray:
    """The least of w'gw/2 - q'w + l1 |w| + l2 w'w/2 by coordinate descent: over all weights, then over those that aren't 0 until they stay."""
    w = np.zeros(len(q)) if start is None else start.copy()
    rest, curve = q - g @ w, np.diag(g)

    def sweep(some: Sequence[int]) -> float:
        moved = 0.0
        for j in some:
            rho, bend = rest[j] + curve[j] * w[j], curve[j] + l2
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / bend if bend > FLAT else 0.0
            if new != w[j]:
                rest[:] -= g[:, j] * (new - w[j])
                moved, w[j] = max(moved, abs(new - w[j])), new
        return moved

    for _ in range(most):
        if sweep(range(len(q))) <= tolerance:
            break
        for _ in range(most):
            if sweep(np.flatnonzero(w)) <= tolerance:
                break
    return w


@dataclass(frozen=True)
class Linear:
    """A fitted model: weights of the features as they come, and the intercept."""

    features: tuple[str, ...]
    weights: np.ndarray
    intercept: float

    def predicted(self) -> Column:
        out = F.lit(float(self.intercept))
        for name, w in zip(self.features, self.weights, strict=True):
            if w:
                out = out + F.lit(float(w)) * feature(name)
        return out


def _model(features: Sequence[str], m: Moments, w: np.ndarray) -> Linear:
    """``w``: weights of the features in units."""
    own = w / m.unit
    return Linear(tuple(features), own, m.intercept(w) - float(own @ m.shift))


def fit_elastic_net(m: Moments, features: Sequence[str], alpha: float, l1_ratio: float) -> Linear:
    """Half the mean squared error, plus alpha times (l1_ratio of |w| and half the rest of w'w), of standardised features."""
    sd = m.deviations()
    return _model(features, m, descend(*m.normal(sd), alpha * l1_ratio, alpha * (1 - l1_ratio)) / sd)


def fit_ridge(m: Moments, features: Sequence[str], alpha: float) -> Linear:
    """The same with the penalty alpha on half of w'w alone, in closed form."""
    sd = m.deviations()
    g, q = m.normal(sd)
    return _model(features, m, np.linalg.lstsq(g + alpha * np.eye(len(q)), q, rcond=None)[0] / sd)


def cross_validated(folds: dict[int, Moments], alphas: Sequence[float], ratios: Sequence[float]) -> dict[tuple[float, float], float]:
    """The mean over folds 1, 2, ... of the mean squared error on the fold of a model of all folds before, for each (alpha, l1 ratio).

    Features are standardised by all folds. A ratio's penalties are solved from the largest down, each from the last solution.
    """
    sd, out = total(folds.values()).deviations(), {}
    for k in sorted(folds)[1:]:
        train = total(m for j, m in folds.items() if j < k)
        g, q = train.normal(sd)
        for ratio in ratios:
            w = None
            for alpha in sorted(alphas, reverse=True):
                w = descend(g, q, alpha * ratio, alpha * (1 - ratio), w)
                own = w / sd
                out.setdefault((alpha, ratio), []).append(folds[k].squared_error(own, train.intercept(own)) / folds[k].n)
    return {k: float(np.mean(v)) for k, v in out.items()}

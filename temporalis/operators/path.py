"""The L1 path of balanced multinomial logistic regression without intercept, by coordinate descent.

Penalties go from the largest down, each fit starting from the one before. A pass over the rows
adds up, task by task, the loss, its slopes, and for each two classes the curvature of the active
features (those with a weight, and those whose last slope the strong rule can't screen out);
the sums of a pair meet in one task, and a row a pair of active x active numbers reaches the
driver. There coordinate descent takes the quadratic model to its minimum; the
step is halved until the objective falls. Beyond ``COUPLED`` classes times active features,
classes are taken apart: that takes more steps to the same minimum, and a row a class. A screened feature whose slope turns out to
pass the penalty joins the active ones. A fit ends when the duality gap, an upper bound of
how far the objective is from its minimum, is below ``TOL``.

Rows without a label or features are left out; a null or NaN feature counts as 0.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

TOL = 1e-5
#: Newton steps of a fit, sweeps of a quadratic model, and halvings of a step.
STEPS, SWEEPS, HALVES = 60, 150, 20
#: Weights that one quadratic model of all classes may have: its matrix is the driver's.
COUPLED = 4096
#: Bytes of all tasks' sums that the driver takes.
AT_ONCE = 32 << 20
#: A curvature below this is a feature without values.
FLAT = 1e-12


class Fit(NamedTuple):
    penalty: float
    weights: np.ndarray
    loss: float
    gap: float
    passes: int


class Sums(NamedTuple):
    """Of a pass, a row's weight being its share of all: loss, entropy of the dual point, slopes, curvatures."""

    loss: float
    dual: float
    slopes: np.ndarray
    curves: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    return np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1), nan=0.0)


def _chances(x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the sum of exponents, class probabilities) of each row."""
    used = np.flatnonzero(weights.any(axis=0))
    z = x[:, used] @ weights[:, used].T
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    return z - top - np.log(total), e / total


def _added(rows: DataFrame, task, keys: str, parts: int, size: int) -> dict[int, np.ndarray]:
    """task(batches) gives rows (key, values) a task, of so many numbers in all; the sums of each key.

    Sums of few tasks are added up by the driver (AT_ONCE bounds them), those of many by a task a key.
    """
    ship(rows.sparkSession)
    out = f"{keys} int, values array<double>"
    if 8 * size * parts <= AT_ONCE:
        totals: dict[int, np.ndarray] = {}
        for r in rows.mapInArrow(task, out).toArrow().to_batches():
            for key, values in zip(r.column(0).to_pylist(), r.column(1), strict=True):
                totals[key] = totals.get(key, 0.0) + values.values.to_numpy()
        return totals

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for key, values in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = values.values.to_numpy()
                totals[key] = totals[key] + own if key in totals else own
        for key, values in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([values], pa.list_(pa.float64()))], names=[keys, "values"])

    return {r[keys]: np.array(r["values"]) for r in rows.mapInArrow(task, out).repartition(keys).mapInArrow(add, out).collect()}


class Rows(NamedTuple):
    """rows (class_idx int, weight double, feats array<double>) with what fits need to know of them."""

    rows: DataFrame
    classes: int
    features: int
    total: float
    scale: np.ndarray
    parts: int


def prepared(rows: DataFrame, standardised: bool = True) -> Rows:
    """rows should be stored: each fit passes over them many times. Features are divided by their deviations."""

    def task(batches):
        n, total, s = 0.0, 0.0, None
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(2))
            own = np.stack([x.sum(axis=0), (x * x).sum(axis=0)])
            s = own if s is None else s + own
            n, total = n + len(x), total + b.column(1).to_numpy().sum()
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.concatenate([[n, total], *s])], pa.list_(pa.float64()))], names=["part", "values"])

    own = rows.where("class_idx is not null and feats is not null").select("class_idx", "weight", "feats")
    last = own.agg(F.max("class_idx")).first()[0]
    classes = 0 if last is None else last + 1
    parts, width = own.rdd.getNumPartitions(), own.select(F.max(F.size("feats"))).first()[0] or 0
    found = _added(own, task, "part", parts, 2 * width + 2)
    if not found:
        return Rows(own, classes, 0, 0.0, np.zeros(0), parts)
    n, total, *both = found[0]
    mean, square = np.array(both).reshape(2, -1) / n
    std = np.sqrt(np.maximum(square - mean**2, 0.0))
    flat = std <= 1e-7 * (1 + np.abs(mean))
    scale = np.where(flat, 0.0, 1.0 / np.where(flat, 1.0, std)) if standardised else np.ones(len(std))
    return Rows(own, classes, len(std), float(total), scale, parts)


def sums(data: Rows, weights: np.ndarray, active: np.ndarray, shrink: float = 1.0) -> Sums:
    """One pass at these weights; shrink: the share of the residuals that the dual point takes."""
    k, m, scale = data.classes, data.features, data.scale
    size = len(active)
    coupled = k * size <= COUPLED
    pairs = [(c, d) for c in range(k) for d in range(c, k) if coupled or c == d]

    def task(batches):
        loss = dual = 0.0
        slopes, curves = np.zeros((k, m)), {pair: np.zeros((len(active), len(active))) for pair in pairs}
        for b in batches:
            if not b.num_rows:
                continue
            own, w, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2)) * scale
            logs, p = _chances(x, weights)
            at = np.arange(len(own))
            loss -= float(w @ logs[at, own])
            residual = p.copy()
            residual[at, own] -= 1.0
            q = np.maximum(shrink * residual, 0.0)
            q[at, own] = 1.0 + shrink * residual[at, own]
            dual -= float(w @ np.where(q > 0, q * np.log(np.where(q > 0, q, 1.0)), 0.0).sum(axis=1))
            slopes += (residual * w[:, None]).T @ x
            some = x[:, active]
            for c, d in pairs if size else ():
                # taken apart, classes have curvatures that are no less than the whole matrix
                share = w * p[:, c] * ((c == d) - p[:, d] if coupled else 1.0)
                curves[c, d] += (some * share[:, None]).T @ some
        parts = [np.concatenate([*([[loss if not c else 0.0, dual if not c else 0.0], slopes[c]] if c == d else []), curves[c, d].ravel()]) for c, d in pairs]
        yield pa.RecordBatch.from_arrays([pa.array([c * k + d for c, d in pairs], pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=["pair", "values"])

    values = {pair: v / data.total for pair, v in _added(data.rows, task, "pair", data.parts, k * (m + 2) + len(pairs) * size * size).items()}
    own = [values[c * k + c] for c in range(k)]
    curve = np.zeros((k, size, k, size)) if coupled else np.zeros((k, size, size))
    for c, d in pairs:
        block = values[c * k + d][-size * size :].reshape(size, size) if size else np.zeros((0, 0))
        if coupled:
            curve[c, :, d], curve[d, :, c] = block, block.T
        else:
            curve[c] = block
    return Sums(sum(v[0] for v in own), sum(v[1] for v in own), np.array([v[2 : 2 + m] for v in own]), curve.reshape(k * size, k * size) if coupled else curve)


def descend(weights: np.ndarray, slopes: np.ndarray, curve: np.ndarray, penalty: float) -> np.ndarray:
    """The least of slopes (v - weights) + (v - weights) curve (v - weights) / 2 + penalty |v|.

    Sweeps over the coordinates tell which are zero and the others' signs; where features are alike they
    creep, so between sweeps the others go straight to their least, or up to where one becomes zero.
    """
    v, pull = weights.copy(), slopes.copy()  # pull: the model's slope at v
    diagonal = np.diag(curve)
    some = np.flatnonzero(diagonal > FLAT)
    for sweep in range(SWEEPS):
        most = 0.0
        for j in some:
            want = v[j] * diagonal[j] - pull[j]
            new = np.sign(want) * max(abs(want) - penalty, 0.0) / diagonal[j]
            if (step := new - v[j]) != 0.0:
                pull += step * curve[:, j]
                v[j], most = new, max(most, abs(step) * np.sqrt(diagonal[j]))
        if most < 1e-9:
            break
        held = some[v[some] != 0]
        if sweep % 3 == 2 and len(held):
            own = curve[np.ix_(held, held)] + np.eye(len(held)) * (1e-10 * diagonal[held].max())
            d = np.linalg.solve(own, -(pull[held] + penalty * np.sign(v[held])))
            meets = np.where(v[held] * d < 0, -v[held] / np.where(d == 0, 1.0, d), np.inf)
            share = min(1.0, float(meets.min()))
            v[held] += share * d
            if share < 1.0:
                v[held[int(meets.argmin())]] = 0.0
            pull = slopes + curve @ (v - weights)
    return v


def fit(data: Rows, penalty: float, weights: np.ndarray, last: np.ndarray, before: float, tol: float = TOL) -> tuple[Fit, np.ndarray]:
    """(fit, slopes) from a start with these slopes, which was the fit of the penalty before."""
    held = weights.any(axis=0) | (np.abs(last) >= 2 * penalty - before).any(axis=0)
    active, passes = np.flatnonzero(held), 1
    now = sums(data, weights, active, min(1.0, penalty / max(np.abs(last).max(), 1e-300)))
    value = now.loss + penalty * np.abs(weights).sum()
    gap = value - now.dual
    for _ in range(STEPS):
        if gap <= tol and (np.abs(now.slopes) <= penalty * (1 + 1e-3) + tol).all():
            break
        target = weights.copy()
        if now.curves.ndim == 2:
            target[:, active] = descend(weights[:, active].ravel(), now.slopes[:, active].ravel(), now.curves, penalty).reshape(data.classes, -1)
        else:
            for c in range(data.classes):
                target[c, active] = descend(weights[c, active], now.slopes[c, active], now.curves[c], penalty)
        step = 1.0
        for _ in range(HALVES):
            trial = weights + step * (target - weights)
            # the residuals are taken as far as the slopes of the pass before allow
            at = sums(data, trial, active, shrink := min(1.0, penalty / max(np.abs(now.slopes).max(), 1e-300)))
            passes += 1
            if at.loss + penalty * np.abs(trial).sum() <= value + 1e-12:
                break
            step /= 2
        weights, now, value = trial, at, at.loss + penalty * np.abs(trial).sum()
        fits = min(1.0, penalty / max(np.abs(now.slopes).max(), 1e-300))
        if fits >= shrink:  # the dual point is within its bounds
            gap = value - now.dual
        elif fits > 0.5:
            checked = sums(data, weights, active, fits)
            passes += 1
            gap = value - checked.dual
        more = np.flatnonzero(((np.abs(now.slopes) > penalty).any(axis=0)) & ~held)
        if len(more):
            held[more] = True
            active = np.flatnonzero(held)
            now = sums(data, weights, active, fits)
            passes += 1
    return Fit(penalty, weights * data.scale, float(now.loss), float(max(gap, 0.0)), passes), now.slopes


def l1_path(data: Rows, path: list[float] | None = None, points: int = 20, tol: float = TOL) -> list[Fit]:
    """A fit a penalty, from the largest down; by default from the one that leaves no weight to a thousandth of it."""
    weights = np.zeros((data.classes, data.features))
    if not data.features:
        return []
    start = sums(data, weights, np.zeros(0, dtype=int))
    top = float(np.abs(start.slopes).max())
    slopes, before, out = start.slopes, top, []
    for penalty in sorted(path if path is not None else top * np.logspace(0, -3, points), reverse=True):
        if penalty >= top:
            out.append(Fit(float(penalty), weights.copy(), float(start.loss), 0.0, 0))
            continue
        found, slopes = fit(data, float(penalty), weights, slopes, before, tol)
        weights = np.where(data.scale == 0, 0.0, found.weights / np.where(data.scale == 0, 1.0, data.scale))
        before = float(penalty)
        out.append(found)
    return out


def held_out_loss(rows: DataFrame, fits: list[Fit]) -> list[float]:
    """The weighted mean log-loss of each fit on rows (class_idx, weight, feats), in one pass."""
    weights = [f.weights for f in fits]

    def task(batches):
        out = np.zeros(len(weights) + 1)
        for b in batches:
            if not b.num_rows:
                continue
            own, w, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            out[-1] += w.sum()
            for i, each in enumerate(weights):
                out[i] -= float(w @ _chances(x, each)[0][np.arange(len(own)), own])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([out], pa.list_(pa.float64()))], names=["part", "values"])

    values = _added(rows.select("class_idx", "weight", "feats"), task, "part", rows.rdd.getNumPartitions(), len(fits) + 1).get(0, np.zeros(len(fits) + 1))
    return (values[:-1] / values[-1]).tolist() if values[-1] else [0.0] * len(weights)

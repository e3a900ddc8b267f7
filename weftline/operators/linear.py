"""Linear models of margins by quasi-Newton steps over gradient sums: hinge, squared hinge and modified Huber loss, sparse rows.

All problems, one for each class and for each fold of a cross-validation, advance together: a step is one pass over the rows, which
gives each problem its loss at several step lengths and its gradient at the full one. The driver holds a few vectors of
features times problems; what the rows cost stays with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import forget, written
from .trees import Rows, aggregated, entries, scored

LOSSES = ("hinge", "squared_hinge", "modified_huber")
#: Widths by which the hinge is smoothed, one after another; its loss is at most half the last one off.
WIDTHS = (1.0, 0.1, 0.01, 1e-3, 1e-4)
#: Step lengths that are tried at once.
STEPS = 0.5 ** np.arange(12)


@dataclass(frozen=True)
class LinearConfig:
    """The mean weighted loss plus alpha / 2 times the squared length of the coefficients; the intercept isn't held down.

    c, if given, stands for alpha = 1 / (c * total weight), the other common form.
    """

    loss: str = "squared_hinge"
    alpha: float = 1e-4
    c: float | None = None
    intercept: bool = True
    rounds: int = 200
    tolerance: float = 1e-7
    memory: int = 10

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"unknown loss {self.loss}; known: {', '.join(LOSSES)}")


def loss_of(kind: str, width: float, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses of margins and their derivatives; the hinge is a parabola over `width` below 1."""
    if kind == "squared_hinge":
        d = np.maximum(1 - m, 0)
        return d * d, -2 * d
    if kind == "modified_huber":
        d = np.maximum(1 - m, 0)
        return np.where(m >= -1, d * d, -4 * m), np.where(m >= -1, -2 * d, -4.0)
    d = 1 - m
    return np.where(d <= 0, 0.0, np.where(d < width, d * d / (2 * width), d - width / 2)), np.where(d <= 0, 0.0, -np.minimum(d / width, 1.0))


class Linear:
    """Coefficients of the features in `names` (ascending) and intercepts, a column for each class; curves turn margins into shares."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, shifts: np.ndarray, curves: np.ndarray | None = None):
        self.names, self.weights, self.shifts, self.curves = names, weights, shifts, curves

    def margins(self, rows: Rows) -> np.ndarray:
        return margins(rows, self.names, self.weights) + self.shifts

    def probability(self, m: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(np.clip(self.curves[0] * m + self.curves[1], -500, 500)))
        total = p.sum(1, keepdims=True)
        return np.where(total > 0, p / np.where(total > 0, total, 1), 1 / p.shape[1])

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """df with prediction, the class of the highest margin (two classes: by its sign), ties to the smaller one, and margins, or probability once calibrated."""

        def score(model: Linear, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
            m = model.margins(rows)
            return np.round(m, 12).argmax(1).astype(float), m if model.curves is None else model.probability(m)

        return scored(df, features, self, score, "margins" if self.curves is None else "probability")


def margins(rows: Rows, names: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((rows.n, weights.shape[1]))
    if not len(names):
        return out
    at = np.minimum(np.searchsorted(names, rows.index), len(names) - 1)
    x = np.where(names[at] == rows.index, rows.value, 0.0)
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(rows.row, x * weights[at, k], rows.n)
    return out


class Problems:
    """The rows of all problems (class, fold): problem p is class p % classes without the fold p // classes - 1, or with all rows at first."""

    def __init__(self, rows: DataFrame, config: LinearConfig, folds: int):
        self.rows, self.config, self.folds = rows, config, folds
        self.names = np.sort(rows.select(F.explode("index").alias("f")).distinct().toArrow().column("f").to_numpy()).astype(np.int64)  # features
        self.classes = int((rows.agg(F.max("_y")).first()[0] or 0)) + 1
        self.count, self.size = self.classes * (folds + 1), len(self.names) + 1
        weights = {r["_fold"]: r["w"] for r in rows.groupBy("_fold").agg(F.sum("_w").alias("w")).collect()}  # folds
        total = sum(weights.values())
        self.total = np.repeat([total - (weights.get(f - 1, 0.0) if f else 0.0) for f in range(folds + 1)], self.classes)
        self.alpha = np.full(self.count, config.alpha) if config.c is None else 1 / (config.c * np.maximum(self.total, 1e-300))

    def evaluated(self, at: np.ndarray, direction: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """(loss sums at `at` + STEPS * direction, gradient sums at the full step) over the rows: steps x problems, size x problems."""
        shared = self.rows.sparkSession.sparkContext.broadcast((self.names, at, direction))  # features times problems
        kind, classes, count, folds, size, steps = self.config.loss, self.classes, self.count, self.folds, self.size, len(STEPS)

        def sums(batch: pa.RecordBatch) -> list[np.ndarray]:
            names, at, direction = shared.value
            r = Rows(batch)
            y, w, fold = (batch.column(c).to_numpy() for c in ("_y", "_w", "_fold"))
            sign = np.where(y[:, None] == np.arange(count) % classes, 1.0, -1.0)
            use = np.where(np.arange(count) // classes == fold[:, None] + 1, 0.0, w[:, None]) if folds else np.broadcast_to(w[:, None], sign.shape)
            start = sign * (margins(r, names, at[:-1]) + at[-1])
            along = sign * (margins(r, names, direction[:-1]) + direction[-1])
            total, slope = np.zeros((steps, count)), None
            for i, t in enumerate(STEPS):
                value, d = loss_of(kind, width, start + t * along)
                total[i] = (use * value).sum(0)
                slope = use * d * sign if i == 0 else slope
            gradient = np.zeros((size, count))
            place = np.searchsorted(names, r.index)
            for p in range(count):
                gradient[:-1, p] = np.bincount(place, r.value * slope[r.row, p], size - 1) if size > 1 else 0.0
            gradient[-1] = slope.sum(0)
            found = np.concatenate((total.ravel(), gradient.ravel()))
            own = np.flatnonzero(found)
            return [own, found[own]]

        found = aggregated(self.rows, sums, ("x",)).toArrow()  # features times problems
        out = np.zeros((steps + size) * count)
        out[found.column("code").to_numpy()] = found.column("x").to_numpy()
        return out[: steps * count].reshape(steps, count), out[steps * count :].reshape(size, count)

    def solved(self) -> np.ndarray:
        """Coefficients with the intercept last, a column for each problem."""
        x = np.zeros((self.size, self.count))
        for width in WIDTHS if self.config.loss == "hinge" else (0.0,):
            x = self._descended(x, width)
        return x

    def _full(self, x: np.ndarray, loss: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.vstack((x[:-1], np.zeros((1, self.count))))
        g = gradient / self.total + self.alpha * held
        if not self.config.intercept:
            g[-1] = 0
        return loss / self.total + self.alpha / 2 * (held * held).sum(0), g

    def _descended(self, x: np.ndarray, width: float) -> np.ndarray:
        """Limited-memory quasi-Newton steps, each problem with its own memory and step length."""
        losses, gradient = self.evaluated(x, np.zeros_like(x), width)
        f, g = self._full(x, losses[0], gradient)
        memory: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(self.count)]
        live = np.ones(self.count, bool)
        for _ in range(self.config.rounds):
            direction = np.stack([_turned(g[:, p], memory[p]) if live[p] else np.zeros(self.size) for p in range(self.count)], 1)
            losses, gradient = self.evaluated(x, direction, width)
            slope = (direction * g).sum(0)
            value = np.stack([self._full(x + t * direction, losses[i], gradient)[0] for i, t in enumerate(STEPS)])
            good = value <= f + 1e-4 * STEPS[:, None] * slope + 1e-15 * np.abs(f)
            step = np.where(good.any(0), good.argmax(0), -1)
            moved = np.where(step >= 0, STEPS[np.maximum(step, 0)], 0.0) * live
            following = x + moved * direction
            if (moved[live] != 1).any():  # some problem took a shorter step: its gradient is elsewhere
                losses, gradient = self.evaluated(following, np.zeros_like(x), width)
                now, slope_now = self._full(following, losses[0], gradient)
            else:
                now, slope_now = self._full(following, losses[0], gradient)
            for p in np.flatnonzero(live):
                s, d = following[:, p] - x[:, p], slope_now[:, p] - g[:, p]
                if s @ d > 1e-14 * (d @ d):
                    memory[p] = [*memory[p][1 - self.config.memory :], (s, d)]
                else:
                    memory[p] = []
                small = np.abs(slope_now[:, p]).max() < self.config.tolerance
                if small or step[p] < 0 or f[p] - now[p] <= self.config.tolerance * 1e-2 * max(abs(now[p]), 1e-12):
                    live[p] = False
            x, f, g = following, now, slope_now
            if not live.any():
                break
        return x

    def objective(self, x: np.ndarray) -> np.ndarray:
        """Each problem's objective with the loss as it is, not smoothed."""
        losses, gradient = self.evaluated(x, np.zeros_like(x), 1e-300)
        return self._full(x, losses[0], gradient)[0]


def _turned(g: np.ndarray, memory: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the gradient times what the memory says of the inverse curvature."""
    q, used = g.copy(), []
    for s, d in reversed(memory):
        r = 1 / (s @ d)
        a = r * (s @ q)
        q -= a * d
        used.append((r, a, s, d))
    if memory:
        s, d = memory[-1]
        q *= (s @ d) / (d @ d)
    else:
        q /= max(1.0, np.sqrt(g @ g))
    for r, a, s, d in reversed(used):
        q += (a - r * (d @ q)) * s
    return -q


def _source(train: DataFrame, features: str, label: str, weight: str | None, fold) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = train.withColumns({"_y": F.col(label).cast("double"), "_w": w, "_fold": fold.cast("long")}).where("_y IS NOT NULL AND NOT isnan(_y) AND _w > 0")
    return written(entries(rows, features, "_y", "_w", "_fold"), "linear-rows")


def fit_linear(train: DataFrame, config: LinearConfig, features: str = "features", label: str = "label", weight: str | None = None) -> Linear:
    """A model of classes 0, 1, .., one against the rest. Rows with a null label or without weight take no part."""
    rows = _source(train, features, label, weight, F.lit(-1))
    problems = Problems(rows, config, 0)
    x = problems.solved()
    forget(rows)
    return Linear(problems.names, x[:-1], x[-1])


def fit_calibrated(train: DataFrame, config: LinearConfig, key: str, folds: int = 3, features: str = "features", label: str = "label", weight: str | None = None) -> Linear:
    """A model whose margins become class shares: by a curve for each class, fitted to margins of models that haven't seen the row.

    Rows are dealt to folds by a hash of their key. The models of all folds and of all rows are fitted together, the curves from five sums a class
    and pass. Targets are drawn in a little, as a class of few rows calls for.
    """
    rows = _source(train, features, label, weight, F.pmod(F.xxhash64(F.col(key)), F.lit(folds)))
    problems = Problems(rows, config, folds)
    x = problems.solved()
    k, names = problems.classes, problems.names
    shared = train.sparkSession.sparkContext.broadcast(x)  # features times problems

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, fold, x = Rows(batch), batch.column("_fold").to_numpy(), shared.value
            m = (margins(r, names, x[:-1]) + x[-1]).reshape(r.n, -1, k)[np.arange(r.n), fold + 1]
            yield pa.RecordBatch.from_arrays([pa.array(list(m), pa.list_(pa.float64())), batch.column("_y")], names=["m", "y"])

    held = written(rows.mapInArrow(apart, "m array<double>, y double"), "linear-margins")
    curves = sigmoid_curves(held, k)
    forget(rows, held)
    return Linear(names, x[:-1, :k], x[-1, :k], curves)


def sigmoid_curves(held: DataFrame, classes: int, rounds: int = 100) -> np.ndarray:
    """(slopes, shifts) of 1 / (1 + exp(slope * margin + shift)) for each class, from rows (m, y), by Newton steps over sums."""
    counts = {int(r["y"]): r["n"] for r in held.groupBy("y").agg(F.count("*").alias("n")).collect()}  # classes
    total = sum(counts.values())
    yes = np.array([counts.get(k, 0) for k in range(classes)], float)
    high, low = (yes + 1) / (yes + 2), 1 / (total - yes + 2)
    a, b = np.zeros(classes), np.log((total - yes + 1) / (yes + 1))

    def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        def run(batch: pa.RecordBatch) -> list[np.ndarray]:
            m, y = batch.column("m").flatten().to_numpy().reshape(batch.num_rows, classes), batch.column("y").to_numpy()
            t = np.where(y[:, None] == np.arange(classes), high, low)
            z = a * m + b
            p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
            h = p * (1 - p)
            loss = t * z + np.logaddexp(0, -z)
            parts = [loss, (t - p) * m, t - p, h * m * m, h * m, h]
            return [np.arange(6 * classes), np.stack([x.sum(0) for x in parts]).ravel()]

        found = aggregated(held, run, ("x",)).toArrow()
        out = np.zeros(6 * classes)
        out[found.column("code").to_numpy()] = found.column("x").to_numpy()
        return out.reshape(6, classes)

    now = sums(a, b)
    for _ in range(rounds):
        _, ga, gb, aa, ab, bb = now
        aa, bb = aa + 1e-12, bb + 1e-12
        det = aa * bb - ab * ab
        da, db = -(bb * ga - ab * gb) / det, -(aa * gb - ab * ga) / det
        step, best = np.ones(classes), None
        for _ in range(30):
            best = sums(a + step * da, b + step * db)
            worse = best[0] > now[0] + 1e-4 * step * (ga * da + gb * db) + 1e-12 * np.abs(now[0])
            if not worse.any():
                break
            step = np.where(worse, step / 2, step)
        a, b = a + step * da, b + step * db
        done = np.maximum(np.abs(best[1]), np.abs(best[2])).max(initial=0) < 1e-8 * max(total, 1)
        now = best
        if done:
            break
    return np.stack((a, b))

"""Lockstep Newton trainers (T1, T4, M4, E7): logistic regression, squared-hinge linear SVM, sigmoid calibration.

All models of all cells of a fleet take their steps together, or, where a cell's rows stand in one partition, all steps of a cell are taken there. A pass sums loss, gradient and Hessian of every model
that is still open: (d + 1) squared numbers each. The driver solves the small systems; a step that does not lower the loss enough is
halved in the next pass. A model leaves when its Newton decrement is negligible.

Objectives are those of the common libraries: half the squared weights plus C times the summed loss. The logistic
intercept is free; the SVM's is penalised like a weight. The SVM's Hessian is that of the rows inside the margin, which
is Newton's method on the active set. Calibration fits P(1) = 1 / (1 + exp(-(a f + b))) to the margins of rows that the member
has not seen, with targets (n1 + 1) / (n1 + 2) and 1 / (n0 + 2).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from paritylab.plans.fleet import INNER, Cell, Fleet, add, columns_of, fold_accuracy, packed, scaled, summed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOGISTIC_C, SVM_C = 1.0, 0.8
#: Passes at most, and the Newton decrement (relative to the loss) at which a model is done.
PASSES, NEGLIGIBLE = 200, 1e-15
#: Rows whose products of features are held at a time.
OUTER_ROWS = 1024


def with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def expit(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def softplus(z: np.ndarray) -> np.ndarray:
    """log(1 + exp(z)) in vectorised steps."""
    return np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z)))


def logistic_terms(z: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, its derivative and curvature in the margin z, for labels (or targets) y."""
    p = expit(z)
    return (softplus(z) - y * z) * mask, (p - y) * mask, p * (1.0 - p) * mask


def hinge_terms(z: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sign = 2.0 * y - 1.0
    short = np.maximum(1.0 - sign * z, 0.0) * mask
    return short * short, -2.0 * sign * short, 2.0 * (short > 0)


def weighted_sums(x: np.ndarray, loss: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """A row for each model: loss, gradient, Hessian. ``x`` is rows x d, or rows x models x d."""
    d = x.shape[-1]
    if x.ndim == 2:
        gradient, hessian = slope.T @ x, np.zeros((bend.shape[1], d * d))
        for lo in range(0, len(x), OUTER_ROWS):  # a row's products are made once for all models
            some = np.ascontiguousarray(x[lo:lo + OUTER_ROWS])
            hessian += bend[lo:lo + OUTER_ROWS].T @ (some[:, :, None] * some[:, None, :]).reshape(len(some), d * d)
    else:
        gradient = np.stack([(slope * x[:, :, a]).sum(0) for a in range(d)], 1)
        hessian = np.stack([(bend * x[:, :, a] * x[:, :, b]).sum(0) for a in range(d) for b in range(d)], 1)
    return np.concatenate([loss.sum(0)[:, None], gradient, hessian.reshape(len(gradient), -1)], 1)


@dataclass
class Path:
    """The state of one model: the last accepted point with its loss, gradient and direction, and the point under trial."""

    trial: np.ndarray
    point: np.ndarray | None = None
    loss: float = np.inf
    slope: float = 0.0
    way: np.ndarray | None = None
    step: float = 1.0
    done: bool = False

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        if self.point is not None and not loss <= self.loss + 1e-4 * self.step * self.slope + 1e-13 * abs(self.loss):
            self.step /= 2
            self.trial = self.point + self.step * self.way
            self.done = self.step < 1e-12
            if self.done:
                self.trial = self.point
            return
        self.point, self.loss, self.step = self.trial, loss, 1.0
        flat = hessian + 1e-12 * np.trace(hessian) / len(hessian) * np.eye(len(hessian)) + 1e-300 * np.eye(len(hessian))
        self.way = -np.linalg.lstsq(flat, gradient, rcond=None)[0]
        self.slope = float(gradient @ self.way)
        self.trial = self.point + self.way
        self.done = -self.slope <= NEGLIGIBLE * (1.0 + abs(loss))


def minimise(fleet: Fleet, models: dict[int, list[int]], size: Callable[[int], int], names: list[str], terms: Callable, penalty: Callable, c: float) -> dict[int, dict[int, np.ndarray]]:
    """Coefficients of each cell's models. ``terms(cell, columns, models, coefficients)`` gives (x, loss, slope, bend); ``penalty(p)`` is 1 where
    a coefficient is penalised. Where every cell stands whole in one partition, its task takes all its steps, without a pass for each."""
    paths = {(cell, m): Path(np.zeros(size(cell))) for cell, own in models.items() for m in own}
    if fleet.whole:
        _descend_in_place(fleet, models, paths, names, terms, penalty, c)
    else:
        _descend(models, paths, lambda local: summed(fleet, names, local), terms, penalty, c)
    return {cell: {m: paths[cell, m].trial for m in own} for cell, own in models.items()}


def _descend_in_place(fleet: Fleet, models: dict[int, list[int]], paths: dict[tuple, Path], names: list[str], terms: Callable, penalty: Callable, c: float) -> None:
    key = {cm: i for i, cm in enumerate(paths)}

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for cell, columns in columns_of(b):
                held.setdefault(cell, []).append(columns)
        for cell, some in held.items():
            own = {(cell, m): paths[cell, m] for m in models.get(cell, [])}

            def total(local, some=some):
                sums: dict = {}
                for columns in some:
                    local(sums, cell, columns)
                return sums

            _descend({cell: models.get(cell, [])}, own, total, terms, penalty, c)
            yield from packed({key[cm]: path.trial for cm, path in own.items()})

    found = {r["key"]: np.frombuffer(r["data"], np.float64) for r in fleet.blocks.select("cell", "n", *names).mapInArrow(run, "key bigint, data binary").collect()}
    for cm, i in key.items():
        if i in found:
            paths[cm].trial = found[i]


def _descend(models: dict[int, list[int]], paths: dict[tuple, Path], total: Callable, terms: Callable, penalty: Callable, c: float) -> None:
    """Newton's steps until every model is done; ``total`` adds up a cell's sums over all of its rows."""
    for _ in range(PASSES):
        still = {cell: [m for m in own if not paths[cell, m].done] for cell, own in models.items()}
        sent = {cell: (own, np.stack([paths[cell, m].trial for m in own])) for cell, own in still.items() if own}
        if not sent:
            break

        def local(sums, cell, columns):
            if cell in sent:
                add(sums, cell, weighted_sums(*terms(cell, columns, *sent[cell])).ravel())

        for cell, data in total(local).items():
            own, trial = sent[cell]
            p = trial.shape[1]
            weight = penalty(p)
            for m, row in zip(own, data.reshape(len(own), -1)):
                b = paths[cell, m].trial
                paths[cell, m].take(0.5 * float(weight @ (b * b)) + c * row[0], weight * b + c * row[1:1 + p], np.diag(weight) + c * row[1 + p:].reshape(p, p))
        for cell, own in sent.items():  # a cell without rows
            for m in own[0]:
                if paths[cell, m].point is None:
                    paths[cell, m].done = True


def _free_intercept(p: int) -> np.ndarray:
    return np.append(np.ones(p - 1), 0.0)


@dataclass
class Linear:
    """A linear model on scaled rows: members are (weights with the intercept last, sigmoid (a, b) or None for a = 1, b = 0); P(1) is their mean."""

    cell: Cell
    members: list[tuple[np.ndarray, np.ndarray | None]]

    def probability(self) -> Column:
        """P(1) in built-in expressions."""
        z = [F.lit(0.0) if s <= 0 else (F.col(f"`{c}`").cast("double") - F.lit(float(m))) / F.lit(float(s))
             for c, m, s in zip(self.cell.features, self.cell.mean, self.cell.spread)]
        size = F.sqrt(_sum([v * v for v in z]))
        size = F.when(size > 0, size).otherwise(F.lit(1.0))
        out = []
        for w, sigmoid in self.members:
            margin = _sum([F.lit(float(a)) * v for a, v in zip(w, z)]) / size + F.lit(float(w[-1]))
            a, b = (1.0, 0.0) if sigmoid is None else map(float, sigmoid)
            out.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * margin + F.lit(b)))))
        return _sum(out) / F.lit(float(len(out)))


    def chances(self, x: np.ndarray) -> np.ndarray:
        """P(1) of rows of raw features."""
        own, out = with_one(scaled(x, self.cell.mean, self.cell.spread)), 0.0
        for w, sigmoid in self.members:
            a, b = (1.0, 0.0) if sigmoid is None else map(float, sigmoid)
            out = out + 1.0 / (1.0 + np.exp(-(a * (own @ w) + b)))
        return out / len(self.members)


def _sum(terms: list[Column]) -> Column:
    """A balanced sum, so that many terms make no deep expression."""
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def logistic_coefficients(fleet: Fleet, c: float = LOGISTIC_C) -> dict[int, dict[int, np.ndarray]]:
    """Weights, intercept last, of every cell's models."""
    def terms(cell, columns, own, coefficients):
        x = with_one(columns["x"])
        return (x, *logistic_terms(x @ coefficients.T, columns["y"][:, None], _left_out(columns, own)))

    models = {cell: fleet.models(cell) for cell in fleet.cells}
    return minimise(fleet, models, lambda cell: len(fleet.cells[cell].features) + 1, ["x", "y", "fold"], terms, _free_intercept, c)


def _left_out(columns: dict, models) -> np.ndarray:
    """1 where a row is outside the fold that a model leaves out."""
    return (columns["fold"][:, None] != np.array(models)).astype(float)


def optimality(fleet: Fleet, found: dict[int, dict[int, np.ndarray]], family: str) -> list[tuple[int, int, int, float]]:
    """(cell, model, training rows, largest entry of the objective's gradient) of logistic models or SVM members, from the scaled rows."""
    def local(sums, cell, columns):
        x, y = with_one(columns["x"]), columns["y"]
        for m, w in found[cell].items():
            z = x @ w
            if family == "logistic":
                mask = _left_out(columns, [m])[:, 0]
                pull = LOGISTIC_C * mask * (1 / (1 + np.exp(-z)) - y)
            else:
                mask = _left_out(columns, [m // INNER])[:, 0] * (columns["inner"] != m % INNER)
                pull = -2 * SVM_C * mask * (2 * y - 1) * np.maximum(1 - (2 * y - 1) * z, 0)
            add(sums, cell * 1_000 + m, np.append(pull @ x, mask.sum()))

    out = []
    for key, data in sorted(summed(fleet, ["x", "y", "fold", "inner"], local).items()):
        cell, m = divmod(key, 1_000)
        w = found[cell][m]
        weight = _free_intercept(len(w)) if family == "logistic" else np.ones(len(w))
        out.append((cell, m, int(data[-1]), float(np.abs(weight * w + data[:-1]).max())))
    return out


def fit_logistic(fleet: Fleet, c: float = LOGISTIC_C) -> dict[int, tuple[Linear, tuple[float, float]]]:
    """For every cell the model on all rows, and mean and spread of the cross-validated accuracy."""
    found, folds = logistic_coefficients(fleet, c), fleet.folds
    held = {cell: np.stack([own[m] for m in range(folds)]) for cell, own in found.items() if len(own) > 1}
    scores = fold_accuracy(fleet, ["x"], lambda cell, columns, m: with_one(columns["x"]) @ held[cell][m] > 0) if held else {}
    return {cell: (Linear(fleet.cells[cell], [(own[folds], None)]), scores.get(cell, (0.0, 0.0))) for cell, own in found.items()}


def svm_weights(fleet: Fleet, c: float = SVM_C) -> dict[int, dict[int, np.ndarray]]:
    """Weights, intercept last, of the SVM members: member j of model m, which is fitted without inner fold j, is number m * INNER + j."""
    def terms(cell, columns, own, coefficients):
        x = with_one(columns["x"])
        mask = _left_out(columns, np.array(own) // INNER) * ~_inside(columns, own)
        return (x, *hinge_terms(x @ coefficients.T, columns["y"][:, None], mask))

    models = {cell: [m * INNER + j for m in fleet.models(cell) for j in range(INNER)] for cell in fleet.cells}
    return minimise(fleet, models, lambda cell: len(fleet.cells[cell].features) + 1, ["x", "y", "fold", "inner"], terms, np.ones, c)


def _inside(columns: dict, members) -> np.ndarray:
    return columns["inner"][:, None] == np.array(members) % INNER


def fit_svm(fleet: Fleet, c: float = SVM_C) -> dict[int, tuple[Linear, tuple[float, float]]]:
    """Linear SVMs, each of INNER members fitted without an inner fold and calibrated on it; as ``fit_logistic``.
    All members of all models of all cells are fitted together."""
    folds, weights, names = fleet.folds, svm_weights(fleet, c), ["x", "y", "fold", "inner"]
    models = {cell: list(own) for cell, own in weights.items()}
    targets = {}
    for cell, own in models.items():
        for s in own:
            n0, n1 = (fleet.cells[cell].rows(y, lambda f, i: f != s // INNER and i == s % INNER) for y in (0.0, 1.0))
            targets[cell, s] = (1.0 / (n0 + 2.0), (n1 + 1.0) / (n1 + 2.0))

    def sigmoid_terms(cell, columns, own, coefficients):
        margin = with_one(columns["x"]) @ np.stack([weights[cell][s] for s in own]).T
        low, high = (np.array([targets[cell, s][k] for s in own]) for k in (0, 1))
        x = np.stack([margin, np.ones_like(margin)], 2)
        mask = _left_out(columns, np.array(own) // INNER) * _inside(columns, own)
        return (x, *logistic_terms(margin * coefficients[:, 0] + coefficients[:, 1], np.where(columns["y"][:, None] == 1, high, low), mask))

    sigmoids = minimise(fleet, models, lambda cell: 2, names, sigmoid_terms, np.zeros, 1.0)

    def classes(cell, columns, m):
        own = [m * INNER + j for j in range(INNER)]
        ab = np.stack([sigmoids[cell][s] for s in own])
        return expit((with_one(columns["x"]) @ np.stack([weights[cell][s] for s in own]).T) * ab[:, 0] + ab[:, 1]).mean(1) > 0.5

    scores = fold_accuracy(fleet, ["x"], classes) if folds else {}
    return {cell: (Linear(fleet.cells[cell], [(weights[cell][s], sigmoids[cell][s]) for s in own[-INNER:]]), scores.get(cell, (0.0, 0.0))) for cell, own in models.items()}

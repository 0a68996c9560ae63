"""Softmax classifiers: every step is one pass that sums a classes x features gradient."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.functions import vectors
from patchlight.functions.batches import MODEL_VALUES, carried, collect_matrix, rows_per_slice, shared, sum_rows
from patchlight.operators.sampling import position_blocks
from patchlight.operators.statistics import class_matrix, column_spread, moment_rows, row_width, squares_summary
from patchlight.solvers.linear import GRAM_WIDTH, LinearModel, class_count

BLOCK_LOG_OFFSET = 1e-10
# Fixed values of the backtracking rule: shrink factor and required share of descent.
SHRINK = 0.8
DESCENT = 0.4
MAX_TRIALS = 60


@dataclass(frozen=True, eq=False)
class Pass:
    """What one pass over the data yields at given weights."""

    rows: float
    loss: float
    gradient: np.ndarray


def softmax_pass(
    df: DataFrame,
    weights: np.ndarray,
    positions: np.ndarray | None = None,
    offset: float = vectors.LOG_OFFSET,
    column: str = "features",
    label: str = "label",
) -> Pass:
    """Row count, loss and (1/n) X^T (Y - P) as classes x features.

    With ``positions`` only those features' gradient is summed; the scores
    always use all features.
    """
    classes, width = weights.shape
    part = width if positions is None else len(positions)
    handle = shared(df.sparkSession, weights)

    def accumulate(data: list[np.ndarray]) -> np.ndarray:
        features, labels = data
        scores = features @ handle.value.T
        scores -= scores.max(axis=1, keepdims=True)
        chance = np.exp(scores)
        chance /= chance.sum(axis=1, keepdims=True)
        hot = class_matrix(labels, classes)
        own = features if positions is None else features[:, positions]
        total = np.zeros((classes + 1, max(part, 2)))
        total[:classes, :part] = (hot - chance).T @ own
        picked = chance[np.arange(len(labels)), labels.astype(np.int64)]
        total[classes, :2] = len(labels), -np.log(picked + offset).sum()
        return total

    rows = sum_rows(df, [carried(df, column), F.col(label).cast("int")], accumulate, classes + 1, max(part, 2))
    total = collect_matrix(rows, classes + 1, max(part, 2))
    handle.unpersist()
    n = total[classes, 0]
    if n == 0:
        raise ValueError("no rows to fit")
    return Pass(n, float(total[classes, 1]), total[:classes, :part] / n)


def finish(weights: np.ndarray) -> LinearModel:
    return LinearModel(weights.T.copy(), np.zeros(len(weights)))


@dataclass(frozen=True, eq=False)
class StackedPass:
    """What one pass yields for several weight matrices at once."""

    rows: float
    losses: np.ndarray
    gradients: np.ndarray


def stacked_pass(
    df: DataFrame, weights: np.ndarray, shift: np.ndarray | None = None, column: str = "features", label: str = "label"
) -> StackedPass:
    """Mean losses and gradients (1/n) X^T (Y - P) of settings x classes x features weights, all from one scan.

    With ``shift`` the features are taken less it and followed by a one, whose weight
    is the last: the intercept. Beyond MODEL_VALUES weights the settings go in
    several scans, as many in each as fit.
    """
    settings, classes, inputs = weights.shape
    fit = max(1, (MODEL_VALUES // max(inputs, settings + 1) - 1) // classes)
    if settings > fit:
        parts = [stacked_pass(df, weights[k : k + fit], shift, column, label) for k in range(0, settings, fit)]
        return StackedPass(parts[0].rows, np.concatenate([p.losses for p in parts]), np.concatenate([p.gradients for p in parts]))
    handle = shared(df.sparkSession, weights.reshape(settings * classes, inputs))
    height, step = settings * classes, rows_per_slice(3 * settings * classes + inputs)

    def accumulate(data: list[np.ndarray]) -> np.ndarray:
        total = np.zeros((height + 1, max(inputs, settings + 1)))
        for begin in range(0, len(data[0]), step):
            own, labels = data[0][begin : begin + step], data[1][begin : begin + step].astype(np.int64)
            if shift is not None:
                own = np.concatenate([own - shift, np.ones((len(own), 1))], axis=1)
            hot = class_matrix(labels, classes)
            scores = (own @ handle.value.T).reshape(len(own), settings, classes)
            scores -= scores.max(axis=2, keepdims=True)
            chance = np.exp(scores)
            mass = chance.sum(axis=2, keepdims=True)
            picked = scores[np.arange(len(own)), :, labels] - np.log(mass[:, :, 0])
            chance /= mass
            rest = (hot[:, None, :] - chance).reshape(len(own), height)
            total[:height, :inputs] += rest.T @ own
            total[height, 0] += len(own)
            total[height, 1 : settings + 1] -= picked.sum(axis=0)
        return total

    width = max(inputs, settings + 1)
    sums = sum_rows(df, [carried(df, column), F.col(label).cast("int")], accumulate, height + 1, width)
    total = collect_matrix(sums, height + 1, width)
    handle.unpersist()
    n = total[height, 0]
    if n == 0:
        raise ValueError("no rows to fit")
    return StackedPass(n, total[height, 1 : settings + 1] / n, total[:height, :inputs].reshape(settings, classes, inputs) / n)


def softmax_newton(
    df: DataFrame, multiplier: float = 1e-2, iterations: int = 50, classes: int | None = None,
    column: str = "features", label: str = "label",
) -> LinearModel:
    """Fixed-Hessian steps: G = X^T X / n + lam I once, then w += G^-1 (gradient - lam w)."""
    return softmax_newton_sweep(df, [multiplier], iterations, classes, column, label)[0]


def softmax_newton_sweep(
    df: DataFrame, multipliers: Sequence[float], iterations: int = 50, classes: int | None = None, column: str = "features", label: str = "label"
) -> list[LinearModel]:
    """The same fit for every multiplier: one Gram matrix, and one scan a step for all of them together."""
    width = row_width(df, column)
    if width > GRAM_WIDTH:
        raise ValueError(f"{width} features: use softmax_block_newton beyond {GRAM_WIDTH}")
    classes = classes or class_count(df, label)
    moments = collect_matrix(moment_rows(df, width, column), width + 1, width + 1)
    gram = moments[1:, 1:] / moments[0, 0]
    lams = [m * np.trace(gram) / width for m in multipliers]
    inverses = [np.linalg.inv(gram + lam * np.eye(width)) for lam in lams]
    weights = np.zeros((len(lams), classes, width))
    for _ in range(iterations):
        at = stacked_pass(df, weights, column=column, label=label)
        weights = np.stack([w + (g - lam * w) @ inverse for w, g, lam, inverse in zip(weights, at.gradients, lams, inverses, strict=True)])
    return [finish(w) for w in weights]


def softmax_descent(
    df: DataFrame,
    lam: float = 1e-2,
    iterations: int = 100,
    step: Callable[[int], float] | str = lambda k: 1e-4,
    classes: int | None = None,
    column: str = "features",
    label: str = "label",
    trace: list[float] | None = None,
) -> LinearModel:
    """Gradient descent with a step rule, or ``step="backtrack"`` for a line search.

    ``trace`` collects the loss before each step.
    """
    width = row_width(df, column)
    classes = classes or class_count(df, label)
    weights = np.zeros((classes, width))
    for k in range(iterations):
        here = softmax_pass(df, weights, column=column, label=label)
        if trace is not None:
            trace.append(here.loss)
        direction = here.gradient - lam * weights
        if callable(step):
            size = step(k)
        else:
            size = backtrack(
                lambda sizes: line_losses(df, weights, direction, sizes, lam, column, label), penalised(here, weights, lam), direction
            )
        weights = weights + size * direction
    return finish(weights)


def penalised(at: Pass, weights: np.ndarray, lam: float) -> float:
    return at.loss / at.rows + 0.5 * lam * float((weights**2).sum())


def line_losses(
    df: DataFrame, weights: np.ndarray, direction: np.ndarray, sizes: np.ndarray, lam: float, column: str = "features", label: str = "label"
) -> np.ndarray:
    """The penalised loss at weights + size * direction for every size, in one pass: scores are linear in the size."""
    handle = shared(df.sparkSession, weights, direction)

    def accumulate(data: list[np.ndarray]) -> np.ndarray:
        features, labels = data
        at, along = (features @ w.T for w in handle.value)
        rows, own = np.arange(len(labels)), labels.astype(np.int64)
        class_matrix(labels, at.shape[1])  # labels must be classes
        total = np.zeros((1, len(sizes) + 1))
        total[0, -1] = len(labels)
        for k, size in enumerate(sizes):
            scores = at + size * along
            scores -= scores.max(axis=1, keepdims=True)
            chance = np.exp(scores)
            total[0, k] = -np.log(chance[rows, own] / chance.sum(axis=1) + vectors.LOG_OFFSET).sum()
        return total

    sums = sum_rows(df, [carried(df, column), F.col(label).cast("int")], accumulate, 1, len(sizes) + 1)
    total = collect_matrix(sums, 1, len(sizes) + 1)[0]
    handle.unpersist()
    penalty = [0.5 * lam * float(((weights + s * direction) ** 2).sum()) for s in sizes]
    return total[:-1] / max(total[-1], 1) + np.array(penalty)


def backtrack(
    objectives: Callable[[np.ndarray], np.ndarray], here: float, direction: np.ndarray,
    shrink: float = SHRINK, descent: float = DESCENT, start: float = 1.0,
) -> float:
    """The largest start * shrink^k that lowers the objective enough, all candidates in one pass.

    ``direction`` is minus the gradient. The accepted size itself is returned. If
    rounding hides any descent, the weights are as good as they get and a zero
    direction says so; a direction along which no size helps is an error.
    """
    slope = -float((direction**2).sum())
    if slope == 0.0:
        return start
    sizes = start * shrink ** np.arange(MAX_TRIALS)
    enough = np.flatnonzero(objectives(sizes) <= here + descent * sizes * slope + 1e-14 * abs(here))
    if not len(enough):
        raise RuntimeError(f"no step down to {sizes[-1]:.1e} lowers the loss enough")
    return float(sizes[enough[0]])


def softmax_block_newton(
    df: DataFrame, multiplier: float = 1e-2, iterations: int = 10, block: int = 4000, epochs: int = 1, seed: int = 0,
    classes: int | None = None, column: str = "features", label: str = "label",
) -> LinearModel:
    """Newton steps on one shuffled block of features at a time; lam = multiplier * mean(X^2)."""
    width = row_width(df, column)
    classes = classes or class_count(df, label)
    summary = squares_summary(df, column).first()
    lam = multiplier * summary["squares"] / (summary["n"] * width)
    weights = np.zeros((classes, width))
    for epoch in range(epochs):
        for positions in position_blocks(width, block, seed + epoch):
            chosen = np.array(positions)
            moments = sum_rows(df, [carried(df, column)], block_gram(chosen), len(chosen), len(chosen))
            gram = collect_matrix(moments, len(chosen), len(chosen)) / summary["n"]
            inverse = np.linalg.inv(gram + lam * np.eye(len(chosen)))
            for _ in range(iterations):
                step = softmax_pass(df, weights, chosen, BLOCK_LOG_OFFSET, column, label)
                weights = weights.copy()
                weights[:, chosen] += (step.gradient - lam * weights[:, chosen]) @ inverse
    return finish(weights)


def block_gram(positions: np.ndarray) -> Callable[[list[np.ndarray]], np.ndarray]:
    def accumulate(data: list[np.ndarray]) -> np.ndarray:
        own = data[0][:, positions]
        return own.T @ own

    return accumulate


def softmax_loss(df: DataFrame, model: LinearModel, column: str = "features", label: str = "label") -> float:
    """Mean loss of a fitted model, in one pass."""
    at = softmax_pass(df, model.weights.T, column=column, label=label)
    return at.loss / at.rows


# Fixed values of the quasi-Newton fit: steps remembered, share of the descent that a step must bring, bounds of a shorter step.
MEMORY = 10
ENOUGH = 1e-4
SHORTEST, SHORTER = 0.1, 0.5


@dataclass(eq=False)
class QuasiNewton:
    """One setting of a limited-memory fit: where it stands and what its last steps say about the curvature."""

    penalty: np.ndarray
    scale: np.ndarray
    at: np.ndarray
    loss: float = np.inf
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    size: float = 0.0
    steps: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    settled: bool = False

    def trial(self) -> np.ndarray:
        return self.at if self.direction is None else self.at + self.size * self.direction

    def see(self, mean_loss: float, rise: np.ndarray, tolerance: float) -> None:
        """Take the loss and the gradient (of the log-likelihood) at the trial point: go there, or try a shorter step."""
        there = self.trial()
        loss = mean_loss + 0.5 * float((self.penalty * there**2).sum())
        gradient = self.penalty * there - rise
        if self.direction is not None:
            slope = float((self.gradient * self.direction).sum())
            if loss > self.loss + ENOUGH * self.size * slope + 1e-14 * abs(self.loss):
                # The parabola through both losses and the slope, kept within bounds.
                bend = loss - self.loss - self.size * slope
                self.size *= min(max(-0.5 * slope * self.size / bend, SHORTEST), SHORTER)
                self.settled = self.size < 1e-12
                return
            moved, turned = there - self.at, gradient - self.gradient
            if (moved * turned).sum() > 1e-12 * np.sqrt((moved**2).sum() * (turned**2).sum()):
                self.steps = [*self.steps[1 - MEMORY :], (moved, turned)]
        self.at, self.loss, self.gradient = there, loss, gradient
        self.settled = bool(np.abs(gradient * np.sqrt(self.scale)).max() <= tolerance)
        self.direction, self.size = -self.bent(gradient), 1.0

    def bent(self, gradient: np.ndarray) -> np.ndarray:
        """The gradient times the inverse curvature that the remembered steps imply (two loops over them)."""
        q, shares = gradient.copy(), []
        for moved, turned in reversed(self.steps):
            share = (moved * q).sum() / (moved * turned).sum()
            q -= share * turned
            shares.append(share)
        q = q * self.scale
        if self.steps:
            moved, turned = self.steps[-1]
            q *= (moved * turned).sum() / (turned * self.scale * turned).sum()
        for (moved, turned), share in zip(self.steps, reversed(shares), strict=True):
            q += (share - (turned * q).sum() / (moved * turned).sum()) * moved
        return q


def softmax_quasi_newton(
    df: DataFrame, regs: Sequence[float], iterations: int = 100, tolerance: float = 1e-8, classes: int | None = None,
    column: str = "features", label: str = "label",
) -> list[LinearModel]:
    """Minimise mean log loss + reg/2 |w|^2 over all classes together, for every reg: limited-memory quasi-Newton steps.

    The intercept is not penalised. A step is one scan for all settings, which yields
    the loss and the gradient at every trial point; settings that have settled (no
    entry of the gradient beyond ``tolerance``, for features of spread one) leave it. Features are centred in the
    tasks and the first curvature is that of their spreads, so features of unlike size
    do no harm. A setting that has not settled after ``iterations`` scans is reported.
    """
    width = row_width(df, column)
    classes = classes or class_count(df, label)
    mean, spread = column_spread(df, width, column)
    fits = []
    for reg in regs:
        penalty = np.append(np.full(width, float(reg)), 0.0)
        curvature = np.append(0.25 * spread**2, 0.25) + penalty
        fits.append(QuasiNewton(penalty, 1.0 / np.where(curvature > 0, curvature, 1.0), np.zeros((classes, width + 1))))
    for _ in range(iterations):
        going = [fit for fit in fits if not fit.settled]
        if not going:
            break
        seen = stacked_pass(df, np.stack([fit.trial() for fit in going]), mean, column, label)
        for fit, loss, rise in zip(going, seen.losses, seen.gradients, strict=True):
            fit.see(float(loss), rise, tolerance)
    late = [reg for reg, fit in zip(regs, fits, strict=True) if not fit.settled]
    if late:
        warnings.warn(f"the fit has not settled in {iterations} steps for the weights {late}", stacklevel=2)
    return [LinearModel(fit.at[:, :-1].T.copy(), fit.at[:, -1] - fit.at[:, :-1] @ mean) for fit in fits]


LOSSES = ("log", "log_rest", "hinge")


def fit_named_loss(
    df: DataFrame, loss: str, reg: float, iterations: int = 100, column: str = "features", label: str = "label"
) -> LinearModel:
    """Linear classifier by loss name: "log" (all classes together), "log_rest" or "hinge" (each class against the rest)."""
    return named_loss_sweep(df, loss, [reg], iterations, None, column, label)[0]


def named_loss_sweep(
    df: DataFrame, loss: str, regs: Sequence[float], iterations: int = 100, classes: int | None = None, column: str = "features", label: str = "label"
) -> list[LinearModel]:
    """The same classifier for every weight, with one scan a step for all of them."""
    if loss not in LOSSES:
        raise ValueError(f"loss {loss} is none of {LOSSES}")
    if loss == "log":
        return softmax_quasi_newton(df, regs, iterations, classes=classes, column=column, label=label)
    return rest_descent(df, loss, regs, iterations, classes, column, label)


# How hard a row pulls at its side of a class, by its margin.
PULLS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "hinge": lambda margin: (margin < 1.0).astype(float),
    "log_rest": lambda margin: 1.0 / (1.0 + np.exp(np.minimum(margin, 700.0))),
}


def rest_descent(
    df: DataFrame, loss: str, regs: Sequence[float], iterations: int = 100, classes: int | None = None, column: str = "features", label: str = "label"
) -> list[LinearModel]:
    """Steps of size 1 / (k + 1) down the mean loss of all classes against their rest, plus reg/2 |w|^2, for every reg.

    A step is one pass for all classes and settings together, and nothing is kept between passes.
    """
    width = row_width(df, column)
    classes = classes or class_count(df, label)
    height = len(regs) * classes
    penalty = np.repeat(np.array(regs, float), classes)[:, None]
    weights = np.zeros((height, width))
    for k in range(iterations):
        handle = shared(df.sparkSession, weights)

        def accumulate(data: list[np.ndarray], handle=handle) -> np.ndarray:
            sides = np.tile(class_matrix(data[1], classes, -1.0), (1, len(regs)))
            pull = sides * PULLS[loss](sides * (data[0] @ handle.value.T))
            return np.concatenate([pull.T @ data[0], np.full((height, 1), float(len(data[0])))], axis=1)

        sums = sum_rows(df, [carried(df, column), F.col(label).cast("int")], accumulate, height, width + 1)
        total = collect_matrix(sums, height, width + 1)
        handle.unpersist()
        if total[0, -1] == 0:
            raise ValueError("no rows to fit")
        weights = weights + (total[:, :-1] / total[0, -1] - penalty * weights) / (k + 1)
    return [finish(w) for w in weights.reshape(len(regs), classes, width)]

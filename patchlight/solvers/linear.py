"""Ridge classifiers from distributed Gram matrices.

Features and indicator labels are centred; the intercept is recovered from the
means. A fit with few features takes one pass: the Gram matrix comes to the
driver and everything else, including block passes and every ridge weight of a
sweep, is algebra on it. A fit with many features goes block by block and
never holds more than one block's Gram matrix anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight.functions import vectors
from patchlight.functions.batches import MODEL_VALUES, VECTOR, carried, collect_matrix, map_vectors, shared, sum_rows
from patchlight.operators.statistics import REG_MODES, class_matrix, provisional_mean, row_width, scaled_ridge, tile_pairs

# Widest feature vector whose whole Gram matrix is formed at once.
GRAM_WIDTH = 4096
# When block descent without a number of passes has settled, and passes after which it is an error if it has not.
TOLERANCE = 1e-9
MOST_PASSES = 2000


@dataclass(frozen=True, eq=False)
class LinearModel:
    """scores = x @ weights + intercept."""

    weights: np.ndarray
    intercept: np.ndarray

    def transform(self, df: DataFrame, column: str = "features", out: str = "scores") -> DataFrame:
        """Scores of every row in place of its features. ``solvers.parts`` scores with models too large to broadcast."""
        handle = shared(df.sparkSession, self.weights, self.intercept)

        def build():
            weights, intercept = handle.value
            return lambda rows: rows @ weights + intercept

        return map_vectors(df, column, build, out=out, doubles_per_row=2 * self.weights.shape[1]).select(
            *[c for c in df.columns if c not in (column, out)], out
        )

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (i, row): one per feature, and the intercept as row -1."""
        schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("row", VECTOR)])
        rows = [(i, row.tolist()) for i, row in enumerate(self.weights)]
        return spark.createDataFrame([*rows, (-1, self.intercept.tolist())], schema)

    @staticmethod
    def from_table(table: DataFrame) -> "LinearModel":
        rows = table.toPandas().sort_values("i")
        matrix = np.stack(rows["row"])
        return LinearModel(matrix[1:], matrix[0])


@dataclass(frozen=True, eq=False)
class Moments:
    """Weighted sums of one pass: total weight, means, centred X^T X and X^T Y."""

    weight: float
    mean: np.ndarray
    target: np.ndarray
    gram: np.ndarray
    cross: np.ndarray


def class_counts(df: DataFrame, label: str = "label") -> dict[int, int]:
    return {row["label"]: row["count"] for row in df.groupBy(F.col(label).alias("label")).count().collect()}


def class_count(df: DataFrame, label: str = "label") -> int:
    top = df.agg(F.max(label).alias("m")).first()["m"]
    if top is None:
        raise ValueError("the table has no labels")
    return int(top) + 1


def class_weights(counts: dict[int, int], classes: int, mixture: float) -> np.ndarray:
    """Row weight by class: (1 - w) + w * n / (K * n_class); w = 0 weighs all rows alike."""
    if not 0.0 <= mixture <= 1.0:
        raise ValueError("the mixture weight lies in 0..1")
    n = sum(counts.values())
    present = np.array([max(counts.get(c, 0), 1) for c in range(classes)], dtype=np.float64)
    return (1.0 - mixture) + mixture * n / (classes * present)


def fit_moments(
    df: DataFrame,
    width: int,
    classes: int,
    weights: np.ndarray | None = None,
    negative: float = -1.0,
    column: str = "features",
    label: str = "label",
) -> Moments:
    """All sums a ridge fit needs, in one pass and one small shuffle.

    They are taken around a provisional mean, so features far from zero lose no digits.
    """
    per_class = np.ones(classes) if weights is None else weights
    shift = provisional_mean(df, width, column)

    def accumulate(data: list[np.ndarray]) -> np.ndarray:
        features, labels = data[0] - shift, data[1]
        left = np.concatenate([np.ones((len(features), 1)), features], axis=1)
        right = np.concatenate([left, class_matrix(labels, classes, negative)], axis=1)
        return (left * per_class[labels.astype(np.int64)][:, None]).T @ right

    rows = sum_rows(df, [carried(df, column), F.col(label).cast("int")], accumulate, width + 1, width + 1 + classes)
    sums = collect_matrix(rows, width + 1, width + 1 + classes)
    weight = sums[0, 0]
    if weight == 0:
        raise ValueError("no rows to fit")
    mean = sums[0, 1 : width + 1] / weight
    target = sums[0, width + 1 :] / weight
    gram = sums[1:, 1 : width + 1] - weight * np.outer(mean, mean)
    cross = sums[1:, width + 1 :] - weight * np.outer(mean, target)
    return Moments(weight, mean + shift, target, gram, cross)


def block_starts(width: int, block: int | None) -> list[tuple[int, int]]:
    size = block or width
    return [(start, min(start + size, width)) for start in range(0, width, size)]


def solve_moments(moments: Moments, lam: float, block: int | None = None, passes: int = 1) -> LinearModel:
    """Block coordinate descent on the normal equations; one block is the exact solution."""
    width, classes = moments.cross.shape
    weights = np.zeros((width, classes))
    blocks = block_starts(width, block)
    for _ in range(passes if len(blocks) > 1 else 1):
        for low, high in blocks:
            own = moments.gram[low:high, low:high]
            residual = moments.cross[low:high] - moments.gram[low:high] @ weights + own @ weights[low:high]
            weights[low:high] = np.linalg.solve(own + lam * np.eye(high - low), residual)
    return LinearModel(weights, moments.target - moments.mean @ weights)


def fit_ridge(
    df: DataFrame,
    lam: float,
    classes: int | None = None,
    block: int | None = None,
    passes: int = 1,
    mixture: float = 0.0,
    negative: float = -1.0,
    reg_mode: str = "absolute",
    column: str = "features",
    label: str = "label",
    gram_width: int = GRAM_WIDTH,
) -> LinearModel:
    """Ridge on indicator labels, or class-weighted ridge if ``mixture`` > 0.

    Without ``block`` the fit is the ridge solution at any width: up to
    ``gram_width`` features from one Gram matrix, beyond by block descent that goes
    on until a whole pass changes no weight by more than TOLERANCE of the largest.
    With ``block`` it is ``passes`` passes of block descent, at any width.
    """
    if reg_mode not in REG_MODES:
        raise ValueError(f"reg mode {reg_mode} is none of {REG_MODES}")
    width = row_width(df, column)
    classes = classes or class_count(df, label)
    weights = class_weights(class_counts(df, label), classes, mixture) if mixture else None
    if width <= gram_width:
        moments = fit_moments(df, width, classes, weights, negative, column, label)
        if reg_mode != "absolute" and weights is None:
            # The sum of squares is the trace of the uncentred Gram matrix.
            squares = np.trace(moments.gram) + moments.weight * float(moments.mean @ moments.mean)
            lam *= squares / (width if reg_mode == "trace_over_d" else moments.weight)
        else:
            lam = scaled_ridge(df, lam, reg_mode, column)
        return solve_moments(moments, lam, block, passes)
    lam = scaled_ridge(df, lam, reg_mode, column)
    return fit_blockwise(df, width, classes, lam, block or gram_width, passes if block else None, weights, negative, column, label)


def fit_blockwise(
    df: DataFrame,
    width: int,
    classes: int,
    lam: float,
    block: int,
    passes: int | None,
    weights: np.ndarray | None,
    negative: float,
    column: str,
    label: str,
) -> LinearModel:
    """The same descent for wide features: several blocks of a pass in one scan.

    A scan forms the residual of all features, and for as many neighbouring blocks as
    the driver can hold the products with it and the Gram tiles of all pairs of them.
    The blocks are then solved one after another: what the first changes in the
    products of the next is its tile times the change. Without ``passes`` it goes on
    until it has settled.

    The residual is recomputed from the current weights inside the scan, so no
    residual table is written and no lineage grows from pass to pass.
    """
    per_class = np.ones(classes) if weights is None else weights
    inputs = [carried(df, column), F.col(label).cast("int")]

    def head(data: list[np.ndarray]) -> np.ndarray:
        features, labels = data
        weight = per_class[labels.astype(np.int64)][None, :]
        return weight @ np.concatenate(
            [np.ones((len(features), 1)), features, class_matrix(labels, classes, negative)], axis=1
        )

    sums = collect_matrix(sum_rows(df, inputs, head, 1, 1 + width + classes), 1, 1 + width + classes)[0]
    mean, target = sums[1 : width + 1] / sums[0], sums[width + 1 :] / sums[0]
    solution = np.zeros((width, classes))
    spark = df.sparkSession
    starts = block_starts(width, block)
    size = min(block, width)
    many = max((m for m in range(1, len(starts) + 1) if group_height(m, size, classes) * size <= MODEL_VALUES), default=1)
    for _ in range(MOST_PASSES if passes is None else passes):
        before = solution
        for at in range(0, len(starts), many):
            group = starts[at : at + many]
            pairs, height = tile_pairs(len(group)), group_height(len(group), size, classes)
            current = shared(spark, solution)

            def accumulate(data: list[np.ndarray], group=group, pairs=pairs, height=height, current=current) -> np.ndarray:
                features, labels = data[0] - mean, data[1]
                weight = per_class[labels.astype(np.int64)][:, None]
                residual = (class_matrix(labels, classes, negative) - target - features @ current.value) * weight
                total = np.zeros((height, size))
                own = [features[:, low:high] for low, high in group]
                for t, (i, j) in enumerate(pairs):
                    total[t * size : t * size + own[i].shape[1], : own[j].shape[1]] = (own[i] * weight).T @ own[j]
                for i, part in enumerate(own):
                    row = len(pairs) * size + i * classes
                    total[row : row + classes, : part.shape[1]] = residual.T @ part
                return total

            part = collect_matrix(sum_rows(df, inputs, accumulate, height, size), height, size)
            current.unpersist()
            wide = [high - low for low, high in group]
            tiles = {pair: part[t * size : t * size + wide[pair[0]], : wide[pair[1]]] for t, pair in enumerate(pairs)}
            solution, changes = solution.copy(), []
            for j, (low, high) in enumerate(group):
                row = len(pairs) * size + j * classes
                right = part[row : row + classes, : wide[j]].T
                for i, change in enumerate(changes):
                    right = right - tiles[i, j].T @ change
                gram, old = tiles[j, j], solution[low:high].copy()
                solution[low:high] = np.linalg.solve(gram + lam * np.eye(wide[j]), right + gram @ old)
                changes.append(solution[low:high] - old)
        if passes is None and np.abs(solution - before).max() <= TOLERANCE * np.abs(solution).max():
            break
    else:
        if passes is None:
            raise RuntimeError(f"block descent did not settle in {MOST_PASSES} passes; use a larger gram_width")
    return LinearModel(solution, target - mean @ solution)


def group_height(blocks: int, size: int, classes: int) -> int:
    """Rows, each as wide as a block, of the tiles of some blocks and of their products with the residual."""
    return len(tile_pairs(blocks)) * size + blocks * classes


def ridge_sweep(
    df: DataFrame,
    lams: Sequence[float],
    classes: int | None = None,
    mixture: float = 0.0,
    negative: float = -1.0,
    column: str = "features",
    label: str = "label",
) -> dict[float, LinearModel]:
    """One model per ridge weight from a single pass over the data."""
    width = row_width(df, column)
    if width > GRAM_WIDTH:
        return {lam: fit_ridge(df, lam, classes, mixture=mixture, negative=negative, column=column, label=label) for lam in lams}
    classes = classes or class_count(df, label)
    weights = class_weights(class_counts(df, label), classes, mixture) if mixture else None
    moments = fit_moments(df, width, classes, weights, negative, column, label)
    return {lam: solve_moments(moments, lam) for lam in lams}


def dual_coefficients(
    df: DataFrame, model: LinearModel, lam: float, negative: float = -1.0, column: str = "features", label: str = "label"
) -> DataFrame:
    """Adds ``alpha`` = (y - prediction) / lam, the dual solution of the same ridge problem.

    The n x n kernel matrix is never formed: for lam > 0 both problems have the
    same minimiser, and the dual one is this row-local function of the primal.
    """
    if lam <= 0:
        raise ValueError("the dual form needs a positive ridge weight")
    classes = model.weights.shape[1]
    handle = shared(df.sparkSession, model.weights, model.intercept)

    def build():
        weights, intercept = handle.value
        return lambda rows: rows @ weights + intercept

    scored = map_vectors(df.withColumn("__x", F.col(column)), "__x", build, out="__scores", doubles_per_row=2 * classes)
    hot = vectors.indicator(F.col(label), classes, negative)
    return scored.withColumn("alpha", F.zip_with(hot, "__scores", lambda y, s: (y - s) / F.lit(float(lam)))).drop(
        "__scores", "__x"
    )


def normal_residual(
    df: DataFrame, model: LinearModel, lam: float, negative: float = -1.0, mixture: float = 0.0,
    column: str = "features", label: str = "label",
) -> float:
    """Largest entry of X^T W (Y - XW) - lam W, over the largest entry of X^T W Y."""
    width, classes = model.weights.shape
    weights = class_weights(class_counts(df, label), classes, mixture) if mixture else None
    moments = fit_moments(df, width, classes, weights, negative, column, label)
    gap = moments.cross - moments.gram @ model.weights - lam * model.weights
    return float(np.abs(gap).max() / max(np.abs(moments.cross).max(), 1e-300))



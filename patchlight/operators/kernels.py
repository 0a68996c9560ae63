"""Kernel matrices against a sample of anchor rows, and what they tell about features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight import seeded
from patchlight.functions import vectors
from patchlight.functions.batches import VECTOR, carried, collect_matrix, from_matrix, map_vectors, sum_rows, to_matrix
from patchlight.layout import Shape
from patchlight.operators.sampling import pair_members, sample_rows

WEIGHT = 1.414
SMALLEST_NORM = 1e-16


def anchor_rows(df: DataFrame, key: str, m: int, seed: int, column: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of m sampled rows, ordered by key; m bounds what reaches the driver."""
    rows = sample_rows(df.select(key, carried(df, column).alias(column)), key, m, seed).toArrow().sort_by(key)
    return rows.column(key).to_numpy(), to_matrix(rows.column(column).combine_chunks())


def gaussian_kernel(rows: np.ndarray, anchors: np.ndarray, sigma: float) -> np.ndarray:
    squares = (rows**2).sum(axis=1)[:, None] + (anchors**2).sum(axis=1)[None, :] - 2.0 * rows @ anchors.T
    return np.exp(-np.maximum(squares, 0.0) / (2.0 * sigma**2))


def kernel_rows(
    df: DataFrame, anchors: np.ndarray, sigma: float | None = None, column: str = "features", out: str = "kernel"
) -> DataFrame:
    """k(x, anchor) for every row and anchor: linear, or Gaussian if ``sigma`` is given."""

    def build():
        if sigma is None:
            return lambda rows: rows @ anchors.T
        return lambda rows: gaussian_kernel(rows, anchors, sigma)

    return map_vectors(df, column, build, out=out, doubles_per_row=2 * len(anchors))


def kernel_error(
    df: DataFrame, anchors: np.ndarray, bank: np.ndarray, phase: np.ndarray, sigma: float = 1.0, column: str = "features"
) -> DataFrame:
    """Mean and largest gap between cosine-feature products and the Gaussian kernel.

    One row (pairs, mean_error, max_error) over all rows against all anchors.
    """

    def build():
        def lift(rows: np.ndarray) -> np.ndarray:
            return np.sqrt(2.0 / len(bank)) * np.cos(rows @ bank.T + phase)

        lifted = lift(anchors)

        def errors(rows: np.ndarray) -> np.ndarray:
            gap = np.abs(lift(rows) @ lifted.T - gaussian_kernel(rows, anchors, sigma))
            return np.stack([gap.sum(axis=1), gap.max(axis=1)], axis=1)

        return errors

    rows = map_vectors(df, column, build, out="gap", keep=[], doubles_per_row=2 * len(bank))
    pairs = F.count("*") * F.lit(len(anchors))
    return rows.agg(
        pairs.alias("pairs"),
        (F.sum(F.get("gap", F.lit(0))) / pairs).alias("mean_error"),
        F.max(F.get("gap", F.lit(1))).alias("max_error"),
    )


def dual_scores(
    train: DataFrame, test: DataFrame, width: int, classes: int, column: str = "features", dual: str = "alpha"
) -> DataFrame:
    """Predictions of a linear dual model: sum over training rows of alpha * k(train, test).

    The kernel is linear, so the sum is (X^T alpha)^T x: one pass over the
    training rows and a row-local product, with no train x test matrix.
    """
    def accumulate(data: list[np.ndarray]) -> np.ndarray:
        return data[1].T @ data[0]

    rows = sum_rows(train, [carried(train, column), carried(train, dual)], accumulate, classes, width)
    weights = collect_matrix(rows, classes, width)
    return map_vectors(test, column, lambda: lambda block: block @ weights.T, out="scores")


def pair_distances(df: DataFrame, key: str, m: int, seed: int, column: str = "features") -> DataFrame:
    """Distance of the two unit-scaled vectors of m random pairs: rows (draw, left_key, right_key, distance)."""
    members = pair_members(df, key, m, seed)
    norm = F.greatest(F.sqrt(vectors.sum_squares(F.col(column))), F.lit(SMALLEST_NORM))
    # 2m members: the table is read once and only their vectors are shuffled.
    picked = (
        df.select(F.col(key).alias("key"), F.col(column).cast(VECTOR).alias(column))
        .join(F.broadcast(members), "key")
        .select("draw", "right", "key", vectors.divided(F.col(column), norm).alias("u"))
    )
    return distances_of(picked)


def distances_of(picked: DataFrame) -> DataFrame:
    """Rows (draw, left_key, right_key, distance) from the two members (draw, right, key, u) of each draw."""
    side = {name: F.col("right") == flag for name, flag in (("left", False), ("right", True))}
    both = picked.groupBy("draw").agg(
        *[F.max(F.when(test, F.col("key"))).alias(f"{name}_key") for name, test in side.items()],
        *[F.max(F.when(test, F.col("u"))).alias(f"u_{name}") for name, test in side.items()],
    )
    gap = F.zip_with("u_left", "u_right", lambda a, b: a - b)
    return both.select("draw", "left_key", "right_key", F.sqrt(vectors.sum_squares(gap)).alias("distance"))


def patch_pair_distances(images: DataFrame, shape: Shape, patch: int, m: int, seed: int) -> DataFrame:
    """The same for pairs of patches: both images and the place in each are drawn with replacement.

    Only the draws and, of the images they hit, the drawn patches move.
    """
    members = pair_members(images, "image_id", m, seed)
    across = shape.width - patch + 1
    places = across * (shape.height - patch + 1)
    hit = images.select(F.col("image_id").alias("key"), carried(images, "pixels").alias("pixels")).join(F.broadcast(members), "key")
    schema = "draw bigint, right boolean, key bigint, u array<double>"
    dx, dy = np.arange(patch), np.arange(patch)[:, None]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            draw, right = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("draw", "right"))
            drawn = [seeded.mixed(draw, np.int64(2), seed, stream) for stream in (seeded.PICK_LEFT, seeded.PICK_RIGHT)]
            place = np.where(right, drawn[1], drawn[0]) % places
            x0, y0 = (place % across)[:, None, None], (place // across)[:, None, None]
            cube = to_matrix(batch.column("pixels")).reshape(-1, shape.height, shape.width, shape.channels)
            rows = cube[np.arange(len(cube))[:, None, None], y0 + dy, x0 + dx].reshape(len(cube), -1)
            rows /= np.maximum(np.linalg.norm(rows, axis=1), SMALLEST_NORM)[:, None]
            arrays = [batch.column("draw"), batch.column("right"), batch.column("key").cast(pa.int64()), from_matrix(rows)]
            yield pa.RecordBatch.from_arrays(arrays, names=["draw", "right", "key", "u"])

    return distances_of(hit.select("draw", "right", "key", "pixels").mapInArrow(cut, schema))


def learn_gamma_patches(images: DataFrame, shape: Shape, patch: int, m: int = 3000, seed: int = 0, weight: float = WEIGHT) -> DataFrame:
    """One row (median_distance, gamma) from pairs of patches."""
    return gamma_of(patch_pair_distances(images, shape, patch, m, seed), weight)


def learn_gamma(df: DataFrame, key: str, m: int = 3000, seed: int = 0, column: str = "features", weight: float = WEIGHT) -> DataFrame:
    """One row (median_distance, gamma) with gamma = 1 / (median / weight)^2."""
    return gamma_of(pair_distances(df, key, m, seed, column), weight)


def gamma_of(distances: DataFrame, weight: float) -> DataFrame:
    median = distances.agg(F.percentile("distance", F.lit(0.5)).alias("median_distance"))
    return median.withColumn("gamma", 1.0 / F.pow(F.col("median_distance") / F.lit(weight), F.lit(2.0)))

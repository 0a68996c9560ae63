"""ZCA whitening fitted from distributed moments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight.functions import vectors
from patchlight.functions.batches import VECTOR, collect_matrix, map_vectors
from patchlight.layout import Shape
from patchlight.operators.sampling import sample_patches
from patchlight.operators.statistics import mean_and_covariance, moment_rows, patch_moment_rows, provisional_mean, provisional_patch_mean, row_width

EPSILON = 0.1
MAX_WIDTH = 4096
# Fixed value: share of the mean variance added before the Cholesky root.
JITTER = 1e-10

MODEL = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("matrix", VECTOR),
        T.StructField("covariance", VECTOR),
    ]
)


@dataclass(frozen=True, eq=False)
class Whitener:
    """(x - mean) @ matrix. Keeps the covariance, from which filters can be shaped."""

    mean: np.ndarray
    matrix: np.ndarray
    covariance: np.ndarray

    def apply(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.mean) @ self.matrix

    def covariance_root(self) -> np.ndarray:
        width = len(self.mean)
        jitter = JITTER * np.trace(self.covariance) / width
        return np.linalg.cholesky(self.covariance + jitter * np.eye(width))

    def transform(self, df: DataFrame, column: str = "features", out: str | None = None) -> DataFrame:
        return map_vectors(df, column, lambda: self.apply, out=out)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, float(self.mean[i]), self.matrix[i].tolist(), self.covariance[i].tolist())
            for i in range(len(self.mean))
        ]
        return spark.createDataFrame(rows, MODEL)

    @staticmethod
    def from_table(table: DataFrame) -> "Whitener":
        check_width(table.count())
        rows = table.toPandas().sort_values("i")
        return Whitener(rows["mean"].to_numpy(), np.stack(rows["matrix"]), np.stack(rows["covariance"]))


def whitener_from_moments(moments: np.ndarray, epsilon: float = EPSILON, shift: np.ndarray | float = 0.0) -> Whitener:
    """W = V diag((lambda + epsilon)^-1/2) V^T of the covariance; ``shift`` is what the moments were taken around."""
    _, mean, covariance = mean_and_covariance(moments)
    values, basis = np.linalg.eigh(covariance)
    scale = 1.0 / np.sqrt(np.maximum(values, 0.0) + epsilon)
    return Whitener(mean + shift, (basis * scale) @ basis.T, covariance)


def check_width(width: int) -> None:
    if width > MAX_WIDTH:
        raise ValueError(f"whitening {width} inputs needs a {width} x {width} decomposition; at most {MAX_WIDTH}")


def fit_whitener(df: DataFrame, column: str = "features", epsilon: float = EPSILON) -> Whitener:
    width = row_width(df, column)
    check_width(width)
    shift = provisional_mean(df, width, column)
    return whitener_from_moments(collect_matrix(moment_rows(df, width, column, shift), width + 1, width + 1), epsilon, shift)


def fit_patch_whitener(
    images: DataFrame, shape: Shape, patch: int, epsilon: float = EPSILON, sample: int | None = None, seed: int = 0
) -> Whitener:
    """Fit on all patches, or on exactly ``sample`` of them."""
    inputs = patch * patch * shape.channels
    check_width(inputs)
    shift = provisional_patch_mean(images, shape, patch)
    if sample is None:
        rows = patch_moment_rows(images, shape, patch, shift)
    else:
        rows = moment_rows(sample_patches(images, shape, patch, sample, seed), inputs, "patch", shift)
    return whitener_from_moments(collect_matrix(rows, inputs + 1, inputs + 1), epsilon, shift)


def contrast_normalized(images: DataFrame) -> DataFrame:
    return images.withColumn("pixels", vectors.contrast_normalize(F.col("pixels")))


def fit_image_whitener(train: DataFrame, epsilon: float = EPSILON) -> Whitener:
    """Whitener of whole images after contrast normalisation."""
    return fit_whitener(contrast_normalized(train), "pixels", epsilon)


def whiten_images(images: DataFrame, whitener: Whitener) -> DataFrame:
    """Contrast-normalise, then whiten whole images."""
    return whitener.transform(contrast_normalized(images), "pixels")

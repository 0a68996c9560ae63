"""Cutting images into patches, as rows or as matrices inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from patchlight.functions.batches import BATCH_DOUBLES, VECTOR, carried, from_matrix, rows_per_slice, to_matrix
from patchlight.layout import Shape


def origins(length: int, patch: int, stride: int, pad: bool) -> tuple[int, int, int]:
    """First origin, last origin and step of the patches along one side.

    Padded patches start at -(patch//2) and there is one per pixel at stride 1,
    so an even patch reaches one pixel less on the far side.
    """
    first = -(patch // 2) if pad else 0
    count = length if pad else length - patch + 1
    if count < 1:
        raise ValueError(f"patch {patch} does not fit in {length} pixels")
    return first, first + count - 1, stride


def patch_cube(images: np.ndarray, shape: Shape, patch: int, stride: int = 1, pad: bool = False) -> np.ndarray:
    """(n, d) images to (n, rows, columns, patch*patch*channels) patches."""
    cube = images.reshape(-1, shape.height, shape.width, shape.channels)
    if pad:
        before = patch // 2
        after = patch - 1 - before
        cube = np.pad(cube, ((0, 0), (before, after), (before, after), (0, 0)))
    windows = np.lib.stride_tricks.sliding_window_view(cube, (patch, patch), axis=(1, 2))[:, ::stride, ::stride]
    return windows.transpose(0, 1, 2, 4, 5, 3).reshape(*windows.shape[:3], -1)


def patch_doubles(shape: Shape, patch: int, stride: int = 1, pad: bool = False) -> int:
    """Values in the patch matrix of one image."""
    out = shape.convolved(patch, 1, stride, pad)
    return out.size * patch * patch * shape.channels


def cut_patches(
    images: np.ndarray, shape: Shape, patch: int, stride: int = 1, pad: bool = False, budget: int = BATCH_DOUBLES // 8
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(image number, x0, y0, patches) of all patches, at most ``budget`` values (or one row of patches) at a time.

    The windows are views; only the part that is handed out is copied.
    """
    first_y, _, _ = origins(shape.height, patch, stride, pad)
    first_x, _, _ = origins(shape.width, patch, stride, pad)
    cube = images.reshape(-1, shape.height, shape.width, shape.channels)
    inputs = patch * patch * shape.channels
    after = patch - 1 - patch // 2
    for start, stop in slices(len(cube), rows_per_slice(shape.size, budget)):
        part = cube[start:stop]
        if pad:
            part = np.pad(part, ((0, 0), (patch // 2, after), (patch // 2, after), (0, 0)))
        views = np.lib.stride_tricks.sliding_window_view(part, (patch, patch), axis=(1, 2))[:, ::stride, ::stride]
        count, rows, columns = views.shape[:3]
        bands = min(rows, rows_per_slice(columns * inputs, budget))
        step = rows_per_slice(rows * columns * inputs, budget) if bands == rows else 1
        for low, high in slices(count, step):
            for top, bottom in slices(rows, bands):
                block = views[low:high, top:bottom].transpose(0, 1, 2, 4, 5, 3).reshape(-1, inputs)
                number, y, x = np.indices((high - low, bottom - top, columns), np.int32).reshape(3, -1)
                yield number + (start + low), first_x + x * stride, first_y + (y + top) * stride, block


def slices(length: int, step: int) -> Iterator[tuple[int, int]]:
    for start in range(0, length, step):
        yield start, min(start + step, length)


def extract_patches(images: DataFrame, shape: Shape, patch: int, stride: int = 1, pad: bool = False) -> DataFrame:
    """One row (keys, x0, y0, patch) per patch; row-local, nothing is shuffled.

    Pixels outside a padded image are zeros and count as pixels. Patches leave a
    task in batches of bounded size; the pixels of an image are in none of them.
    """
    origins(shape.height, patch, stride, pad), origins(shape.width, patch, stride, pad)
    keep = [c for c in images.columns if c not in ("pixels", "x0", "y0", "patch")]
    source = images.select(*keep, carried(images, "pixels").alias("pixels"))
    places = [T.StructField("x0", T.IntegerType()), T.StructField("y0", T.IntegerType())]
    schema = T.StructType([*(source.schema[c] for c in keep), *places, T.StructField("patch", VECTOR)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.select(keep)
            for number, x0, y0, block in cut_patches(to_matrix(batch.column(len(keep))), shape, patch, stride, pad):
                held = keys.take(pa.array(number))
                arrays = [*held.columns, pa.array(x0.astype(np.int32)), pa.array(y0.astype(np.int32)), from_matrix(block)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(cut, schema)


def windows(images: DataFrame, shape: Shape, size: int, stride: int) -> DataFrame:
    """Every window of an image as an image of its own, keyed by its origin."""
    return extract_patches(images, shape, size, stride).withColumnRenamed("patch", "pixels")

"""Pooling. Linear pools are one small matrix per image side, others are column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight.functions import vectors
from patchlight.functions.batches import BATCH_DOUBLES, VECTOR, from_matrix, map_vectors, rows_per_slice
from patchlight.layout import Shape

# A linear pool is a pair of matrices (rows, columns), each output x input.
Sides = tuple[np.ndarray, np.ndarray]


def window_side(length: int, pool: int, stride: int, start: int | None = None, decay: float = 0.0) -> np.ndarray:
    """Weights of one side: windows centred at start, start+stride, ... below length.

    An even pool covers [centre - pool/2, centre + pool/2), an odd one is
    centred. Windows are clipped to the image. The weight of a pixel at
    distance t from the centre is exp(-decay * t^2).
    """
    start = pool // 2 if start is None else start
    centres = np.arange(start, length, stride)[:, None]
    at = np.arange(length)[None, :]
    half = pool // 2
    inside = (at >= centres - half) & (at < centres + half + pool % 2)
    return inside * np.exp(-decay * (at - centres) ** 2.0)


def mean_sides(shape: Shape, pool: int, stride: int) -> Sides:
    """Mean pool that always divides by pool^2, also where a window is clipped."""
    return (
        window_side(shape.height, pool, stride) / pool,
        window_side(shape.width, pool, stride) / pool,
    )


def gaussian_sides(shape: Shape, pool: int, stride: int, coefficient: float = 0.5) -> Sides:
    """Sum over the window of exp(-coefficient * d^2 / sigma^2), sigma = pool / sqrt 2."""
    decay = coefficient / (pool * pool / 2.0)
    return (
        window_side(shape.height, pool, stride, decay=decay),
        window_side(shape.width, pool, stride, decay=decay),
    )


def blur_side(length: int, pool: int) -> np.ndarray:
    """Gaussian blur, sigma = pool / sqrt 2, cut at 4 sigma, mirrored borders, every pool-th output."""
    sigma = pool / np.sqrt(2.0)
    radius = int(4.0 * sigma + 0.5)
    offsets = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * offsets**2 / sigma**2)
    weights /= weights.sum()
    side = np.zeros((length, length))
    for centre in range(length):
        source = (centre + offsets) % (2 * length)
        source = np.where(source < length, source, 2 * length - 1 - source)
        np.add.at(side[centre], source, weights)
    return side[::pool]


def blur_sides(shape: Shape, pool: int) -> Sides:
    return blur_side(shape.height, pool), blur_side(shape.width, pool)


def resize_side(length: int, target: int, method: str) -> np.ndarray:
    """Resampling weights with pixel centres aligned; borders repeat."""
    at = (np.arange(target) + 0.5) * length / target - 0.5
    side = np.zeros((target, length))
    rows = np.arange(target)
    if method == "nearest":
        side[rows, np.clip(np.floor(at + 0.5), 0, length - 1).astype(int)] = 1.0
        return side
    if method != "bilinear":
        raise ValueError(f"unknown resize method {method}")
    low = np.floor(at)
    share = at - low
    np.add.at(side, (rows, np.clip(low, 0, length - 1).astype(int)), 1.0 - share)
    np.add.at(side, (rows, np.clip(low + 1, 0, length - 1).astype(int)), share)
    return side


def resize_sides(shape: Shape, width: int, height: int, method: str = "bilinear") -> Sides:
    return resize_side(shape.height, height, method), resize_side(shape.width, width, method)


def pool_cube(cube: np.ndarray, sides: Sides) -> np.ndarray:
    """(n, height, width, channels) to (n, rows, columns, channels)."""
    rows, columns = sides
    n, height, width, channels = cube.shape
    narrow = np.matmul(rows, cube.reshape(n, height, width * channels)).reshape(n * len(rows), width, channels)
    return np.matmul(columns, narrow).reshape(n, len(rows), len(columns), channels)


def apply_sides(images: DataFrame, shape: Shape, sides: Sides) -> DataFrame:
    """Run a linear pool, blur or resize over an image table."""

    def build() -> Callable[[np.ndarray], np.ndarray]:
        def apply(pixels: np.ndarray) -> np.ndarray:
            cube = pixels.reshape(-1, shape.height, shape.width, shape.channels)
            return pool_cube(cube, sides).reshape(len(pixels), -1)

        return apply

    return map_vectors(images, "pixels", build, doubles_per_row=3 * shape.size)


def resize_each(images: DataFrame, width: int, height: int, method: str = "bilinear") -> DataFrame:
    """Images of mixed size, as rows with ``width``, ``height``, ``n_channels`` and ``pixels``, forced to one size.

    Rows of one size in a batch are resampled together; rows without pixels keep a
    null. The size columns take the new size. Rows may change their order in a task.
    """
    others = [c for c in images.columns if c not in ("width", "height", "n_channels", "pixels")]
    source = images.select(*others, *(F.col(c).cast("int").alias(c) for c in ("width", "height", "n_channels")), "pixels")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("pixels", VECTOR)])

    def resize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[tuple[int, int], Sides] = {}
        for batch in batches:
            sizes = np.stack([batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("width", "height", "n_channels")], axis=1)
            blank = batch.column("pixels").is_null().to_numpy(zero_copy_only=False)
            if blank.any():
                none = batch.take(pa.array(np.flatnonzero(blank)))
                nulls = pa.nulls(none.num_rows, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*none.columns[:-1], nulls], names=schema.names)
            for w, h, c in np.unique(sizes[~blank], axis=0).tolist():
                if (w, h) not in sides:
                    sides[w, h] = resize_sides(Shape(w, h, 1), width, height, method)
                rows = np.flatnonzero(~blank & (sizes == (w, h, c)).all(axis=1))
                step = rows_per_slice((3 * w * h + width * height) * c, BATCH_DOUBLES)
                for begin in range(0, len(rows), step):
                    some = batch.take(pa.array(rows[begin : begin + step]))
                    cube = np.asarray(some.column("pixels").flatten(), dtype=np.float64).reshape(-1, h, w, c)
                    made = pool_cube(cube, sides[w, h]).reshape(len(cube), -1)
                    named = [pa.array(np.full(len(cube), size, np.int32)) for size in (width, height)]
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns[: len(others)], *named, some.column("n_channels"), from_matrix(made)], names=schema.names
                    )

    return source.mapInArrow(resize, schema)


def mean_pool(images: DataFrame, shape: Shape, pool: int, stride: int) -> DataFrame:
    if pool == 1 and stride == 1:
        return images
    return apply_sides(images, shape, mean_sides(shape, pool, stride))


def gaussian_pool(images: DataFrame, shape: Shape, pool: int, stride: int, coefficient: float = 0.5) -> DataFrame:
    return apply_sides(images, shape, gaussian_sides(shape, pool, stride, coefficient))


def gaussian_blur_pool(images: DataFrame, shape: Shape, pool: int) -> DataFrame:
    """Blur, then keep every pool-th pixel of both sides."""
    return apply_sides(images, shape, blur_sides(shape, pool))


def resize(images: DataFrame, shape: Shape, width: int, height: int, method: str = "bilinear") -> DataFrame:
    """Forced resize: the aspect ratio is not kept."""
    return apply_sides(images, shape, resize_sides(shape, width, height, method))


# Reducers over the zero-filled window of a general pool.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": vectors.total,
    "mean": lambda v: vectors.total(v) / F.size(v),
    "max": F.array_max,
    "min": F.array_min,
    "l2": lambda v: F.sqrt(vectors.sum_squares(v)),
}


# The same on the last axis of a block.
BLOCK_REDUCERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "mean": lambda v: v.mean(axis=-1),
    "max": lambda v: v.max(axis=-1),
    "min": lambda v: v.min(axis=-1),
    "sum": lambda v: v.sum(axis=-1),
    "l2": lambda v: np.sqrt((v * v).sum(axis=-1)),
}


def window_reducer(shape: Shape, pool: int, stride: int, first: int, start: int, reducer: str) -> Callable[[np.ndarray], np.ndarray]:
    """Windows from ``first`` on, one for each centre start, start + stride, ... inside the image, filled up with zeros."""
    reduce = BLOCK_REDUCERS[reducer]
    nx, ny = (len(range(start, side, stride)) for side in (shape.width, shape.height))
    after = [max(0, first + (n - 1) * stride + pool - side) for n, side in ((ny, shape.height), (nx, shape.width))]

    def apply(pixels: np.ndarray) -> np.ndarray:
        cube = np.pad(pixels.reshape(-1, shape.height, shape.width, shape.channels), ((0, 0), (0, after[0]), (0, after[1]), (0, 0)))
        views = np.lib.stride_tricks.sliding_window_view(cube, (pool, pool), axis=(1, 2))[:, first::stride, first::stride][:, :ny, :nx]
        return reduce(views.reshape(*views.shape[:4], pool * pool)).reshape(len(pixels), -1)

    return apply


def general_pool(
    images: DataFrame,
    shape: Shape,
    pool: int,
    stride: int,
    reducer: str | Callable[[Column], Column] = "mean",
    pixel: Callable[[Column], Column] | None = None,
    start: int | None = None,
    centred: bool = True,
) -> DataFrame:
    """Pool with any pixel function and any reducer of the pool*pool values.

    Both functions map columns to columns. Cells of a window that fall outside
    the image enter the reducer as zeros. Row-local: no shuffle. A named reducer
    without a pixel function runs on whole blocks of images; the user's own
    functions are column expressions.
    """
    start = (pool // 2 if centred else 0) if start is None else start
    half = pool // 2 if centred else 0
    if isinstance(reducer, str) and pixel is None and start >= half:
        return map_vectors(images, "pixels", lambda: window_reducer(shape, pool, stride, start - half, start, reducer), doubles_per_row=(2 + pool * pool) * shape.size)
    reduce = REDUCERS[reducer] if isinstance(reducer, str) else reducer
    pixel = pixel or (lambda v: v)
    nx = len(range(start, shape.width, stride))
    ny = len(range(start, shape.height, stride))
    channels = shape.channels

    def cell(pixels: Column, out: Column) -> Column:
        c = out % channels
        x0 = (F.floor(out / channels).cast("int") % nx) * stride + (start - half)
        y0 = F.floor(out / (channels * nx)).cast("int") * stride + (start - half)

        def value(q: Column) -> Column:
            x = x0 + q % pool
            y = y0 + F.floor(q / pool).cast("int")
            inside = (x >= 0) & (x < shape.width) & (y >= 0) & (y < shape.height)
            found = pixel(F.get(pixels, c + (x + y * shape.width) * channels))
            return F.when(inside, found).otherwise(F.lit(0.0))

        return reduce(F.transform(F.sequence(F.lit(0), F.lit(pool * pool - 1)), value))

    cells = F.sequence(F.lit(0), F.lit(nx * ny * channels - 1))
    pooled = vectors.let(F.col("pixels"), lambda pixels: F.transform(cells, lambda out: cell(pixels, out)))
    return images.withColumn("pixels", pooled)


def block_pool(
    images: DataFrame, shape: Shape, pool: int, reducer: str | Callable[[Column], Column] = "mean"
) -> DataFrame:
    """Non-overlapping pool x pool blocks; a ragged edge is filled with zeros."""
    return general_pool(images, shape, pool, pool, reducer, centred=False)


def rectify_pool(
    images: DataFrame, shape: Shape, pool: int, stride: int, max_val: float = 0.0, alpha: float = 0.0
) -> DataFrame:
    """Symmetric rectifier and sum pool in one pass; windows start at stride//2."""
    sides = (
        window_side(shape.height, pool, stride, start=stride // 2),
        window_side(shape.width, pool, stride, start=stride // 2),
    )

    def build() -> Callable[[np.ndarray], np.ndarray]:
        def apply(pixels: np.ndarray) -> np.ndarray:
            cube = pixels.reshape(-1, shape.height, shape.width, shape.channels)
            both = np.concatenate([cube - alpha, -cube - alpha], axis=3)
            return pool_cube(np.maximum(both, max_val, out=both), sides).reshape(len(pixels), -1)

        return apply

    return map_vectors(images, "pixels", build, doubles_per_row=5 * shape.size)

"""Sums, moments and Gram matrices of feature tables.

Everything here is one pass: each task folds its rows into a matrix of model
size, and only those matrices are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from patchlight.functions import vectors
from patchlight.functions.batches import carried, collect_matrix, map_vectors, rows_per_slice, sum_rows, to_matrix
from patchlight.layout import Shape, long_rows
from patchlight.operators.patches import patch_cube, patch_doubles


def row_width(df: DataFrame, column: str = "features") -> int:
    """Length of the vectors, from one row."""
    first = df.select(F.size(column).alias("d")).first()
    if first is None:
        raise ValueError("the table is empty, so its vector length is unknown")
    return first["d"]


def vector_sum(df: DataFrame, column: str = "features") -> DataFrame:
    """Sum of all vectors as rows (pos, total)."""
    return long_rows(df, [], column, "pos").groupBy("pos").agg(F.sum("v").alias("total"))


def vector_means(df: DataFrame, column: str = "features") -> DataFrame:
    """Mean by position as rows (pos, mean)."""
    return long_rows(df, [], column, "pos").groupBy("pos").agg(F.avg("v").alias("mean"))


def grand_mean(df: DataFrame, column: str = "features") -> DataFrame:
    """Mean over all rows and positions."""
    rows = df.select(vectors.total(F.col(column)).alias("s"), F.size(column).alias("n"))
    return rows.agg((F.sum("s") / F.sum("n")).alias("grand_mean"))


def row_norm_mean(df: DataFrame, column: str = "features") -> DataFrame:
    return df.agg(F.avg(F.sqrt(vectors.sum_squares(F.col(column)))).alias("norm_mean"))


REG_MODES = ("absolute", "trace_over_d", "trace_over_n")


def squares_summary(df: DataFrame, column: str = "features") -> DataFrame:
    """One row (n, d, squares): the counts and the sum of all squares."""
    return df.select(vectors.sum_squares(F.col(column)).alias("q"), F.size(column).alias("d")).agg(
        F.count("*").alias("n"), F.max("d").alias("d"), F.sum("q").alias("squares")
    )


def ridge_scale(summary: DataFrame, reg: Column, mode: Column) -> DataFrame:
    """Add ``lam``: the ridge weight that ``reg`` means in each mode."""
    lam = (
        F.when(mode == "absolute", reg)
        .when(mode == "trace_over_d", reg * F.col("squares") / F.col("d"))
        .when(mode == "trace_over_n", reg * F.col("squares") / F.col("n"))
    )
    return summary.withColumn("lam", lam)


def scaled_ridge(df: DataFrame, reg: float, mode: str = "absolute", column: str = "features") -> float:
    if mode not in REG_MODES:
        raise ValueError(f"reg mode {mode} is none of {REG_MODES}")
    if mode == "absolute":
        return float(reg)
    row = ridge_scale(squares_summary(df, column), F.lit(float(reg)), F.lit(mode)).first()
    return row["lam"]


# Rows whose mean is the provisional one.
SHIFT_ROWS = 64


def provisional_mean(df: DataFrame, width: int, column: str = "features") -> np.ndarray:
    """Mean of some rows: a point near the data to take sums around. Any point gives the same moments but for rounding."""
    rows = df.select(carried(df, column).alias("v")).where(F.col("v").isNotNull()).limit(SHIFT_ROWS).toArrow()
    if rows.num_rows == 0:
        return np.zeros(width)
    mean = to_matrix(rows.column("v").combine_chunks()).mean(axis=0)
    # Data around zero, whole numbers among them, are summed as they are.
    return np.where(np.abs(mean) > 1e3, mean, 0.0)


def moment_rows(df: DataFrame, width: int, column: str = "features", shift: np.ndarray | None = None) -> DataFrame:
    """Rows (i, row) of [1 X]^T [1 X]: the count, the sums and the Gram matrix, of the vectors less ``shift``."""

    def accumulate(data: list[np.ndarray]) -> np.ndarray:
        rows = data[0] if shift is None else data[0] - shift
        block = np.concatenate([np.ones((len(rows), 1)), rows], axis=1)
        return block.T @ block

    return sum_rows(df, [carried(df, column)], accumulate, width + 1, width + 1)


def provisional_patch_mean(images: DataFrame, shape: Shape, patch: int) -> np.ndarray:
    """A provisional mean for patches: the channel means of some images."""
    mean = provisional_mean(images, shape.size, "pixels")
    return np.tile(mean.reshape(-1, shape.channels).mean(axis=0), patch * patch)


def patch_moment_rows(images: DataFrame, shape: Shape, patch: int, shift: np.ndarray | None = None) -> DataFrame:
    """``moment_rows`` over all patches of all images, without making patch rows."""
    inputs = patch * patch * shape.channels
    step = rows_per_slice(2 * patch_doubles(shape, patch))

    def accumulate(data: list[np.ndarray]) -> np.ndarray:
        total = np.zeros((inputs + 1, inputs + 1))
        for start in range(0, len(data[0]), step):
            rows = patch_cube(data[0][start : start + step], shape, patch).reshape(-1, inputs)
            rows = rows if shift is None else rows - shift
            block = np.concatenate([np.ones((len(rows), 1)), rows], axis=1)
            total += block.T @ block
        return total

    return sum_rows(images, [carried(images, "pixels")], accumulate, inputs + 1, inputs + 1)


def mean_and_covariance(moments: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and X^T X / n - mu^T mu from a collected moment matrix.

    With a shift the means are those of the shifted vectors; the covariance is the same.
    """
    n = moments[0, 0]
    if n == 0:
        raise ValueError("no rows to take moments of")
    mean = moments[0, 1:] / n
    return n, mean, moments[1:, 1:] / n - np.outer(mean, mean)


def covariance_rows(df: DataFrame, width: int, column: str = "features") -> DataFrame:
    """Covariance as rows (i, j, cov), summed around the mean found in a first pass."""
    n, mean = count_and_mean(df, width, column)

    def accumulate(data: list[np.ndarray]) -> np.ndarray:
        centred = data[0] - mean
        return centred.T @ centred

    rows = sum_rows(df, [carried(df, column)], accumulate, width, width)
    return long_rows(rows, ["i"], "row").select("i", "j", (F.col("v") / F.lit(n)).alias("cov"))


def count_and_mean(df: DataFrame, width: int, column: str = "features") -> tuple[float, np.ndarray]:
    """Row count and mean vector, on the driver."""

    def sums(data: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.full(width, float(len(data[0]))), data[0].sum(axis=0)])

    total = collect_matrix(sum_rows(df, [carried(df, column)], sums, 2, width), 2, width)
    if width == 0 or total[0, 0] == 0:
        raise ValueError("no rows to take a mean of")
    return float(total[0, 0]), total[1] / total[0, 0]


# Doubles of the tiles that one scan sums in a task (256 MB).
TILE_DOUBLES = 1 << 25


def tile_pairs(blocks: int) -> list[tuple[int, int]]:
    """The tiles on and above the diagonal, by row."""
    return [(i, j) for i in range(blocks) for j in range(i, blocks)]


def tile_scans(width: int, block: int, doubles: int = TILE_DOUBLES) -> list[list[tuple[int, int]]]:
    """The tiles that each scan sums: as many as ``doubles`` allow, and never more scans than blocks."""
    blocks = -(-width // block)
    pairs = tile_pairs(blocks)
    each = max(1, doubles // block**2, -(-len(pairs) // blocks))
    return [pairs[start : start + each] for start in range(0, len(pairs), each)]


def gram_tiles(df: DataFrame, width: int, block: int, lam: float = 0.0, column: str = "features", doubles: int = TILE_DOUBLES) -> DataFrame:
    """Gram matrix X^T X + lam I as rows (bi, bj, i, row) of its tiles on and above the diagonal.

    ``row`` holds the columns of block bj in row i; blocks have ``block`` columns, the
    last may be short. Each scan sums several tiles, so a task holds those and never
    a block times the width.
    """
    parts = []
    for pairs in tile_scans(width, block, doubles):

        def accumulate(data: list[np.ndarray], pairs=pairs) -> np.ndarray:
            total = np.zeros((len(pairs) * block, block))
            cut = {k: data[0][:, k * block : (k + 1) * block] for pair in pairs for k in pair}
            for t, (i, j) in enumerate(pairs):
                total[t * block : t * block + cut[i].shape[1], : cut[j].shape[1]] = cut[i].T @ cut[j]
            return total

        rows = sum_rows(df, [carried(df, column)], accumulate, len(pairs) * block, block)
        at = F.col("i") % block
        tile = F.get(F.lit([list(pair) for pair in pairs]), F.floor(F.col("i") / block).cast("int"))
        placed = rows.select(tile.alias("pair"), at.alias("at"), "row")
        bi, bj = F.get("pair", F.lit(0)), F.get("pair", F.lit(1))
        whole = placed.select(bi.alias("bi"), bj.alias("bj"), (bi * block + F.col("at")).alias("i"), "at", "row").where(F.col("i") < width)
        row = F.slice("row", F.lit(1), F.least(F.lit(block), F.lit(width) - F.col("bj") * block))
        on_diagonal = F.when(F.col("bi") == F.col("bj"), add_diagonal(row, F.col("at"), lam)).otherwise(row)
        parts.append(whole.select("bi", "bj", "i", on_diagonal.alias("row")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def gram_cells(tiles: DataFrame, block: int) -> DataFrame:
    """All cells (i, j, v) of the matrix whose upper tiles are given."""
    cells = tiles.select("bi", "bj", "i", F.posexplode("row").alias("at", "v"))
    cells = cells.select("bi", "bj", "i", (F.col("bj") * block + F.col("at")).alias("j"), "v")
    mirrored = cells.where("bi < bj").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return cells.select("i", "j", "v").unionByName(mirrored)


def add_diagonal(row: Column, index: Column, lam: float) -> Column:
    return F.transform(row, lambda v, j: v + F.when(j == index, F.lit(lam)).otherwise(F.lit(0.0)))


def class_moments(df: DataFrame, width: int, classes: int, column: str = "features", label: str = "label") -> np.ndarray:
    """classes x (1 + width): the count and the feature sums of each class."""

    def accumulate(data: list[np.ndarray]) -> np.ndarray:
        hot = class_matrix(data[1], classes)
        return hot.T @ np.concatenate([np.ones((len(hot), 1)), data[0]], axis=1)

    rows = sum_rows(df, [carried(df, column), F.col(label).cast("int")], accumulate, classes, width + 1)
    return collect_matrix(rows, classes, width + 1)


def class_matrix(labels: np.ndarray, classes: int, negative: float = 0.0) -> np.ndarray:
    """Indicator rows for a label array."""
    labels = labels.astype(np.int64)
    if len(labels) and (labels.min() < 0 or labels.max() >= classes):
        raise ValueError(f"labels must lie in 0..{classes - 1}")
    hot = np.full((len(labels), classes), float(negative))
    hot[np.arange(len(labels)), labels] = 1.0
    return hot


def column_spread(df: DataFrame, width: int, column: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Means and population standard deviations by position, in two passes."""
    n, mean = count_and_mean(df, width, column)

    def squares(data: list[np.ndarray]) -> np.ndarray:
        return ((data[0] - mean) ** 2).sum(axis=0)[None, :]

    second = collect_matrix(sum_rows(df, [carried(df, column)], squares, 1, width), 1, width)
    return mean, np.sqrt(second[0] / n)


def standardize(df: DataFrame, column: str = "features", width: int | None = None) -> DataFrame:
    """Centre every position and divide by its standard deviation; constant positions become 0."""
    width = width or row_width(df, column)
    mean, spread = column_spread(df, width, column)
    spread = np.where(spread > 0, spread, 1.0)
    return map_vectors(df, column, lambda: lambda rows: (rows - mean) / spread)


def subtract_mean_image(images: DataFrame, train: DataFrame, column: str = "pixels") -> DataFrame:
    """Subtract the mean of the training images from every image."""
    _, mean = count_and_mean(train, row_width(train, column), column)
    return map_vectors(images, column, lambda: lambda rows: rows - mean)


def channel_means(images: DataFrame, shape: Shape) -> tuple[float, ...]:
    """Mean of every channel over all images and pixels."""
    _, mean = count_and_mean(images, shape.size, "pixels")
    return tuple(mean.reshape(-1, shape.channels).mean(axis=0).tolist())


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Named counters that fill in while the table is computed, at no extra pass."""
    observation = Observation(name)
    columns = [F.count(F.lit(1)).alias("rows"), *(column.alias(key) for key, column in metrics.items())]
    return df.observe(observation, *columns), observation


def patch_count(shape: Shape, patch: int, stride: int = 1, pad: bool = False) -> Column:
    """Aggregate that counts the patches of the images seen."""
    return F.sum(F.lit(shape.convolved(patch, 1, stride, pad).size)).cast("bigint")

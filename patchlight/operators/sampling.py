"""Seeded samples that do not depend on row order or partitioning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight import seeded
from patchlight.functions.batches import VECTOR, carried, collect_matrix, from_matrix, rows_per_slice, sum_rows, to_matrix
from patchlight.layout import Shape
from patchlight.operators.patches import origins

# Buckets of one histogram pass, and the bucket size that is sorted outright.
BUCKETS = 4096
SORTED_ROWS = 100_000


def smallest(rows: DataFrame, order: str, ties: Sequence[str], m: int) -> DataFrame:
    """Exactly the m rows with the smallest ``order`` (all rows if there are fewer).

    A histogram of ``order`` finds the bucket that holds the m-th row, and is
    refined until that bucket is small. Rows below it pass a plain filter; only
    the bucket itself is sorted. No task ever sees more than that bucket.
    """
    if m <= 0:
        return rows.limit(0)
    low, high, below = 0, seeded.ORDER_RANGE, 0
    while True:
        width = -(-(high - low) // BUCKETS)
        bucket = F.floor((F.col(order) - F.lit(low)) / F.lit(width)).cast("int")
        counts = (
            rows.filter((F.col(order) >= low) & (F.col(order) < high)).groupBy(bucket.alias("b")).count().collect()
        )
        at, inside = None, 0
        for number, count in sorted((row["b"], row["count"]) for row in counts):
            if below + count >= m:
                at, inside = number, count
                break
            below += count
        if at is None:
            return rows
        low, high = low + at * width, min(high, low + (at + 1) * width)
        if inside <= SORTED_ROWS or width == 1:
            break
    edge = rows.filter((F.col(order) >= low) & (F.col(order) < high)).orderBy(order, *ties).limit(m - below)
    return rows.filter(F.col(order) < low).unionByName(edge) if below else edge


def sample_rows(df: DataFrame, key: str, m: int, seed: int) -> DataFrame:
    """Exactly m rows, without replacement."""
    ordered = seeded.with_order(df, "__order", F.col(key), 0, seed)
    return smallest(ordered, "__order", [key], m).drop("__order")


def sample_patches(images: DataFrame, shape: Shape, patch: int, m: int, seed: int) -> DataFrame:
    """Exactly m patches (image_id, x0, y0, patch).

    Tasks hash the places of their image keys; only places below the threshold of
    a refined histogram leave them. Pixels are read once, by a join with the m
    chosen places, and cut inside the task.
    """
    chosen = smallest_places(images, shape, patch, m, seed)
    asked = chosen.groupBy("image_id").agg(F.collect_list("place").alias("places"))
    ready = images.select("image_id", carried(images, "pixels").alias("pixels")).join(asked, "image_id")
    kinds = [("image_id", T.LongType()), ("x0", T.IntegerType()), ("y0", T.IntegerType()), ("patch", VECTOR)]
    schema = T.StructType([T.StructField(n, k) for n, k in kinds])
    dx, dy = np.arange(patch), np.arange(patch)[:, None]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            places = batch.column("places")
            number = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
            place = places.flatten().to_numpy()
            x0, y0 = place % shape.width, place // shape.width
            cube = to_matrix(batch.column("pixels")).reshape(-1, shape.height, shape.width, shape.channels)
            block = cube[number[:, None, None], y0[:, None, None] + dy, x0[:, None, None] + dx].reshape(len(number), -1)
            arrays = [batch.column("image_id").cast(pa.int64()).take(pa.array(number)), pa.array(x0.astype(np.int32)), pa.array(y0.astype(np.int32)), from_matrix(block)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return ready.mapInArrow(cut, schema)


def smallest_places(images: DataFrame, shape: Shape, patch: int, m: int, seed: int) -> DataFrame:
    """The m patch places (image_id, place) with the smallest order hash; ``place`` is x0 + y0 * width."""
    _, y_last, _ = origins(shape.height, patch, 1, False)
    _, x_last, _ = origins(shape.width, patch, 1, False)
    place = (np.arange(x_last + 1) + np.arange(y_last + 1)[:, None] * shape.width).reshape(-1)
    keys = images.select(F.col("image_id").cast("bigint").alias("image_id"))
    step = rows_per_slice(len(place))

    def hashed(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start in range(0, len(ids), step):
            own = ids[start : start + step]
            yield own, seeded.order_values(own[:, None], place[None, :], seed)

    low, high, below = 0, seeded.ORDER_RANGE, 0
    while m > 0:
        width = -(-(high - low) // BUCKETS)

        def count(data: list[np.ndarray], low: int = low, high: int = high, width: int = width) -> np.ndarray:
            total = np.zeros((1, BUCKETS))
            for _, order in hashed(data[0]):
                inside = order[(order >= low) & (order < high)]
                total[0] += np.bincount((inside - low) // width, minlength=BUCKETS)
            return total

        sums = collect_matrix(sum_rows(keys, ["image_id"], count, 1, BUCKETS), 1, BUCKETS)[0]
        ahead = below + np.cumsum(sums)
        if ahead[-1] < m:
            high = seeded.ORDER_RANGE
            break
        at = int(np.searchsorted(ahead, m))
        below, inside = int(ahead[at] - sums[at]), int(sums[at])
        low, high = low + at * width, min(high, low + (at + 1) * width)
        if inside <= SORTED_ROWS or width == 1:
            break
    else:
        high = 0

    def under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, order in hashed(batch.column(0).to_numpy()):
                row, column = np.nonzero(order < high)
                arrays = [pa.array(own[row]), pa.array(place[column].astype(np.int64)), pa.array(order[row, column])]
                yield pa.RecordBatch.from_arrays(arrays, names=["image_id", "place", "order"])

    few = keys.mapInArrow(under, "image_id bigint, place bigint, order bigint")
    return few.orderBy("order", "image_id", "place").limit(m).select("image_id", "place")


def bernoulli(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Keep each row with probability ``share``, decided by its key alone."""
    ordered = seeded.with_order(df, "__order", F.col(key), 0, seed)
    return ordered.filter(F.col("__order") < F.lit(int(share * seeded.ORDER_RANGE))).drop("__order")


#: Rows of a hash interval that are ranked outright, and counts that one pass brings to the driver.
RANKED_ROWS = 64
COUNTS = 1 << 18


def interval_counts(keys: DataFrame, lows: np.ndarray, high: np.ndarray, widths: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Rows by interval and part: the order hashes from lows[i] (ascending) to high[i], in at most ``parts`` parts of widths[i] each."""

    def count(data: list[np.ndarray]) -> np.ndarray:
        order = seeded.order_values(data[0], np.int64(0), seed)
        at = np.searchsorted(lows, order, side="right") - 1
        part = (order - lows[at]) // widths[at]
        inside = (at >= 0) & (order < high[at])
        return np.bincount(at[inside] * parts + part[inside], minlength=len(lows) * parts).reshape(len(lows), parts).astype(float)

    return collect_matrix(sum_rows(keys, ["key"], count, len(lows), parts), len(lows), parts).astype(np.int64)


def numbered_members(keys: DataFrame, numbers: np.ndarray, seed: int, total: int, most: int = RANKED_ROWS, counts: int = COUNTS) -> DataFrame:
    """Rows (number, key) for some numbers (ascending, each once) of rows in the order of their hash.

    Intervals of the hash range that hold a wanted number are split and counted again
    until each holds few rows or one hash value; all others are left alone. Only
    rows of the last intervals leave the tasks, so what is ranked follows from the
    numbers asked for, not from the table.
    """
    lows, sizes, below = np.array([0]), np.array([total]), np.array([0])
    high = np.array([seeded.ORDER_RANGE])
    while len(lows):
        wide = (sizes > most) & (high - lows > 1)
        if not wide.any():
            break
        parts = max(2, min(BUCKETS, counts // int(wide.sum())))
        widths = -(-(high[wide] - lows[wide]) // parts)
        found = interval_counts(keys, lows[wide], high[wide], widths, parts, seed)
        first = below[wide][:, None] + np.cumsum(found, axis=1) - found
        wanted = np.searchsorted(numbers, first + found) > np.searchsorted(numbers, first)
        at, part = np.nonzero(wanted)
        start = lows[wide][at] + part * widths[at]
        end = np.minimum(start + widths[at], high[wide][at])
        lows, high = np.concatenate([lows[~wide], start]), np.concatenate([high[~wide], end])
        sizes, below = np.concatenate([sizes[~wide], found[wanted]]), np.concatenate([below[~wide], first[wanted]])
        order = np.argsort(lows)
        lows, high, sizes, below = lows[order], high[order], sizes[order], below[order]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            order = seeded.order_values(own, np.int64(0), seed)
            at = np.searchsorted(lows, order, side="right") - 1
            kept = np.flatnonzero((at >= 0) & (order < high[at]))
            yield pa.RecordBatch.from_arrays([pa.array(below[at[kept]]), pa.array(order[kept]), pa.array(own[kept])], names=["bucket", "order", "key"])

    few = keys.mapInArrow(members, "bucket bigint, order bigint, key bigint")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("order", "key")) - 1
    return few.select((F.col("bucket") + rank).alias("number"), "key")


def pair_members(df: DataFrame, key: str, m: int, seed: int) -> DataFrame:
    """m pairs of rows drawn with replacement, as 2m rows (draw, right, key).

    A row's number is its place in hash order; the numbers drawn are found by
    ``numbered_members``, so only keys are read and only those near a draw are shuffled.
    """
    spark = df.sparkSession
    keys = df.select(F.col(key).cast("bigint").alias("key"))
    total = keys.count()
    if not total:
        raise ValueError("no rows to draw pairs from")
    draw = np.arange(m, dtype=np.int64)
    sides = []
    for stream in (seeded.PICK_LEFT, seeded.PICK_RIGHT):
        high = seeded.mixed(draw, np.int64(0), seed, stream)
        low = seeded.mixed(draw, np.int64(1), seed, stream)
        sides.append((high * seeded.MODULUS + low) % total)
    number = np.concatenate(sides)
    wanted = spark.createDataFrame(pa.table({"draw": np.concatenate([draw, draw]), "right": np.repeat([False, True], m), "number": number}))
    found = numbered_members(keys, np.unique(number), seed, total)
    # 2m draws were made on the driver, so the broadcast is bounded by m.
    return found.join(F.broadcast(wanted), "number").select("draw", "right", "key")


def sample_pairs(df: DataFrame, key: str, m: int, seed: int) -> DataFrame:
    """The same draws as m rows (draw, left_key, right_key)."""
    return pair_members(df, key, m, seed).groupBy("draw").agg(
        F.max(F.when(~F.col("right"), F.col("key"))).alias("left_key"),
        F.max(F.when(F.col("right"), F.col("key"))).alias("right_key"),
    )


def shuffled_positions(length: int, seed: int) -> list[int]:
    """Feature positions in seeded random order."""
    position = np.arange(length, dtype=np.int64)
    return np.argsort(seeded.mixed(position, np.int64(0), seed, seeded.ORDER_HIGH), kind="stable").tolist()


def position_blocks(length: int, block: int, seed: int) -> list[list[int]]:
    """The shuffled positions cut into blocks; the last may be short."""
    order = shuffled_positions(length, seed)
    return [order[start : start + block] for start in range(0, length, block)]


def random_positions(length: int, m: int, seed: int) -> list[int]:
    """m of ``length`` positions, in ascending order."""
    if not 0 <= m <= length:
        raise ValueError(f"cannot keep {m} of {length} positions")
    return sorted(shuffled_positions(length, seed)[:m])

"""Arrow batches in, Arrow batches out: the bridge between tables and matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())
FLOATS = T.ArrayType(T.FloatType())


def carried(df: DataFrame, column: str) -> Column:
    """A vector column as it goes to the tasks: floats stay floats and are widened
    there, anything else becomes doubles."""
    kind = df.schema[column].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col(column) if narrow else F.col(column).cast(VECTOR)

# Doubles a task works on at a time (about 3 MB, so that a slice stays in cache),
# and doubles in one batch that goes back to Spark (64 MB).
WORK_DOUBLES = 400_000
BATCH_DOUBLES = 8_000_000


def to_matrix(column: pa.Array) -> np.ndarray:
    """A list column as an (n, d) matrix; all rows must have one length."""
    rows = len(column)
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    if rows == 0:
        return values.reshape(0, 0)
    width, rest = divmod(len(values), rows)
    lengths = column.value_lengths()
    if rest or column.null_count or pa.compute.max(lengths).as_py() != width:
        raise ValueError("vectors of one table must be non-null and of one length")
    return values.reshape(rows, width)


def from_matrix(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def rows_per_slice(doubles_per_row: int, budget: int = WORK_DOUBLES) -> int:
    return max(1, budget // max(1, doubles_per_row))


def map_vectors(
    df: DataFrame,
    column: str,
    build: Callable[[], Callable[[np.ndarray], np.ndarray]],
    out: str | None = None,
    keep: Sequence[str] | None = None,
    doubles_per_row: int = 1024,
    as_float: bool = False,
) -> DataFrame:
    """Replace a vector column by a function of whole row blocks; no shuffle.

    ``build`` runs once per task and returns the function on an (n, d) matrix.
    ``as_float`` narrows the result to floats before it leaves the task.
    """
    out = out or column
    keep = [c for c in df.columns if c not in (column, out)] if keep is None else list(keep)
    source = df.select(*keep, carried(df, column).alias("__vector"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(out, FLOATS if as_float else VECTOR)])
    names = [*keep, out]
    step = rows_per_slice(doubles_per_row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = build()

        def finished(batch: pa.RecordBatch, start: int, blocks: list[np.ndarray]) -> pa.RecordBatch:
            vectors = blocks[0] if len(blocks) == 1 else np.concatenate(blocks)
            if as_float:
                vectors = vectors.astype(np.float32)
            part = batch.slice(start, len(vectors))
            arrays = [part.column(i) for i in range(len(keep))] + [from_matrix(vectors)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = to_matrix(batch.column(len(keep)))
            begun, blocks, held = 0, [], 0
            for start in range(0, len(matrix), step):
                block = apply(matrix[start : start + step])
                if blocks and held + block.size > BATCH_DOUBLES:
                    yield finished(batch, begun, blocks)
                    begun, blocks, held = start, [], 0
                blocks.append(block)
                held += block.size
            yield finished(batch, begun, blocks)

    return source.mapInArrow(run, schema)


# Doubles that all tasks of a fold ship together at most (1 TB). Each task ships a
# whole matrix, so only a scan of many splits under a large matrix is read by
# fewer, longer tasks; a small matrix leaves the splits, and what is computed
# before the fold, as they are.
FOLD_DOUBLES = 1 << 37

# Tasks that a large scan usually has, and doubles one reducer adds up then (256 MB).
USUAL_TASKS = 4096
REDUCER_DOUBLES = 1 << 25


def sum_rows(
    df: DataFrame,
    columns: Sequence,
    accumulate: Callable[[list[np.ndarray]], np.ndarray],
    height: int,
    width: int,
) -> DataFrame:
    """Sum a height x width matrix over all rows of a table, as keyed rows (i, row).

    Each task folds its partition into one matrix, so what is shuffled is one
    matrix per task, keyed by matrix row. The reducers add rows as they stream
    in and never hold a whole group; there are as many as the largest possible
    shuffle needs, so a small matrix costs one short task.
    """
    spark = df.sparkSession
    source = df.select(*columns)
    vector = [isinstance(field.dataType, T.ArrayType) for field in source.schema]
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("row", VECTOR)])

    def emit(keys: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = rows_per_slice(matrix.shape[1], BATCH_DOUBLES)
        for start in range(0, len(matrix), step):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[start : start + step], pa.int32()), from_matrix(matrix[start : start + step])],
                names=["i", "row"],
            )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            data = [
                to_matrix(batch.column(j)) if is_vector else batch.column(j).to_numpy(zero_copy_only=False)
                for j, is_vector in enumerate(vector)
            ]
            piece = accumulate(data)
            if total is None:
                total = piece
            else:
                total += piece
        if total is not None:
            yield from emit(np.arange(len(total)), total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for key, row in zip(keys.tolist(), to_matrix(batch.column(1))):
                if key in sums:
                    sums[key] += row
                else:
                    sums[key] = row.copy()
        if sums:
            keys = np.array(sorted(sums))
            yield from emit(keys, np.stack([sums[k] for k in keys.tolist()]))

    tasks = min(1 << 30, max(FOLD_DOUBLES // max(1, height * width), 4 * spark.sparkContext.defaultParallelism))
    # Reducers stream, so more tasks than usual make them slower but not larger.
    parts = -(-min(tasks, USUAL_TASKS) * height * width // REDUCER_DOUBLES)
    parts = max(1, min(parts, height, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return source.coalesce(tasks).mapInArrow(partial, schema).repartition(parts, "i").mapInArrow(merge, schema)


# A driver-side model matrix may have at most this many values (512 MB of doubles).
MODEL_VALUES = 1 << 26


def collect_matrix(rows: DataFrame, height: int, width: int) -> np.ndarray:
    """Bring a (i, row) table to the driver; its size is checked beforehand."""
    if height * width > MODEL_VALUES:
        raise ValueError(f"a {height} x {width} matrix is too large for the driver; use feature blocks")
    matrix = np.zeros((height, width))
    table = rows.toArrow()
    for batch in table.to_batches():
        if batch.num_rows:
            matrix[batch.column(0).to_numpy()] = to_matrix(batch.column(1))
    return matrix


def shared(spark: SparkSession, *arrays: np.ndarray) -> Broadcast:
    """Broadcast of one array, or of a tuple of several, whose size is checked beforehand."""
    values = sum(a.size for a in arrays)
    if values > MODEL_VALUES:
        raise ValueError(f"{values} values of a model are too many to broadcast ({MODEL_VALUES} at most); work on its parts")
    return spark.sparkContext.broadcast(arrays[0] if len(arrays) == 1 else arrays)


def shared_matrix(spark: SparkSession, values: int, build: Callable[[], np.ndarray]) -> Callable[[], np.ndarray]:
    """A seeded matrix for every task: small ones are redrawn, large ones broadcast once."""
    if values <= 1 << 18:
        return build
    if values > MODEL_VALUES:
        raise ValueError("filter bank too large to broadcast; split the filters into several runs")
    handle = spark.sparkContext.broadcast(build())
    return lambda: handle.value

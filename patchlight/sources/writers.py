"""Writers for features, scores, models and run records."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.session import local_path, path_exists
from patchlight.solvers.whitening import Whitener
from patchlight.sources.readers import read_matrix_lines


def number_text(vector: str, label: str | None = None) -> Column:
    numbers = F.transform(F.col(vector), lambda v: v.cast("string"))
    if label:
        numbers = F.concat(numbers, F.array(F.col(label).cast("string")))
    return F.concat_ws(",", numbers).alias("value")


def write_feature_text(df: DataFrame, path: str, feature_id: str, as_float: bool = False, mode: str = "error") -> None:
    """Lines ``x1,...,xd,label`` below ``<path>/<feature_id>_features/split=...``, in one pass.

    ``as_float`` narrows the values first.
    """
    kind = "array<float>" if as_float else "array<double>"
    lines = df.withColumn("features", F.col("features").cast(kind)).select(number_text("features", "label"), "split")
    lines.write.mode(mode).partitionBy("split").text(f"{path}/{feature_id}_features")


def write_features(df: DataFrame, path: str, as_float: bool = False, mode: str = "error") -> None:
    """Feature table as Parquet, one directory per split."""
    kind = "array<float>" if as_float else "array<double>"
    df.withColumn("features", F.col("features").cast(kind)).write.mode(mode).partitionBy("split").parquet(path)


def write_scores(df: DataFrame, path: str, mode: str = "error") -> None:
    """Lines ``id,label,w0,w1,...``."""
    fields = F.concat(
        F.array(F.col("row_id").cast("string"), F.col("label").cast("string")),
        F.transform("scores", lambda s: s.cast("string")),
    )
    df.select(F.concat_ws(",", fields).alias("value")).write.mode(mode).text(path)


# Characters that Spark's writers escape in the names of folders, and their name of none.
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\{\[\]^\x7f]""")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"

# Files in a folder, as far as they are dealt out by hash, and tasks that write them at least.
FOLDER_FILES = 20_000
FILE_TASKS = 32


def folder_name(column: str, value: str | None) -> str:
    """Name of a value's folder, as Spark's writers have it."""
    return f"{column}=" + (ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", value) if value else NO_VALUE)


def write_files(df: DataFrame, path: str, folder: str, name: str, suffix: str = "") -> None:
    """One file with the binary ``content`` of a row for each pair of values of the columns ``folder`` and ``name``.

    Of rows with one pair, one is read back. On a path that tasks can open they write
    ``<path>/<folder>=<value>/<name>=<value><suffix>`` themselves, each file whole
    or not at all: there Spark's writers start a process to set the rights of every
    file. More than FOLDER_FILES lie in folders ``files-<number>`` in between. In
    other stores Spark writes ``<path>/<folder>=<value>/<name>=<value>/part-*``.
    """
    spark = df.sparkSession
    if path_exists(spark, path):
        raise ValueError(f"{path} exists")
    tasks = max(FILE_TASKS, 4 * spark.sparkContext.defaultParallelism)
    rows = df.select(F.col(folder).cast("string"), F.col(name).cast("string"), "content").repartition(tasks, folder, name)
    top = local_path(spark, path)
    if top is None:
        rows.select(folder, name, F.col("content").cast("string").alias("value")).write.partitionBy(folder, name).text(path)
        return
    os.makedirs(top)
    folders = -(-df.count() // FOLDER_FILES)
    dealt = F.pmod(F.xxhash64(folder, name), F.lit(max(1, folders))).cast("int").alias("__folder")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = last = None
        for batch in batches:
            for kind, file, content, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (kind, file) == last:
                    continue
                last, target = (kind, file), f"{top}/{folder_name(folder, kind)}" + (f"/files-{part:05d}" if folders > 1 else "")
                if target != begun:
                    os.makedirs(begun := target, exist_ok=True)
                hidden = f"{target}/.{uuid.uuid4().hex}"
                with open(hidden, "wb") as out:
                    out.write(content or b"")
                os.replace(hidden, f"{target}/{folder_name(name, file)}{suffix}")
        yield from ()

    rows.select("*", dealt).sortWithinPartitions(folder, "__folder", name).mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()


def write_dataset(df: DataFrame, path: str, mode: str = "error") -> None:
    """Dataset records (data, label, label_weights, name) as Parquet."""
    df.select("data", F.col("label").cast("int").alias("label"), "label_weights", "name").write.mode(mode).parquet(path)


def write_whitener(spark: SparkSession, whitener: Whitener, path: str, mode: str = "error") -> None:
    whitener.table(spark).coalesce(1).write.mode(mode).parquet(path)


def read_whitener(spark: SparkSession, path: str) -> Whitener:
    return Whitener.from_table(spark.read.parquet(path))


def import_whitener(spark: SparkSession, matrix_path: str, mean_path: str, covariance: np.ndarray | None = None) -> Whitener:
    """A whitener from CSV files of its matrix and means.

    Such files hold no covariance; without one it is recovered from the matrix,
    which is (covariance + epsilon)^-1/2.
    """
    matrix = read_matrix_lines(spark, matrix_path)
    side = int(round(matrix.size**0.5))
    matrix = matrix.reshape(side, side)
    mean = read_matrix_lines(spark, mean_path).reshape(-1)
    if covariance is None:
        inverse = np.linalg.inv(matrix)
        covariance = inverse @ inverse
    return Whitener(mean, matrix, covariance)


def append_run(spark: SparkSession, record: dict, path: str) -> None:
    """Add one run record (config, metrics, runtime) to a results table in CSV.

    Every record has one line for each flattened field, (run, field, value), so
    records with other fields never share a column. ``run`` names the record.
    """
    run = uuid.uuid4().hex
    rows = [(run, key, str(value)) for key, value in sorted(flatten(record).items())]
    spark.createDataFrame(rows, RUN_FIELDS).coalesce(1).write.mode("append").option("header", True).option("escape", '"').csv(path)


RUN_FIELDS = "run string, field string, value string"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The results table as (run, record): one map of fields for each run."""
    lines = spark.read.schema(RUN_FIELDS).option("header", True).option("escape", '"').csv(path)
    # One entry for each field of a record.
    return lines.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("record"))


def flatten(record: dict, prefix: str = "") -> dict:
    """Nested dicts and lists to one level, joined by underscores."""
    flat: dict = {}
    for key, value in record.items():
        name = f"{prefix}{key}"
        if isinstance(value, dict):
            flat.update(flatten(value, f"{name}_"))
        elif isinstance(value, (list, tuple)):
            flat.update(flatten({str(i): v for i, v in enumerate(value)}, f"{name}_"))
        else:
            flat[name] = value
    return flat


def materialize(spark: SparkSession, path: str, compute: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """Read a finished table if there is one, else compute, write and read it."""
    if refresh or not path_exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Scores of linear models too large to broadcast.

A model of features x classes is a table (i, row), one row per feature; it never
is on the driver or whole in a task. Rows are cut into blocks of features and meet
the tiles (feature block x class block) of the model in cogroups; what each tile
adds to the scores of a row is summed by row key. Groups are salted, so a tile
meets a bounded number of rows at a time however many there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.functions.batches import MODEL_VALUES, carried, from_matrix, to_matrix
from patchlight.operators.statistics import row_width
from patchlight.solvers.linear import LinearModel

#: Columns of a tile, and values of the rows that one cogroup works on at a time (64 MB).
FEATURES, CLASSES = 4096, 1024
GROUP_VALUES = 1 << 23


def scores_by_parts(
    df: DataFrame, key: str, model: DataFrame, classes: int, column: str = "features", out: str = "scores",
    features: int = FEATURES, class_block: int = CLASSES, group_values: int = GROUP_VALUES,
) -> DataFrame:
    """(key, out) of every row of ``df`` under a model table (i, row): features by their number, the intercept as -1.

    ``key`` is unique. What moves is each row once per class block, the tiles once per
    salt, and for each row its partial scores once per feature block.
    """
    width, rows = row_width(df, column), df.count()
    feature_blocks, class_blocks = math.ceil(width / features), math.ceil(classes / class_block)
    salts = max(1, math.ceil(rows * min(width, features) / group_values))
    whole = df.select(F.col(key).alias("key"), carried(df, column).alias("x"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cut = whole.withColumn("fb", numbers(feature_blocks)).withColumn("cb", numbers(class_blocks))
    part = F.slice("x", F.col("fb") * features + 1, F.lit(features)).cast("array<double>")
    left = cut.select("fb", "cb", F.pmod(F.xxhash64("key"), F.lit(salts)).alias("salt"), "key", part.alias("x"))
    tiles = model.where("i >= 0").withColumn("cb", numbers(class_blocks)).withColumn("salt", numbers(salts))
    own = F.slice("row", F.col("cb") * class_block + 1, F.lit(class_block))
    right = tiles.select(F.floor(F.col("i") / features).cast("int").alias("fb"), "cb", F.col("salt").cast("bigint").alias("salt"), "i", own.alias("row"))

    def product(some: pa.Table, tile: pa.Table) -> pa.Table:
        names = ["key", "fb", "cb", "s"]
        if not some.num_rows or not tile.num_rows:
            return pa.table([some.column("key").slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.list_(pa.float64()))], names)
        x = to_matrix(some.column("x").combine_chunks())
        order = np.argsort(tile.column("i").to_numpy())
        scores = x @ to_matrix(tile.column("row").combine_chunks())[order]
        return pa.table([some.column("key"), some.column("fb"), some.column("cb"), from_matrix(scores)], names)

    groups = ["fb", "cb", "salt"]
    kind = df.schema[key].dataType.simpleString()
    made = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(product, f"key {kind}, fb int, cb int, s array<double>")
    add = lambda a, b: F.zip_with(a, b["s"], lambda u, v: u + v)
    by_block = F.array_sort(F.collect_list(F.struct("fb", "s")))
    summed = made.groupBy("key", "cb").agg(by_block.alias("parts"))
    total = F.aggregate(F.slice("parts", 2, feature_blocks), F.get("parts", F.lit(0))["s"], add)
    summed = summed.select("key", "cb", total.alias("s"))
    joined = summed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cb", "s"))).alias("parts"))
    flat = joined.select("key", F.flatten(F.transform("parts", lambda p: p["s"])).alias("s"))
    base = model.where("i = -1").select(F.col("row").alias("base"))  # one row
    with_base = flat.join(F.broadcast(base), F.lit(True), "left")
    return with_base.select(F.col("key").alias(key), F.when(F.col("base").isNull(), F.col("s")).otherwise(F.zip_with("s", "base", lambda u, v: u + v)).alias(out))


def scored(df: DataFrame, key: str, model: LinearModel, column: str = "features", out: str = "scores", limit: int = MODEL_VALUES) -> DataFrame:
    """``df`` with scores in place of its features: by a broadcast of a model of at most ``limit`` values, else by parts joined on ``key``."""
    if model.weights.size <= limit:
        return model.transform(df, column, out)
    scores = scores_by_parts(df, key, model.table(df.sparkSession), model.weights.shape[1], column, out)
    return df.drop(column, out).join(scores, key)

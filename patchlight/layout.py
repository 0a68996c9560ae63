"""Image geometry and the one pixel layout used everywhere.

Pixels of an image are one ``array<double>`` in channel-major order: the value
at column ``x``, row ``y``, channel ``c`` sits at ``c + x*C + y*C*W``. Seen from
NumPy that is a C-ordered ``(height, width, channels)`` cube.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_FIELDS = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("x_dim", T.IntegerType()),
        T.StructField("y_dim", T.IntegerType()),
        T.StructField("n_channels", T.IntegerType()),
        T.StructField("pixels", T.ArrayType(T.DoubleType())),
    ]
)


@dataclass(frozen=True)
class Shape:
    """Width, height and channel count of every image in a table."""

    width: int
    height: int
    channels: int = 1

    @property
    def size(self) -> int:
        return self.width * self.height * self.channels

    def convolved(self, patch: int, filters: int, stride: int = 1, pad: bool = False) -> "Shape":
        """Shape after one convolution; padding keeps width and height at stride 1."""
        lost = 0 if pad else patch - 1
        if self.width - lost < 1 or self.height - lost < 1:
            raise ValueError(f"patch {patch} does not fit in {self}")
        return Shape(-(-(self.width - lost) // stride), -(-(self.height - lost) // stride), filters)

    def pooled(self, pool: int, stride: int) -> "Shape":
        """Shape after pooling in windows centred at pool//2, pool//2+stride, ..."""
        if pool == 1 and stride == 1:
            return self
        first = pool // 2
        return Shape(-(-(self.width - first) // stride), -(-(self.height - first) // stride), self.channels)


def as_images(
    df: DataFrame, id_col: str, vector_col: str, label_col: str | None = None, widen: bool = True
) -> DataFrame:
    """Project any keyed vector table to (image_id, pixels[, label]).

    Column expressions need ``widen``, so that they calculate in doubles. The
    matrix operators widen inside the tasks, and move half the bytes without it.
    """
    pixels = F.col(vector_col).cast("array<double>") if widen else F.col(vector_col)
    columns = [F.col(id_col).cast("bigint").alias("image_id"), pixels.alias("pixels")]
    if label_col:
        columns.append(F.col(label_col).cast("int").alias("label"))
    return df.select(*columns)


def with_shape(df: DataFrame, shape: Shape, vector_col: str = "pixels") -> DataFrame:
    """Vector to image: attach the geometry, failing on rows of another length."""
    checked = F.when(F.size(vector_col) == shape.size, F.col(vector_col)).otherwise(
        F.raise_error(F.lit(f"row length differs from {shape}")).cast("array<double>")
    )
    return df.withColumns(
        {
            vector_col: checked,
            "x_dim": F.lit(shape.width),
            "y_dim": F.lit(shape.height),
            "n_channels": F.lit(shape.channels),
        }
    )


def flatten_images(df: DataFrame, out: str = "features") -> DataFrame:
    """Image to vector: the pixel array already is the vector."""
    return df.withColumnRenamed("pixels", out).drop("x_dim", "y_dim", "n_channels")


def long_rows(df: DataFrame, keys: Sequence, vector: str | Column, index: str = "j", value: str = "v") -> DataFrame:
    """Vectors to rows (keys, index, value).

    The outer explode with a filter behind it, because for a plain explode the
    optimiser adds tests of the vector in front, and computes it again for each.
    """
    return df.select(*keys, F.posexplode_outer(vector).alias(index, value)).filter(F.col(index).isNotNull())


def pixel_rows(images: DataFrame, shape: Shape, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Long form: one row (keys, x, y, c, v) per pixel value."""
    long = long_rows(images, keep, "pixels", "pos")
    return long.select(*keep, *pixel_position(F.col("pos"), shape), "v")


def pixel_position(pos: Column, shape: Shape) -> list[Column]:
    c = pos % shape.channels
    x = F.floor(pos / shape.channels).cast("int") % shape.width
    y = F.floor(pos / (shape.channels * shape.width)).cast("int")
    return [x.alias("x"), y.alias("y"), c.alias("c")]

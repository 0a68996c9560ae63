"""Convolution with filter banks and the random convolve-cosine layer.

Production form: whole images as Arrow batches, one matrix product per slice
of a batch, no shuffle. ``relational_conv_cosine_pool`` is the same maths as
an equi-join and two grouped sums, for checking and for small tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight import seeded
from patchlight.functions import vectors
from patchlight.functions.batches import BATCH_DOUBLES, MODEL_VALUES, map_vectors, shared_matrix, to_matrix
from patchlight.layout import Shape, pixel_rows
from patchlight.operators import pooling
from patchlight.operators.patches import patch_cube, patch_doubles
from patchlight.operators.random_features import fastfood_matrices, fastfood_rows, next_power2
from patchlight.operators.sampling import sample_patches
from patchlight.solvers.whitening import Whitener


NONLINEARITIES = ("cos", "rectify", "none")

# Filters that are applied together at least.
MIN_FILTERS = 64


@dataclass(frozen=True)
class Layer:
    """One convolve-cosine layer and the pool that follows it.

    ``whitener`` centres and whitens patches first. With a whitener the filters
    are shaped by the covariance of the *raw* patches although they multiply
    whitened ones, as in the method this reproduces; without one they are
    isotropic. ``norm`` is "offset" (``norm_offset`` goes into the square of
    every element), "floor" (never divide by less than 1e-4) or "none".
    ``rescale`` multiplies each output by the norm of its patch.
    """

    shape: Shape
    patch: int
    filters: int
    seed: int = 0
    bandwidth: float = 1.0
    stride: int = 1
    pad: bool = False
    norm: str = "offset"
    norm_offset: float = vectors.NORM_OFFSET
    rescale: bool = False
    fastfood: bool = False
    permute: bool = True
    pool: int = 1
    pool_stride: int = 1
    pool_kind: str = "mean"
    gauss_coefficient: float = 0.5
    nonlinearity: str = "cos"
    alpha: float = 0.0
    channel_means: tuple[float, ...] = ()
    whitener: Whitener | None = field(default=None, compare=False)

    @property
    def inputs(self) -> int:
        return self.patch * self.patch * self.shape.channels

    @property
    def conv_shape(self) -> Shape:
        return self.shape.convolved(self.patch, self.filters, self.stride, self.pad)

    @property
    def out_shape(self) -> Shape:
        conv = self.conv_shape
        if self.nonlinearity == "rectify":
            conv = replace(conv, channels=2 * conv.channels)
        if self.pool_kind == "blur":
            return conv if self.pool == 1 else Shape(-(-conv.width // self.pool), -(-conv.height // self.pool), conv.channels)
        return conv.pooled(self.pool, self.pool_stride)

    @property
    def doubles_per_row(self) -> int:
        return 2 * patch_doubles(self.shape, self.patch, self.stride, self.pad) + 3 * self.conv_shape.size

    def sides(self) -> pooling.Sides | None:
        conv = self.conv_shape
        if self.pool_kind == "blur":
            return None if self.pool == 1 else pooling.blur_sides(conv, self.pool)
        if self.pool == 1 and self.pool_stride == 1:
            return None
        if self.pool_kind == "gauss":
            return pooling.gaussian_sides(conv, self.pool, self.pool_stride, self.gauss_coefficient)
        if self.pool_kind == "mean":
            return pooling.mean_sides(conv, self.pool, self.pool_stride)
        raise ValueError(f"unknown pool kind {self.pool_kind}")


def random_filters(layer: Layer, low: int = 0, high: int | None = None) -> np.ndarray:
    """Filters low..high-1 as rows of inputs: isotropic, or shaped by the patch covariance when whitening."""
    draws = seeded.normals((layer.filters if high is None else high) - low, layer.inputs, layer.seed, first=low)
    if layer.whitener is not None:
        draws = draws @ layer.whitener.covariance_root().T
    return layer.bandwidth * draws


def drawn_blocks(layer: Layer, most: int) -> Callable[[int, int], np.ndarray]:
    """Filter blocks (inputs x filters) drawn in the task when they are used; up to ``most`` values are kept for the next images."""
    kept: dict[tuple[int, int], np.ndarray] = {}

    def block(low: int, high: int) -> np.ndarray:
        made = kept.get((low, high))
        if made is None:
            made = np.ascontiguousarray(random_filters(layer, low, high).T)
            if sum(b.size for b in kept.values()) + made.size <= most:
                kept[low, high] = made
        return made

    return block


def projector(layer: Layer, bank: Callable[[], np.ndarray] | None) -> Callable[[np.ndarray, int, int], np.ndarray]:
    """The linear map from patch rows to the responses of filters low..high-1."""
    if layer.fastfood:
        parts = fastfood_matrices(layer.inputs, layer.filters, layer.seed, layer.permute)
        return lambda rows, low, high: fastfood_rows(rows, parts.between(low, high), high - low, layer.bandwidth)
    if bank is None:
        blocks = drawn_blocks(layer, MODEL_VALUES // 8)
        return lambda rows, low, high: rows @ blocks(low, high)
    across = np.ascontiguousarray(bank().T)
    return lambda rows, low, high: rows @ across[:, low:high]


def filter_blocks(layer: Layer, rows: int) -> list[tuple[int, int]]:
    """Filter ranges whose responses to ``rows`` patches fit the working memory of a task."""
    step = max(MIN_FILTERS, BATCH_DOUBLES // max(1, 4 * rows))
    unit = next_power2(layer.inputs) if layer.fastfood else 1
    step = -(-step // unit) * unit
    return [(low, min(low + step, layer.filters)) for low in range(0, layer.filters, step)]


def layer_function(layer: Layer, bank: Callable[[], np.ndarray], phase: np.ndarray | None) -> Callable:
    """The whole layer on an (n, d) block of images."""
    if layer.nonlinearity not in NONLINEARITIES:
        raise ValueError(f"nonlinearity {layer.nonlinearity} is none of {NONLINEARITIES}")
    project = projector(layer, bank)
    sides = layer.sides()
    means = np.tile(layer.channel_means, layer.patch * layer.patch) if layer.channel_means else None
    if phase is None:
        phase = seeded.phases(layer.filters, layer.seed)

    def patch_norms(rows: np.ndarray) -> np.ndarray | None:
        if layer.norm == "offset":
            return np.linalg.norm(rows + layer.norm_offset, axis=1)[:, None]
        if layer.norm == "floor":
            return np.maximum(np.linalg.norm(rows, axis=1), vectors.NORM_FLOOR)[:, None]
        if layer.norm == "none":
            return None
        raise ValueError(f"unknown norm {layer.norm}")

    def respond(rows: np.ndarray, norms: np.ndarray | None, low: int, high: int) -> np.ndarray:
        out = project(rows, low, high)
        if norms is not None:
            out /= norms
        if layer.nonlinearity == "cos":
            out += phase[low:high]
            np.cos(out, out=out)
        if layer.rescale and norms is not None:
            out *= norms
        return out

    def apply(images: np.ndarray) -> np.ndarray:
        if images.shape[1:] != (layer.shape.size,):
            raise ValueError(f"images of {images.shape[1:]} values do not have {layer.shape}")
        cube = patch_cube(images, layer.shape, layer.patch, layer.stride, layer.pad)
        rows = cube.reshape(-1, layer.inputs)
        if means is not None:
            rows = rows - means
        if layer.whitener is not None:
            rows = layer.whitener.apply(rows)
        norms = patch_norms(rows)
        pools: list[list[np.ndarray]] = [[], []]
        # Channels pool one by one, so filters can go in blocks however many there are.
        for low, high in filter_blocks(layer, len(rows)):
            out = respond(rows, norms, low, high).reshape(*cube.shape[:3], high - low)
            halves = [out]
            if layer.nonlinearity == "rectify":
                halves = [np.maximum(0.0, out - layer.alpha), np.maximum(0.0, -out - layer.alpha)]
            for pooled, half in zip(pools, halves):
                pooled.append(half if sides is None else pooling.pool_cube(half, sides))
        blocks = pools[0] + pools[1]
        done = blocks[0] if len(blocks) == 1 else np.concatenate(blocks, axis=3)
        return done.reshape(len(images), -1)

    return apply


def layer_stack(
    images: DataFrame,
    layers: Sequence[Layer],
    filters: np.ndarray | None = None,
    phases: np.ndarray | None = None,
    out: str = "features",
    keep: Sequence[str] | None = None,
    as_float: bool = False,
) -> DataFrame:
    """Run layers one after another in a single pass over the images.

    Intermediate layer outputs stay inside the task. Given ``filters`` (and
    ``phases``) replace the seeded ones of a single layer and are broadcast.
    """
    spark = images.sparkSession
    if filters is not None and len(layers) != 1:
        raise ValueError("explicit filters go with exactly one layer")
    for before, after in zip(layers, layers[1:]):
        if before.out_shape != after.shape:
            raise ValueError(f"layer output {before.out_shape} does not feed {after.shape}")
    banks = []
    for layer in layers:
        if layer.fastfood or (filters is None and layer.filters * layer.inputs > MODEL_VALUES):
            # A bank that is too large for one piece is drawn block by block inside the tasks.
            banks.append(None)
            continue
        if filters is not None and filters.shape != (layer.filters, layer.inputs):
            raise ValueError(f"filters must be {layer.filters} x {layer.inputs}, not {filters.shape}")
        make = (lambda: filters) if filters is not None else (lambda layer=layer: random_filters(layer))
        banks.append(shared_matrix(spark, layer.filters * layer.inputs, make))

    def build() -> Callable[[np.ndarray], np.ndarray]:
        steps = [layer_function(layer, bank, phases) for layer, bank in zip(layers, banks)]

        def apply(block: np.ndarray) -> np.ndarray:
            for step in steps:
                block = step(block)
            return block

        return apply

    widest = max(layer.doubles_per_row for layer in layers)
    return map_vectors(images, "pixels", build, out=out, keep=keep, doubles_per_row=widest, as_float=as_float)


def convolve(
    images: DataFrame,
    shape: Shape,
    filters: np.ndarray,
    patch: int,
    stride: int = 1,
    pad: bool = False,
    whitener: Whitener | None = None,
    flip: bool = False,
) -> DataFrame:
    """Linear convolution with a filter bank (rows in the patch layout).

    ``flip`` turns the filters by 180 degrees. A whitener is applied to the
    filters, not the patches: (whiten(F) W^T) against raw patches.
    """
    bank = pack_filters(filters, shape.channels, patch, whitener, flip)
    layer = Layer(shape, patch, len(bank), stride=stride, pad=pad, norm="none", nonlinearity="none")
    return layer_stack(images, [layer], filters=bank, out="pixels")


def pack_filters(
    filters: np.ndarray, channels: int, patch: int, whitener: Whitener | None = None, flip: bool = False
) -> np.ndarray:
    """Filter images to bank rows. Filters share the pixel layout, so rows need no reordering."""
    bank = np.asarray(filters, dtype=np.float64)
    if flip:
        bank = bank.reshape(-1, patch, patch, channels)[:, ::-1, ::-1].reshape(len(bank), -1)
    if whitener is not None:
        bank = whitener.apply(bank) @ whitener.matrix.T
    return np.ascontiguousarray(bank)


def filter_table(spark, filters: int, inputs: int, seed: int, bandwidth: float = 1.0) -> DataFrame:
    """The seeded bank as rows (f, px, w), drawn by column arithmetic."""
    cells = spark.range(filters * inputs).select(
        F.floor(F.col("id") / inputs).cast("bigint").alias("f"), (F.col("id") % inputs).alias("px")
    )
    u = seeded.unit(seeded.mixed_column(F.col("f"), F.col("px"), seed, seeded.NORMAL_A))
    v = seeded.unit(seeded.mixed_column(F.col("f"), F.col("px"), seed, seeded.NORMAL_B))
    w = F.lit(bandwidth) * F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)
    return cells.select("f", "px", w.alias("w"))


def phase_table(spark, filters: int, seed: int) -> DataFrame:
    """Seeded phases as rows (f, b)."""
    draw = seeded.mixed_column(F.col("id"), F.lit(0), seed, seeded.PHASE)
    return spark.range(filters).select(F.col("id").alias("f"), (F.lit(2.0) * F.pi() * seeded.unit(draw)).alias("b"))


# The relational form broadcasts its bank; this many (f, px) rows at most.
RELATIONAL_BANK_ROWS = 1_000_000


def relational_conv_cosine_pool(images: DataFrame, layer: Layer) -> DataFrame:
    """The layer as joins and grouped sums: rows (image_id, gx, gy, f, v).

    Every pixel is sent to the patches that cover it, joined to the filter rows
    of its place in the patch, and summed twice (over the patch, over the pool).
    Only for even or unit pools with stride equal to the pool, so that a
    position belongs to one window. Images are partitioned by id while they are
    still small; both sums group by (id, ...) and so need no further shuffle.
    """
    spark = images.sparkSession
    shape, k = layer.shape, layer.patch
    if layer.pad or layer.stride != 1 or layer.fastfood or layer.whitener is not None:
        raise ValueError("the relational form covers plain stride-1 layers")
    if layer.pool != layer.pool_stride or (layer.pool > 1 and layer.pool % 2):
        raise ValueError("the relational form needs pool windows that do not overlap")
    if layer.filters * layer.inputs > RELATIONAL_BANK_ROWS:
        raise ValueError("bank too large for the relational form")
    conv, out = layer.conv_shape, layer.out_shape
    # A given count also keeps small image tables, which grow a lot here, on all cores.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    offsets = F.array(*[F.struct(F.lit(d % k).alias("dx"), F.lit(d // k).alias("dy"), F.lit(d * shape.channels).alias("at")) for d in range(k * k)])
    covered = (
        pixel_rows(images.select("image_id", "pixels").repartition(parts, "image_id"), shape)
        .select("image_id", "x", "y", "c", "v", F.inline(offsets))
        .select(
            "image_id",
            (F.col("x") - F.col("dx")).alias("x0"),
            (F.col("y") - F.col("dy")).alias("y0"),
            (F.col("c") + F.col("at")).cast("bigint").alias("px"),
            "v",
        )
        .filter(F.col("x0").between(0, conv.width - 1) & F.col("y0").between(0, conv.height - 1))
    )
    bank = filter_table(spark, layer.filters, layer.inputs, layer.seed, layer.bandwidth)
    shifted = F.col("v") + F.lit(layer.norm_offset)
    projected = (
        covered.join(F.broadcast(bank), "px")
        .groupBy("image_id", "x0", "y0", "f")
        .agg(F.sum(F.col("v") * F.col("w")).alias("z"), F.sqrt(F.sum(shifted * shifted)).alias("norm"))
    )
    response = F.cos(F.col("z") / F.col("norm") + F.col("b"))
    if layer.rescale:
        response = response * F.col("norm")
    # Positions past the last window are not pooled.
    cells = projected.join(F.broadcast(phase_table(spark, layer.filters, layer.seed)), "f").select(
        "image_id",
        F.floor(F.col("x0") / layer.pool).cast("int").alias("gx"),
        F.floor(F.col("y0") / layer.pool).cast("int").alias("gy"),
        "f",
        response.alias("v"),
    )
    return (
        cells.filter((F.col("gx") < out.width) & (F.col("gy") < out.height))
        .groupBy("image_id", "gx", "gy", "f")
        .agg((F.sum("v") / F.lit(float(layer.pool * layer.pool))).alias("v"))
    )


def sampled_filters(images: DataFrame, shape: Shape, patch: int, filters: int, seed: int) -> np.ndarray:
    """A bank of ``filters`` patches drawn without replacement, in order of (image, y, x)."""
    rows = sample_patches(images, shape, patch, filters, seed).toArrow()
    rows = rows.sort_by([("image_id", "ascending"), ("y0", "ascending"), ("x0", "ascending")])
    return to_matrix(rows.column("patch").combine_chunks())

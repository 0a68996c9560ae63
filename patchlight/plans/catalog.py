"""Registered queries: every operator on the given tables, over whole tables.

The 64 values of a row of ``embeddings`` are an 8x8 image with one channel, or a
4x4 image with four. Vectors are shown as rows (key, position, value), rounded
so that the order of a sum does not show.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight import seeded
from patchlight.functions import vectors
from patchlight.layout import Shape, as_images, long_rows, pixel_position, with_shape
from patchlight.operators import convolve as cv
from patchlight.operators import evaluation, joins, kernels, patches, pooling, sampling, statistics
from patchlight.operators import random_features as rf
from patchlight.plans import runs
from patchlight.plans.config import FeatureConf, SolveConf
from patchlight.session import fresh_path
from patchlight.solvers import linear, softmax, whitening
from patchlight.sources import readers, writers

FLAT = Shape(8, 8, 1)
DEEP = Shape(4, 4, 4)
WIDTH = 64
CLASSES = 10
SEED = 11
LAMBDA = 10.0
SWEEP = [5.0, 10.0, 40.0]
SWEEP_REGS = [0.01, 0.1, 1.0]
MIXTURE = 0.4
COPIES = 4
ANCHORS = 16
PAIRS = 3000
SAMPLE = 200
# The label map, which leaves one language out.
LABEL_MAP = [("de", 0), ("en", 1), ("fr", 2)]
LABEL_PATTERN = r"^[a-z]+://[^/]+/([a-z]{2})/"

FLAT_LAYER = cv.Layer(FLAT, 5, 32, seed=SEED, pool=2, pool_stride=2)
DEEP_LAYER = cv.Layer(DEEP, 2, 6, seed=SEED + 1, bandwidth=0.7)
SECOND_LAYER = cv.Layer(Shape(2, 2, 8), 2, 12, seed=SEED + 1, bandwidth=0.5)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def shown(value: Column, digits: int = 6) -> Column:
    """Rounded; adding zero turns a negative zero into a plain one."""
    return F.round(value, digits) + F.lit(0.0)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return as_images(table, "vec_id", "embedding", "label")


def stored_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images as stored, in floats, for operators that widen inside the tasks."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return as_images(table, "vec_id", "embedding", "label", widen=False)


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_images(spark, sf_dir).withColumnRenamed("pixels", "features")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).withColumnRenamed("pixels", "features")


def rows(df: DataFrame, column: str, keys: tuple[str, ...] = ("image_id",), digits: int = 6) -> DataFrame:
    """Vectors as rows (keys, j, v)."""
    return long_rows(df, keys, column).select(*keys, "j", shown(F.col("v").cast("double"), digits).alias("v"))


# ---- images, patches and row transforms


@query
def image_reshape(spark, sf_dir):
    shaped = with_shape(images(spark, sf_dir), DEEP)
    cells = long_rows(shaped, ["image_id", "x_dim", "y_dim", "n_channels"], "pixels", "pos")
    return cells.select("image_id", "x_dim", "y_dim", "n_channels", *pixel_position(F.col("pos"), DEEP), shown(F.col("v")).alias("v"))


@query
def patch_extract(spark, sf_dir):
    return rows(patches.extract_patches(images(spark, sf_dir), FLAT, 5), "patch", ("image_id", "x0", "y0"))


@query
def patch_extract_strided_padded(spark, sf_dir):
    cut = patches.extract_patches(images(spark, sf_dir), FLAT, 4, stride=3, pad=True)
    return rows(cut, "patch", ("image_id", "x0", "y0"))


@query
def window_rows(spark, sf_dir):
    return rows(patches.windows(images(spark, sf_dir), DEEP, 2, 2), "pixels", ("image_id", "x0", "y0"))


@query
def channel_mean_subtract(spark, sf_dir):
    table = images(spark, sf_dir)
    means = statistics.channel_means(table, DEEP)
    return rows(table.withColumn("pixels", vectors.subtract_channel_means(F.col("pixels"), means)), "pixels")


@query
def patch_normalize(spark, sf_dir):
    cut = patches.extract_patches(images(spark, sf_dir), FLAT, 5)
    scaled, norm = vectors.l2_normalize(F.col("patch"))
    shaped = cut.select("image_id", "x0", "y0", scaled.alias("patch"), shown(norm).alias("norm"))
    return rows(shaped, "patch", ("image_id", "x0", "y0", "norm"))


@query
def patch_normalize_floor(spark, sf_dir):
    cut = patches.extract_patches(images(spark, sf_dir), DEEP, 3)
    scaled, norm = vectors.floor_normalize(F.col("patch"), 0.75)
    shaped = cut.select("image_id", "x0", "y0", scaled.alias("patch"), shown(norm).alias("norm"))
    return rows(shaped, "patch", ("image_id", "x0", "y0", "norm"))


@query
def image_contrast_norm(spark, sf_dir):
    return rows(whitening.contrast_normalized(images(spark, sf_dir)), "pixels")


@query
def mean_image_subtract(spark, sf_dir):
    table = stored_images(spark, sf_dir)
    return rows(statistics.subtract_mean_image(table, table), "pixels")


@query
def vector_subsample(spark, sf_dir):
    kept = sampling.random_positions(WIDTH, 10, SEED)
    return rows(features(spark, sf_dir).withColumn("features", vectors.pick(F.col("features"), kept)), "features")


@query
def column_block(spark, sf_dir):
    table = features(spark, sf_dir)
    blocks = F.array(*[vectors.block(F.col("features"), start, 24) for start in range(0, WIDTH, 24)])
    cut = long_rows(table, ["image_id"], blocks, "block", "part")
    return rows(cut, "part", ("image_id", "block"))


@query
def label_indicator(spark, sf_dir):
    table = features(spark, sf_dir)
    return rows(table.withColumn("hot", vectors.indicator(F.col("label"), CLASSES)), "hot", ("image_id", "label"))


@query
def symmetric_rectify(spark, sf_dir):
    both = vectors.symmetric_rectify(F.col("pixels"), DEEP.channels, 0.0, 0.05)
    return rows(images(spark, sf_dir).withColumn("pixels", both), "pixels")


@query
def channel_reorder(spark, sf_dir):
    turned = vectors.reverse_channels(F.col("pixels"), DEEP.channels)
    return rows(images(spark, sf_dir).withColumn("pixels", turned), "pixels")


@query
def image_resize(spark, sf_dir):
    return rows(pooling.resize(stored_images(spark, sf_dir), FLAT, 12, 5), "pixels")


@query
def image_resize_nearest(spark, sf_dir):
    return rows(pooling.resize(stored_images(spark, sf_dir), DEEP, 7, 3, "nearest"), "pixels")


# ---- convolution


def bank(count: int, inputs: int, seed: int = SEED) -> np.ndarray:
    return seeded.normals(count, inputs, seed)


@query
def convolve_linear(spark, sf_dir):
    return rows(cv.convolve(stored_images(spark, sf_dir), FLAT, bank(4, 25), 5), "pixels")


@query
def convolve_stride2(spark, sf_dir):
    return rows(cv.convolve(stored_images(spark, sf_dir), FLAT, bank(4, 16), 4, stride=2), "pixels")


@query
def convolve_same(spark, sf_dir):
    return rows(cv.convolve(stored_images(spark, sf_dir), DEEP, bank(3, 36), 3, pad=True), "pixels")


@query
def convolve_same_even(spark, sf_dir):
    return rows(cv.convolve(stored_images(spark, sf_dir), FLAT, bank(3, 16), 4, pad=True), "pixels")


@query
def filter_flip(spark, sf_dir):
    return rows(cv.convolve(stored_images(spark, sf_dir), DEEP, bank(3, 16), 2, flip=True), "pixels")


@query
def conv_cosine(spark, sf_dir):
    layer = replace(FLAT_LAYER, filters=8, pool=1, pool_stride=1)
    return rows(cv.layer_stack(stored_images(spark, sf_dir), [layer]), "features")


@query
def conv_cosine_pool(spark, sf_dir):
    return rows(cv.layer_stack(stored_images(spark, sf_dir), [FLAT_LAYER]), "features")


@query
def conv_cosine_pool_relational(spark, sf_dir):
    cells = cv.relational_conv_cosine_pool(images(spark, sf_dir), FLAT_LAYER)
    shape = FLAT_LAYER.out_shape
    place = F.col("f") + (F.col("gx") + F.col("gy") * shape.width) * shape.channels
    return cells.select("image_id", place.cast("int").alias("j"), shown(F.col("v")).alias("v"))


@query
def conv_cosine_strided_padded(spark, sf_dir):
    layer = replace(FLAT_LAYER, patch=4, filters=6, stride=3, pad=True, pool=1, pool_stride=1, bandwidth=1.8)
    return rows(cv.layer_stack(stored_images(spark, sf_dir), [layer]), "features")


@query
def conv_cosine_norm_scaled(spark, sf_dir):
    return rows(cv.layer_stack(stored_images(spark, sf_dir), [replace(DEEP_LAYER, rescale=True)]), "features")


@query
def conv_cosine_offset(spark, sf_dir):
    """A patch norm with a large small value inside the square."""
    layer = replace(DEEP_LAYER, norm_offset=0.1, rescale=True)
    return rows(cv.layer_stack(stored_images(spark, sf_dir), [layer]), "features")


@query
def layer_restart(spark, sf_dir):
    """Two layers, the second run on the stored output of the first."""
    folder = fresh_path(spark, "restart")
    conf = FeatureConf(
        "embeddings", 8, 8, 1, SEED, patch_sizes=(5, 2), filters=(8, 12), bandwidth=(1.0, 0.5), conv_stride=(1, 1), pool=(2, 1), pool_stride=(2, 1)
    )
    table = stored_images(spark, sf_dir)
    runs.featurize_stored(table, conf.prefix(1), folder)
    return rows(runs.featurize_stored(table, conf, folder, layers=1), "features")


@query
def conv_cosine_fastfood(spark, sf_dir):
    layer = replace(DEEP_LAYER, filters=32, fastfood=True, bandwidth=1.3)
    return rows(cv.layer_stack(stored_images(spark, sf_dir), [layer]), "features")


@query
def conv_cosine_gauss_pool(spark, sf_dir):
    """Filters and phases are given and broadcast; the pool weighs by exp(-d^2 / 2 sigma^2)."""
    layer = replace(FLAT_LAYER, filters=8, rescale=True, pool_kind="gauss", pool=2, pool_stride=2)
    given = bank(8, 25, SEED + 5)
    return rows(cv.layer_stack(stored_images(spark, sf_dir), [layer], given, seeded.phases(8, SEED + 5)), "features")


@query
def conv_cosine_gauss_pool_means(spark, sf_dir):
    """Seeded filters, channel means taken off first, weights exp(-d^2 / sigma^2)."""
    table = stored_images(spark, sf_dir)
    layer = replace(
        DEEP_LAYER, rescale=True, pool_kind="gauss", gauss_coefficient=1.0, pool=2, pool_stride=1,
        channel_means=statistics.channel_means(table, DEEP),
    )
    return rows(cv.layer_stack(table, [layer]), "features")


@query
def two_layer_features(spark, sf_dir):
    first = replace(FLAT_LAYER, filters=8)
    return rows(cv.layer_stack(stored_images(spark, sf_dir), [first, SECOND_LAYER]), "features")


@query
def patch_bank_features(spark, sf_dir):
    """Filters are patches sampled from the images; rectify, then pool."""
    table = images(spark, sf_dir)
    layer = cv.Layer(FLAT, 3, 6, pool=2, pool_stride=2, alpha=0.01)
    return rows(runs.patch_bank_features(table, table, layer, SEED), "features")


@query
def conv_cosine_whitened_cov(spark, sf_dir):
    """Patches are whitened, and filters shaped by the covariance of the raw patches."""
    table = stored_images(spark, sf_dir)
    whitener = whitening.fit_patch_whitener(table, FLAT, 5)
    return rows(cv.layer_stack(table, [replace(FLAT_LAYER, filters=8, whitener=whitener)]), "features")


@query
def patch_rbf_lift(spark, sf_dir):
    """Floor-normalised patches, filters N(0, 2 gamma), cosine, times the norm, then blur-pool."""
    gamma = 1.1
    layer = replace(
        FLAT_LAYER, filters=6, norm="floor", rescale=True, bandwidth=float(np.sqrt(2.0 * gamma)), pool_kind="blur"
    )
    return rows(cv.layer_stack(stored_images(spark, sf_dir), [layer]), "features")


# ---- pooling


@query
def pool_mean(spark, sf_dir):
    return rows(pooling.mean_pool(stored_images(spark, sf_dir), FLAT, 4, 3), "pixels")


@query
def pool_mean_odd(spark, sf_dir):
    return rows(pooling.mean_pool(stored_images(spark, sf_dir), DEEP, 3, 2), "pixels")


@query
def pool_general_max(spark, sf_dir):
    pooled = pooling.general_pool(images(spark, sf_dir), FLAT, 4, 3, "max", pixel=lambda v: v * F.lit(2.0) - F.lit(0.1))
    return rows(pooled, "pixels")


@query
def pool_general_l2(spark, sf_dir):
    return rows(pooling.general_pool(images(spark, sf_dir), DEEP, 3, 2, "l2", pixel=F.abs), "pixels")


@query
def pool_rectify(spark, sf_dir):
    return rows(pooling.rectify_pool(stored_images(spark, sf_dir), DEEP, 2, 2, 0.0, 0.02), "pixels")


@query
def gaussian_blur_pool(spark, sf_dir):
    return rows(pooling.gaussian_blur_pool(stored_images(spark, sf_dir), FLAT, 2), "pixels")


@query
def block_pool(spark, sf_dir):
    return rows(pooling.block_pool(images(spark, sf_dir), FLAT, 3, "max"), "pixels")


@query
def block_pool_mean(spark, sf_dir):
    return rows(pooling.block_pool(images(spark, sf_dir), FLAT, 3, "mean"), "pixels")


# ---- random features and kernels


@query
def fwht(spark, sf_dir):
    return rows(rf.hadamard(stored_features(spark, sf_dir)), "features")


@query
def fastfood(spark, sf_dir):
    return rows(rf.fastfood(stored_features(spark, sf_dir), WIDTH, 128, SEED, sigma=0.8), "features")


@query
def fastfood_unpermuted(spark, sf_dir):
    """Vector scale (no 1/sqrt d) and no permutation."""
    return rows(rf.fastfood(stored_features(spark, sf_dir), WIDTH, 64, SEED, 2.0, permute=False, root=False), "features")


@query
def random_cosine_features(spark, sf_dir):
    return rows(rf.cosine_features(stored_features(spark, sf_dir), WIDTH, 96, SEED, gamma=1.2), "features")


@query
def random_cosine_features_cauchy(spark, sf_dir):
    return rows(rf.cosine_features(stored_features(spark, sf_dir), WIDTH, 16, SEED, gamma=0.1, weights="cauchy"), "features", digits=4)


@query
def random_cosine_features_broadcast(spark, sf_dir):
    given = 0.5 * seeded.uniforms(48, WIDTH, SEED)
    return rows(rf.cosine_features_given(stored_features(spark, sf_dir), given, seeded.phases(48, SEED)), "features")


@query
def kernel_matrix_sample(spark, sf_dir):
    table = features(spark, sf_dir)
    keys, anchors = kernels.anchor_rows(table, "image_id", ANCHORS, SEED)
    cells = long_rows(kernels.kernel_rows(table, anchors, sigma=1.0), ["image_id"], "kernel", "a")
    return cells.select("image_id", F.get(F.lit(keys.tolist()), F.col("a")).cast("bigint").alias("anchor_id"), shown(F.col("v")).alias("v"))


@query
def kernel_approx_error(spark, sf_dir):
    table = features(spark, sf_dir)
    _, anchors = kernels.anchor_rows(table, "image_id", ANCHORS, SEED)
    error = kernels.kernel_error(table, anchors, bank(256, WIDTH), seeded.phases(256, SEED))
    return error.select("pairs", shown(F.col("mean_error")).alias("mean_error"), shown(F.col("max_error")).alias("max_error"))


@query
def sample_pairs(spark, sf_dir):
    return kernels.pair_distances(features(spark, sf_dir), "image_id", PAIRS, SEED).select(
        "draw", "left_key", "right_key", shown(F.col("distance")).alias("distance")
    )


@query
def learn_gamma(spark, sf_dir):
    gamma = kernels.learn_gamma(features(spark, sf_dir), "image_id", PAIRS, SEED)
    return gamma.select(shown(F.col("median_distance")).alias("median_distance"), shown(F.col("gamma")).alias("gamma"))


# ---- sums and moments


@query
def feature_means(spark, sf_dir):
    means = statistics.vector_means(features(spark, sf_dir))
    return means.select("pos", shown(F.col("mean")).alias("mean"))


@query
def feature_totals(spark, sf_dir):
    sums = statistics.vector_sum(features(spark, sf_dir))
    return sums.select("pos", shown(F.col("total")).alias("total"))


@query
def grand_mean(spark, sf_dir):
    return statistics.grand_mean(features(spark, sf_dir)).select(shown(F.col("grand_mean"), 9).alias("grand_mean"))


@query
def row_norm_mean(spark, sf_dir):
    norms = patches.extract_patches(images(spark, sf_dir), FLAT, 5)
    return statistics.row_norm_mean(norms, "patch").select(shown(F.col("norm_mean")).alias("norm_mean"))


@query
def stage_counts(spark, sf_dir):
    """Images and patches of a layer, by label."""
    return images(spark, sf_dir).groupBy("label").agg(
        F.count("*").alias("n_images"), statistics.patch_count(FLAT, 5).alias("n_patches")
    )


@query
def ridge_scale(spark, sf_dir):
    """What each ridge setting of a parameter grid means on the table."""
    summary = statistics.squares_summary(features(spark, sf_dir))
    grid = summary.withColumn("reg", F.explode(F.lit(SWEEP))).withColumn("mode", F.explode(F.lit(list(statistics.REG_MODES))))
    scaled = statistics.ridge_scale(grid, F.col("reg"), F.col("mode"))
    return scaled.select("reg", "mode", "n", "d", shown(F.col("lam")).alias("lam"))


@query
def covariance(spark, sf_dir):
    cells = statistics.covariance_rows(stored_features(spark, sf_dir), WIDTH)
    return cells.select("i", "j", shown(F.col("cov"), 8).alias("cov"))


@query
def gram_blocks(spark, sf_dir):
    """The whole matrix, from tiles of 24 on and above its diagonal."""
    cells = statistics.gram_cells(statistics.gram_tiles(stored_features(spark, sf_dir), WIDTH, 24, LAMBDA), 24)
    return cells.select(F.floor(F.col("i") / 24).cast("int").alias("block"), "i", "j", shown(F.col("v")).alias("v"))


@query
def patch_covariance(spark, sf_dir):
    moments = statistics.patch_moment_rows(stored_images(spark, sf_dir), FLAT, 5)
    return rows(moments, "row", ("i",))


@query
def standardize(spark, sf_dir):
    return rows(statistics.standardize(stored_features(spark, sf_dir), width=WIDTH), "features")


@query
def zca_whiten(spark, sf_dir):
    """Covariance of the whitened rows: V diag(l / (l + eps)) V^T."""
    table = features(spark, sf_dir)
    white = whitening.fit_whitener(table, epsilon=0.01).transform(table)
    cells = statistics.covariance_rows(white, WIDTH)
    return cells.select("i", "j", shown(F.col("cov")).alias("cov"))


@query
def whiten_apply(spark, sf_dir):
    fixed = whitening.Whitener(np.full(WIDTH, 0.01), bank(WIDTH, WIDTH), np.eye(WIDTH))
    return rows(fixed.transform(features(spark, sf_dir)), "features")


@query
def whiten_whole_images(spark, sf_dir):
    table = images(spark, sf_dir)
    white, _ = runs.whiten_images(table, table)
    return rows(white, "pixels")


# ---- samples


@query
def sample_patches(spark, sf_dir):
    return rows(sampling.sample_patches(images(spark, sf_dir), FLAT, 5, SAMPLE, SEED), "patch", ("image_id", "x0", "y0"))


@query
def sample_rows(spark, sf_dir):
    return rows(sampling.sample_rows(features(spark, sf_dir), "image_id", SAMPLE, SEED), "features")


@query
def bernoulli_sample(spark, sf_dir):
    return sampling.bernoulli(features(spark, sf_dir), "image_id", 0.3, SEED).select("image_id", "label")


@query
def shuffle_blocks(spark, sf_dir):
    """Features dealt into shuffled blocks of 20: rows (image_id, block, place, pos, v)."""
    blocks = sampling.position_blocks(WIDTH, 20, SEED)
    dealt = features(spark, sf_dir).select("image_id", "features", F.posexplode(F.lit(sum(blocks, []))).alias("at", "pos"))
    return dealt.select(
        "image_id",
        F.floor(F.col("at") / 20).cast("int").alias("block"),
        (F.col("at") % 20).alias("place"),
        "pos",
        shown(F.get("features", F.col("pos"))).alias("v"),
    )


# ---- scores and evaluation; scores are inner products with the class means


def class_mean_model(table: DataFrame) -> linear.LinearModel:
    sums = statistics.class_moments(table, WIDTH, CLASSES)
    return linear.LinearModel((sums[:, 1:] / sums[:, :1]).T, np.zeros(CLASSES))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = features(spark, sf_dir)
    return class_mean_model(table).transform(table)


def scored_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rotated copies of every row, scored."""
    table = features(spark, sf_dir)
    turned = F.array(*[vectors.rotate(F.col("features"), s, WIDTH) for s in range(COPIES)])
    copies = table.select("image_id", "label", F.explode(turned).alias("features"))
    return class_mean_model(table).transform(copies)


@query
def linear_scores(spark, sf_dir):
    return rows(scored(spark, sf_dir), "scores", ("image_id", "label"))


@query
def argmax_class(spark, sf_dir):
    return evaluation.predictions(scored(spark, sf_dir)).select("image_id", "label", "prediction")


@query
def topk_classes(spark, sf_dir):
    best = long_rows(scored(spark, sf_dir), ["image_id"], vectors.top_k(F.col("scores"), 5), "place", "class")
    return best.select("image_id", "place", F.col("class").cast("int").alias("class"))


@query
def accuracy(spark, sf_dir):
    return evaluation.accuracy(scored(spark, sf_dir)).select(
        "n", shown(F.col("accuracy")).alias("accuracy"), shown(F.col("error_percent")).alias("error_percent")
    )


@query
def top5_accuracy(spark, sf_dir):
    return evaluation.top_k_accuracy(scored(spark, sf_dir), 5).select("n", shown(F.col("topk_accuracy")).alias("topk_accuracy"))


@query
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(scored(spark, sf_dir))


@query
def class_report(spark, sf_dir):
    report = evaluation.class_report(scored(spark, sf_dir))
    return report.select(
        "class", "tp", "actual", "predicted", shown(F.col("precision")).alias("precision"), shown(F.col("recall")).alias("recall")
    )


@query
def cross_entropy(spark, sf_dir):
    return evaluation.cross_entropy(scored(spark, sf_dir)).select("n", shown(F.col("loss")).alias("loss"))


@query
def augmented_average(spark, sf_dir):
    mean = evaluation.average_scores(scored_copies(spark, sf_dir), "image_id", CLASSES)
    return rows(mean, "scores", ("image_id", "copies"))


@query
def augmented_accuracy(spark, sf_dir):
    return evaluation.augmented_accuracy(scored_copies(spark, sf_dir), "image_id", CLASSES).select(
        "n", shown(F.col("accuracy")).alias("accuracy"), shown(F.col("error_percent")).alias("error_percent")
    )


# ---- fits


@query
def ridge_fit_predict(spark, sf_dir):
    table = stored_features(spark, sf_dir)
    return rows(linear.fit_ridge(table, LAMBDA, CLASSES).transform(table), "scores", ("image_id", "label"))


@query
def block_ridge(spark, sf_dir):
    """Two block passes, one data pass per block, as for features too wide for one Gram matrix."""
    table = stored_features(spark, sf_dir)
    model = linear.fit_ridge(table, LAMBDA, CLASSES, block=24, passes=2, gram_width=32)
    return rows(model.transform(table), "scores", ("image_id", "label"))


@query
def weighted_ridge(spark, sf_dir):
    table = stored_features(spark, sf_dir)
    return rows(linear.fit_ridge(table, LAMBDA, CLASSES, mixture=MIXTURE).transform(table), "scores", ("image_id", "label"))


@query
def dual_coefficients(spark, sf_dir):
    table = stored_features(spark, sf_dir)
    model = linear.fit_ridge(table, LAMBDA, CLASSES)
    return rows(linear.dual_coefficients(table, model, LAMBDA), "alpha")


@query
def learn_gamma_patches(spark, sf_dir):
    gamma = kernels.learn_gamma_patches(stored_images(spark, sf_dir), FLAT, 5, PAIRS, SEED)
    return gamma.select(shown(F.col("median_distance")).alias("median_distance"), shown(F.col("gamma")).alias("gamma"))


@query
def dual_scores(spark, sf_dir):
    table = stored_features(spark, sf_dir)
    model = linear.fit_ridge(table, LAMBDA, CLASSES)
    duals = linear.dual_coefficients(table, model, LAMBDA)
    return rows(kernels.dual_scores(duals, table, WIDTH, CLASSES), "scores", ("image_id", "label"))


@query
def ridge_sweep(spark, sf_dir):
    """Weights of every ridge setting, all from one pass."""
    models = linear.ridge_sweep(stored_features(spark, sf_dir), SWEEP, CLASSES)
    tables = [model.table(spark).withColumn("lam", F.lit(lam)) for lam, model in models.items()]
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return rows(whole, "row", ("lam", "i"))


@query
def softmax_gd_steps(spark, sf_dir):
    table = stored_features(spark, sf_dir)
    model = softmax.softmax_descent(table, 0.01, 3, lambda k: 1.0 / (k + 1), CLASSES)
    return rows(model.transform(table), "scores", ("image_id", "label"))


@query
def softmax_gd_backtrack(spark, sf_dir):
    table = stored_features(spark, sf_dir)
    model = softmax.softmax_descent(table, 0.01, 3, "backtrack", CLASSES)
    return rows(model.transform(table), "scores", ("image_id", "label"))


@query
def softmax_gn(spark, sf_dir):
    table = stored_features(spark, sf_dir)
    return rows(softmax.softmax_newton(table, 1.0, 2, CLASSES).transform(table), "scores", ("image_id", "label"))


@query
def softmax_block_gn(spark, sf_dir):
    table = stored_features(spark, sf_dir)
    model = softmax.softmax_block_newton(table, 1.0, 1, 24, 1, SEED, CLASSES)
    return rows(model.transform(table), "scores", ("image_id", "label"))


@query
def logistic_ml(spark, sf_dir):
    """Predicted class and its score under the log loss of all classes together, fitted until it has settled."""
    table = stored_features(spark, sf_dir)
    model = softmax.softmax_quasi_newton(table, [0.01], tolerance=1e-10, classes=CLASSES)[0]
    scores = model.transform(table)
    found = evaluation.predictions(scores)
    return found.select("image_id", "label", "prediction", shown(F.array_max("scores"), 4).alias("score"))


@query
def softmax_sweep(spark, sf_dir):
    """Scores under every weight of two solvers; the settings of a solver share each scan."""
    table = stored_features(spark, sf_dir)
    grid = runs.solve_grid(spark, {"solver": ["softmax_newton", "log_rest"], "reg": SWEEP_REGS, "iterations": [2], "classes": [CLASSES]})
    whole = None
    for conf, model in zip(grid, runs.fit_all(table, grid), strict=True):
        part = rows(model.transform(table), "scores", ("image_id",)).withColumns({"solver": F.lit(conf.solver), "reg": F.lit(conf.reg)})
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query
def param_grid(spark, sf_dir):
    """What every combination of ridge weight, mode and class mixture weighs: the rows of each class under each setting."""
    table = features(spark, sf_dir)
    sizes = table.groupBy("label").agg(F.count("*").alias("n"))
    grid = joins.param_grid(spark, {"reg": SWEEP, "mode": list(statistics.REG_MODES), "mixture": [0.0, MIXTURE]}, sizes)
    weight = (F.lit(1.0) - F.col("mixture")) + F.col("mixture") * F.lit(table.count()) / (F.lit(CLASSES) * F.col("n"))
    return grid.select("reg", "mode", "mixture", "label", "n", shown(weight).alias("weight"))


@query
def log_rest_descent(spark, sf_dir):
    model = softmax.fit_named_loss(stored_features(spark, sf_dir), "log_rest", 0.01, 5)
    return rows(model.transform(stored_features(spark, sf_dir)), "scores", ("image_id", "label"))


@query
def hinge_ml(spark, sf_dir):
    table = stored_features(spark, sf_dir)
    done = evaluation.predictions(softmax.fit_named_loss(table, "hinge", 0.01, 10).transform(table))
    return done.select("image_id", "label", "prediction")


@query
def featurize_fit_evaluate(spark, sf_dir):
    """A whole run, with the features kept in a keyed table: one row of metrics."""
    table = stored_images(spark, sf_dir)
    conf = FeatureConf(dataset="embeddings", filters=(32,), bandwidth=(1.2,), whiten=True, seed=SEED)
    record = runs.run(table, table, conf, SolveConf(reg=0.1, reg_mode="trace_over_d", classes=CLASSES), fresh_path(spark, "run"))
    metrics = record["test"]
    return spark.createDataFrame(
        [(metrics["n"], round(metrics["accuracy"], 6), round(metrics["top5_accuracy"], 6))],
        "n bigint, accuracy double, top5_accuracy double",
    )


# ---- sources and sinks: written to the shared folder and read back


def halves(table: DataFrame) -> DataFrame:
    """Even classes train, odd classes test."""
    return table.withColumn("split", F.when(F.col("label") % 2 == 0, "train").otherwise("test"))


@query
def feature_text_roundtrip(spark, sf_dir):
    """Text lines carry no key, so the id goes along as the first feature."""
    path = fresh_path(spark, "text")
    keyed = F.concat(F.array(F.col("image_id").cast("double")), "features")
    writers.write_feature_text(halves(features(spark, sf_dir)).withColumn("features", keyed), path, "layer0")
    back = readers.read_feature_text(spark, path, "layer0", partitions=8)
    split = back.withColumns({"image_id": F.get("features", F.lit(0)).cast("bigint"), "features": F.slice("features", 2, WIDTH)})
    return rows(split, "features", ("image_id", "split", "label"))


@query
def float_feature_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "float")
    keyed = F.concat(F.array(F.col("image_id").cast("double")), F.transform("features", lambda v: v / F.lit(3.0)))
    writers.write_feature_text(halves(features(spark, sf_dir)).withColumn("features", keyed), path, "layer0", as_float=True)
    back = readers.read_feature_text(spark, path, "layer0", as_float=True)
    split = back.withColumns({"image_id": F.get("features", F.lit(0)).cast("bigint"), "features": F.slice("features", 2, WIDTH)})
    return rows(split, "features", ("image_id", "split", "label"))


@query
def layer_reload(spark, sf_dir):
    """Features of a layer, stored as text and read back as images of its shape."""
    path = fresh_path(spark, "layer")
    layer = replace(FLAT_LAYER, filters=4)
    stored = cv.layer_stack(stored_images(spark, sf_dir), [layer])
    writers.write_feature_text(halves(stored), path, "layer0")
    shape = layer.out_shape
    # Layer text carries no key; each image is known by its first value and its label.
    back = readers.read_layer(spark, path, "layer0", shape).withColumn("first", shown(F.get("pixels", F.lit(0)), 9))
    return rows(back, "pixels", ("first", "label", "split", "x_dim", "y_dim", "n_channels"))


def stored_byte(v: Column) -> Column:
    """A value in -1..1 as one of all 256 bytes."""
    return F.pmod(F.floor((v + F.lit(1.0)) * F.lit(640.0)), F.lit(256)).cast("int")


def hex_number(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def byte_text(hex_digits: Column) -> Column:
    """The bytes that hexadecimal digits name, for a text writer."""
    return F.unhex(hex_digits).cast("string").alias("value")


@query
def fixed_width_binary_roundtrip(spark, sf_dir):
    """Records of a label byte, 64 value bytes from 0 to 255, four bytes of the id and a newline byte, row by row."""
    path = fresh_path(spark, "records")
    body = F.array_join(F.transform("pixels", lambda v: hex_number(stored_byte(v), 2)), "")
    record = F.concat(hex_number(F.col("label"), 2), body, hex_number(F.col("image_id"), 8))
    images(spark, sf_dir).select(byte_text(record)).write.text(path)
    back = readers.read_fixed_records(spark, path, Shape(WIDTH + 5, 1, 1), planes=False)
    byte = lambda k: F.round(F.get("pixels", F.lit(WIDTH + k)) * 255).cast("bigint")
    key = F.shiftleft(byte(0), 24) + F.shiftleft(byte(1), 16) + F.shiftleft(byte(2), 8) + byte(3)
    return rows(back.select(key.alias("image_id"), "label", F.slice("pixels", 1, WIDTH).alias("pixels")), "pixels", ("image_id", "label"))


@query
def idx_roundtrip(spark, sf_dir):
    """An IDX image file and an IDX label file of the table, in the order of the ids, read back by record number."""
    path, table = fresh_path(spark, "idx"), images(spark, sf_dir)
    body = F.array_join(F.transform("pixels", lambda v: hex_number(stored_byte(v), 2)), "")
    cells = table.select("image_id", body.alias("body"), hex_number(F.col("label"), 2).alias("mark"))
    # A file of this format is one value here, as it has no place for line breaks.
    whole = cells.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("image_id", "body", "mark"))).alias("all"))
    head = lambda *numbers: F.concat(*[hex_number(n if isinstance(n, Column) else F.lit(n), 8) for n in numbers])
    joined = lambda field: F.array_join(F.transform("all", lambda r: r[field]), "")
    whole.select(byte_text(F.concat(head(readers.IDX_IMAGES, F.col("n"), 8, 8), joined("body")))).coalesce(1).write.text(f"{path}/images")
    whole.select(byte_text(F.concat(head(readers.IDX_LABELS, F.col("n")), joined("mark")))).coalesce(1).write.text(f"{path}/labels")
    return rows(readers.read_idx(spark, f"{path}/images", f"{path}/labels"), "pixels", ("image_id", "label"))


#: Sizes of the photos by their id: width and height.
PHOTO_SIZES = [(8, 8), (16, 4), (4, 16)]
PHOTO_LAYER = cv.Layer(Shape(8, 8, 3), 3, 4, seed=SEED, pool=2, pool_stride=2, bandwidth=0.05)


def bitmap(pixels: Column, width: int, height: int) -> Column:
    """Hexadecimal digits of a 24-bit bitmap file of grey pixels, lowest row first; rows need no padding."""
    little = lambda n, size: int(n).to_bytes(size, "little").hex()
    fields = ((54 + 3 * width * height, 4), (0, 4), (54, 4), (40, 4), (width, 4), (height, 4), (1, 2), (24, 2), (0, 4), (3 * width * height, 4), *[(0, 4)] * 4)
    head = "424d" + "".join(little(*f) for f in fields)
    order = [x + y * width for y in reversed(range(height)) for x in range(width)]
    grey = F.transform(F.lit(order), lambda k: F.repeat(hex_number(stored_byte(F.get(pixels, k)), 2), 3))
    return F.concat(F.lit(head), F.array_join(grey, ""))


@query
def labelled_photos(spark, sf_dir):
    """Image files of three sizes, with the class in their folder's name, to features: list, look up, decode, resize, convolve."""
    path, table = fresh_path(spark, "photos"), images(spark, sf_dir)
    kind = F.col("image_id") % len(PHOTO_SIZES)
    file = F.when(kind == 0, bitmap(F.col("pixels"), *PHOTO_SIZES[0])).when(kind == 1, bitmap(F.col("pixels"), *PHOTO_SIZES[1]))
    file = file.otherwise(bitmap(F.col("pixels"), *PHOTO_SIZES[2]))
    folder = F.concat(F.lit("n"), F.col("label"))
    named = table.select(F.unhex(file).alias("content"), folder.alias("kind"), F.col("image_id").alias("image"))
    writers.write_files(named, path, "kind", "image", ".bmp")
    labels = spark.createDataFrame([(f"n{k}", 2 * k) for k in range(CLASSES)], "key string, class int")
    files = readers.read_labelled_files(spark, path, labels, r"/kind=(n\d+)/", "{image=*,part-*}")
    photos = pooling.resize_each(readers.decoded_pixels(files), 8, 8)
    keyed = photos.select(F.regexp_extract("path", r"/image=(\d+)", 1).cast("bigint").alias("image_id"), "class", "pixels")
    return rows(cv.layer_stack(keyed, [PHOTO_LAYER]), "features", ("image_id", "class"))


@query
def feature_glob(spark, sf_dir):
    """Feature lines of every folder that a pattern names, in one scan; the id goes along as the first feature."""
    path = fresh_path(spark, "glob")
    keyed = F.concat(F.array(F.col("image_id").cast("double")), "features")
    for half, part in enumerate(("layer0_train_features", "layer0_test_features")):
        own = features(spark, sf_dir).where(F.col("label") % 2 == half).withColumn("features", keyed)
        own.select(writers.number_text("features", "label")).write.text(f"{path}/{part}")
    back = readers.feature_lines(spark, f"{path}/layer0_*_features/part*")
    cut = back.select(F.get("features", F.lit(0)).cast("bigint").alias("image_id"), "label", F.slice("features", 2, WIDTH).alias("features"))
    return rows(cut, "features", ("image_id", "label"))


@query
def whitener_csv_import(spark, sf_dir):
    """A whitener whose matrix and means were stored as lines of numbers, applied to patches."""
    path, table = fresh_path(spark, "whitener"), images(spark, sf_dir)
    model = whitening.fit_patch_whitener(table, FLAT, 5)
    for name, values in (("matrix", model.matrix), ("means", model.mean[:, None])):
        lines = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(values)], "k int, row array<double>")
        lines.sort("k").coalesce(1).select(writers.number_text("row")).write.text(f"{path}/{name}")
    imported = writers.import_whitener(spark, f"{path}/matrix", f"{path}/means")
    return rows(imported.transform(patches.extract_patches(table, FLAT, 5), "patch"), "patch", ("image_id", "x0", "y0"))


@query
def run_records(spark, sf_dir):
    """Records of two runs, appended to a results table and read back as (n_classes, field, value)."""
    path, table = fresh_path(spark, "records"), features(spark, sf_dir)
    for classes in (CLASSES, CLASSES // 2):
        sizes = {str(label): n for label, n in linear.class_counts(table.where(F.col("label") < classes)).items()}
        writers.append_run(spark, {"solve": {"classes": classes}, "rows": sizes, "n": sum(sizes.values())}, path)
    records = writers.read_runs(spark, path)
    return records.select(F.col("record")["solve_classes"].cast("int").alias("n_classes"), F.explode("record").alias("field", "value"))


@query
def file_list(spark, sf_dir):
    """Files of a table of lines by folder, and their bytes, without reading them."""
    path = fresh_path(spark, "files")
    line = F.concat_ws(",", "image_id", "label")
    halves(images(spark, sf_dir)).select(line.alias("value"), "split").repartition(4, "value").write.partitionBy("split").text(path)
    listed = readers.list_files(spark, path, "part-*").where("length > 0")
    split = F.regexp_extract("path", "/split=([a-z]+)/", 1)
    return listed.groupBy(split.alias("split")).agg(F.sum("length").alias("bytes"))


@query
def stage_counters(spark, sf_dir):
    """Counters that fill in while a layer's inputs are cut: images, and patches with their values."""
    table, seen = statistics.observed(images(spark, sf_dir), "images", n=statistics.patch_count(FLAT, 5))
    cut, found = statistics.observed(patches.extract_patches(table, FLAT, 5), "patches", n=F.sum(F.size("patch")).cast("bigint"))
    cut.write.format("noop").mode("overwrite").save()
    kinds = "stage string, n_rows bigint, n_inside bigint"
    return spark.createDataFrame([(name, o.get["rows"], o.get["n"]) for name, o in (("images", seen), ("patches", found))], kinds)


@query
def matrix_csv_roundtrip(spark, sf_dir):
    """Matrix and label files written from the same sorted table and paired by line number."""
    path = fresh_path(spark, "matrix")
    ordered = features(spark, sf_dir).sort("image_id")
    ordered.select(writers.number_text("features")).write.text(f"{path}/X")
    ordered.select(F.col("label").cast("string").alias("value")).write.text(f"{path}/y")
    back = readers.read_matrix_csv(spark, f"{path}/X", f"{path}/y")
    return rows(back, "pixels", ("image_id", "label"))


@query
def score_text_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "scores")
    writers.write_scores(scored(spark, sf_dir).withColumnRenamed("image_id", "row_id"), path)
    return rows(readers.read_scores(spark, path), "scores", ("row_id", "label"))


@query
def dataset_roundtrip(spark, sf_dir):
    """Dataset records (data, label, label weights, name) through Parquet."""
    path = fresh_path(spark, "dataset")
    table = features(spark, sf_dir)
    records = table.select(
        F.col("features").alias("data"),
        "label",
        vectors.indicator(F.col("label"), CLASSES, 0.0).alias("label_weights"),
        F.concat(F.lit("e"), F.col("image_id").cast("string")).alias("name"),
    )
    writers.write_dataset(records, path)
    back = readers.read_dataset(spark, path)
    return rows(back, "data", ("name", "label"))


@query
def split_table_roundtrip(spark, sf_dir):
    """Parquet features, one directory per split."""
    path = fresh_path(spark, "split")
    writers.write_features(halves(features(spark, sf_dir)), path, as_float=True)
    return rows(spark.read.parquet(path), "features", ("image_id", "split", "label"))


@query
def whitener_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "whitener")
    table = images(spark, sf_dir)
    writers.write_whitener(spark, whitening.fit_patch_whitener(table, FLAT, 5), path)
    model = writers.read_whitener(spark, path)
    cut = patches.extract_patches(table, FLAT, 5)
    return rows(model.transform(cut, "patch"), "patch", ("image_id", "x0", "y0"))


# ---- joins


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.regexp_extract("url", LABEL_PATTERN, 1).alias("key"))


@query
def label_map_join(spark, sf_dir):
    labels = spark.createDataFrame(LABEL_MAP, "key string, class int")
    return joins.label_files(page_files(spark, sf_dir), labels, "key").select("page_id", "key", "class")


@query
def label_map_unmapped(spark, sf_dir):
    labels = spark.createDataFrame(LABEL_MAP, "key string, class int")
    return joins.unmapped(page_files(spark, sf_dir), labels, "key").select("page_id", "key")


@query
def label_map_join_large(spark, sf_dir):
    """The same lookup on the road for lookups too large to broadcast: salted keys."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("key"), F.col("quality").alias("class"))
    return joins.lookup_join(documents, labels, "key", limit=10, salts=4).select("key", "lang", "class")

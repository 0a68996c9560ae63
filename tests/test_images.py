"""Layout, patches, convolution and pooling against plain loops."""

import itertools
from dataclasses import replace

import numpy as np
import pytest
from conftest import collected, image_table
from pyspark.sql import functions as F

from patchlight import seeded
from patchlight.functions import vectors
from patchlight.layout import Shape, flatten_images, pixel_rows, with_shape
from patchlight.operators import convolve as cv
from patchlight.operators import patches, pooling

RAMP = Shape(7, 5, 3)


def ramp(n=2, shape=RAMP):
    return np.arange(n * shape.size, dtype=float).reshape(n, -1)


def cube(row, shape):
    return row.reshape(shape.height, shape.width, shape.channels)


def patch_by_loops(row, shape, k, x0, y0):
    image = cube(row, shape)
    out = []
    for dy, dx, c in itertools.product(range(k), range(k), range(shape.channels)):
        x, y = x0 + dx, y0 + dy
        inside = 0 <= x < shape.width and 0 <= y < shape.height
        out.append(image[y, x, c] if inside else 0.0)
    return out


@pytest.mark.parametrize("k,stride,pad", [(3, 1, False), (2, 2, False), (3, 2, False), (3, 1, True), (4, 1, True), (4, 3, True), (1, 1, False)])
def test_patches(spark, k, stride, pad):
    rows = ramp()
    table = patches.extract_patches(image_table(spark, rows), RAMP, k, stride, pad).collect()
    shape = RAMP.convolved(k, 1, stride, pad)
    assert len(table) == 2 * shape.size
    for row in table:
        assert row["patch"] == patch_by_loops(rows[row["image_id"]], RAMP, k, row["x0"], row["y0"])
    block = patches.patch_cube(rows, RAMP, k, stride, pad)
    assert block.shape[1:3] == (shape.height, shape.width)
    first = -(k // 2) if pad else 0
    for oy, ox in itertools.product(range(shape.height), range(shape.width)):
        want = patch_by_loops(rows[1], RAMP, k, first + ox * stride, first + oy * stride)
        assert block[1, oy, ox].tolist() == want


def test_padding_keeps_the_size():
    assert RAMP.convolved(4, 6, 1, True) == Shape(7, 5, 6)
    assert RAMP.convolved(3, 6, 1, True) == Shape(7, 5, 6)
    with pytest.raises(ValueError):
        RAMP.convolved(6, 1)


def test_pixel_rows_and_shape(spark):
    rows = ramp()
    for row in pixel_rows(image_table(spark, rows), RAMP).collect():
        assert row["v"] == cube(rows[row["image_id"]], RAMP)[row["y"], row["x"], row["c"]]
    shaped = with_shape(image_table(spark, rows), RAMP)
    assert flatten_images(shaped).columns == ["image_id", "features", "label"]
    with pytest.raises(Exception, match="row length"):
        with_shape(image_table(spark, rows), Shape(2, 2)).select("pixels").collect()


@pytest.mark.parametrize("k,stride,pad", [(3, 1, False), (2, 2, False), (3, 1, True), (4, 2, True)])
def test_ones_filter_is_a_window_sum(spark, k, stride, pad):
    rows = ramp()
    out = collected(cv.convolve(image_table(spark, rows), RAMP, np.ones((2, k * k * 3)), k, stride, pad))
    shape = RAMP.convolved(k, 2, stride, pad)
    first = -(k // 2) if pad else 0
    for n, oy, ox in itertools.product(range(2), range(shape.height), range(shape.width)):
        want = sum(patch_by_loops(rows[n], RAMP, k, first + ox * stride, first + oy * stride))
        assert np.allclose(cube(out[n], shape)[oy, ox], want)


def test_flipped_filters_convolve():
    bank = np.arange(12.0).reshape(1, -1)
    flipped = cv.pack_filters(bank, 3, 2, flip=True)
    assert flipped.reshape(2, 2, 3)[0, 0].tolist() == bank.reshape(2, 2, 3)[1, 1].tolist()


def test_flip_expression_matches_packing(spark):
    rows = np.arange(27.0).reshape(1, -1)
    turned = image_table(spark, rows).withColumn("pixels", vectors.flip_image(F.col("pixels"), 3))
    assert np.array_equal(collected(turned), cv.pack_filters(rows, 3, 3, flip=True))


@pytest.mark.parametrize("options", [{}, {"rescale": True}, {"norm": "floor"}, {"norm": "none"}, {"stride": 2}, {"pad": True}])
def test_layer_by_loops(spark, options):
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(3, RAMP.size))
    layer = cv.Layer(RAMP, 3, 4, seed=5, bandwidth=0.9, **options)
    out = collected(cv.layer_stack(image_table(spark, rows), [layer]), "features")
    bank, phase = cv.random_filters(layer), seeded.phases(4, 5)
    shape = layer.out_shape
    first = -1 if layer.pad else 0
    for n, oy, ox in itertools.product(range(3), range(shape.height), range(shape.width)):
        patch = np.array(patch_by_loops(rows[n], RAMP, 3, first + ox * layer.stride, first + oy * layer.stride))
        norm = {"offset": np.sqrt(((patch + 1e-12) ** 2).sum()), "floor": max(np.linalg.norm(patch), 1e-4), "none": 1.0}[layer.norm]
        want = np.cos(bank @ patch / norm + phase) * (norm if layer.rescale else 1.0)
        assert np.allclose(cube(out[n], shape)[oy, ox], want)


def test_zero_and_constant_images(spark):
    rows = np.stack([np.zeros(RAMP.size), np.ones(RAMP.size)])
    out = collected(cv.layer_stack(image_table(spark, rows), [cv.Layer(RAMP, 3, 4, rescale=True)]), "features")
    assert np.isfinite(out).all() and np.abs(out[0]).max() < 1e-10
    contrast = image_table(spark, rows).withColumn("pixels", vectors.contrast_normalize(F.col("pixels")))
    assert np.array_equal(collected(contrast), np.zeros_like(rows))


def test_layers_must_fit(spark):
    table = image_table(spark, ramp())
    first = cv.Layer(RAMP, 3, 4)
    with pytest.raises(ValueError, match="does not feed"):
        cv.layer_stack(table, [first, cv.Layer(RAMP, 2, 3)])
    with pytest.raises(ValueError, match="filters must be"):
        cv.convolve(table, RAMP, np.ones((2, 5)), 3)


def test_stacked_layers_equal_one_by_one(spark):
    rng = np.random.default_rng(1)
    table = image_table(spark, rng.normal(size=(4, 64)))
    first = cv.Layer(Shape(8, 8), 3, 4, seed=1, pool=2, pool_stride=2)
    second = cv.Layer(first.out_shape, 2, 5, seed=2, fastfood=True)
    both = collected(cv.layer_stack(table, [first, second]), "features")
    middle = cv.layer_stack(table, [first], out="pixels")
    assert np.allclose(both, collected(cv.layer_stack(middle, [second]), "features"))


def test_relational_form_equals_arrow_form(spark):
    rng = np.random.default_rng(2)
    shape = Shape(6, 5, 2)
    layer = cv.Layer(shape, 2, 3, seed=3, pool=2, pool_stride=2, rescale=True)
    table = image_table(spark, rng.normal(size=(3, shape.size)))
    want = collected(cv.layer_stack(table, [layer]), "features")
    out = layer.out_shape
    for row in cv.relational_conv_cosine_pool(table, layer).collect():
        assert np.isclose(row["v"], cube(want[row["image_id"]], out)[row["gy"], row["gx"], row["f"]])
    assert cv.relational_conv_cosine_pool(table, layer).count() == want.size


@pytest.mark.parametrize("pool,stride", [(2, 2), (4, 3), (3, 2), (2, 1), (5, 5), (1, 2)])
def test_mean_pool_by_loops(spark, pool, stride):
    rows = np.random.default_rng(3).normal(size=(2, RAMP.size))
    shape = RAMP.pooled(pool, stride)
    out = collected(pooling.mean_pool(image_table(spark, rows), RAMP, pool, stride))
    general = collected(pooling.general_pool(image_table(spark, rows), RAMP, pool, stride, "mean"))
    for n, gy, gx in itertools.product(range(2), range(shape.height), range(shape.width)):
        low_y, low_x = gy * stride, gx * stride
        window = cube(rows[n], RAMP)[low_y : low_y + pool, low_x : low_x + pool]
        assert np.allclose(cube(out[n], shape)[gy, gx], window.sum(axis=(0, 1)) / pool**2)
    assert np.allclose(out, general)


def test_pool_one_is_identity(spark):
    rows = ramp()
    assert np.array_equal(collected(pooling.mean_pool(image_table(spark, rows), RAMP, 1, 1)), rows)
    assert cv.Layer(RAMP, 3, 4).sides() is None


def test_own_pixel_and_pool_functions(spark):
    rows = ramp()
    table = image_table(spark, rows)
    spread = pooling.general_pool(
        table, RAMP, 2, 2, reducer=lambda v: F.array_max(v) - F.array_min(v), pixel=lambda v: v * F.lit(2.0)
    )
    shape = RAMP.pooled(2, 2)
    window = cube(rows[1], RAMP)[2:4, 2:4] * 2.0
    assert np.allclose(cube(collected(spread)[1], shape)[1, 1], window.max(axis=(0, 1)) - window.min(axis=(0, 1)))


def test_rectify_pool_equals_rectify_then_sum(spark):
    rows = np.random.default_rng(4).normal(size=(2, RAMP.size))
    table = image_table(spark, rows)
    fused = collected(pooling.rectify_pool(table, RAMP, 2, 2, 0.0, 0.1))
    both = table.withColumn("pixels", vectors.symmetric_rectify(F.col("pixels"), 3, 0.0, 0.1))
    wide = replace(RAMP, channels=6)
    assert np.allclose(fused, collected(pooling.general_pool(both, wide, 2, 2, "sum", start=1)))


def test_blur_rows_sum_to_one_and_mirror():
    side = pooling.blur_side(9, 2)
    assert np.allclose(side.sum(axis=1), 1.0)
    whole = pooling.blur_side(9, 1)
    assert np.allclose(whole, whole[::-1, ::-1])


def test_resize_keeps_constants_and_identity(spark):
    rows = ramp()
    assert np.allclose(collected(pooling.resize(image_table(spark, rows), RAMP, 7, 5)), rows)
    flat = np.full((1, RAMP.size), 3.0)
    assert np.allclose(collected(pooling.resize(image_table(spark, flat), RAMP, 256, 256)), 3.0)
    with pytest.raises(ValueError):
        pooling.resize_side(3, 4, "cubic")


def test_patch_bank_order_does_not_matter(spark):
    rows = np.random.default_rng(5).normal(size=(20, 64))
    table = image_table(spark, rows)
    bank = cv.sampled_filters(table, Shape(8, 8), 3, 6, 1)
    assert bank.shape == (6, 9)
    assert np.array_equal(bank, cv.sampled_filters(table.repartition(5), Shape(8, 8), 3, 6, 1))


def test_empty_table(spark):
    empty = image_table(spark, ramp()).filter("image_id < 0")
    assert cv.layer_stack(empty, [cv.Layer(RAMP, 3, 4)]).count() == 0
    assert patches.extract_patches(empty, RAMP, 3).count() == 0


@pytest.mark.parametrize("options", [{}, {"fastfood": True}, {"nonlinearity": "rectify", "norm": "none"}, {"pool": 2, "pool_stride": 2}])
def test_filter_blocks_do_not_change_results(monkeypatch, options):
    layer = cv.Layer(RAMP, 3, 100, seed=2, **options)
    rows = np.random.default_rng(6).normal(size=(3, RAMP.size))
    want = cv.layer_function(layer, lambda: cv.random_filters(layer), None)(rows)
    monkeypatch.setattr(cv, "MIN_FILTERS", 7)
    monkeypatch.setattr(cv, "BATCH_DOUBLES", 10)
    got = cv.layer_function(layer, lambda: cv.random_filters(layer), None)(rows)
    assert len(cv.filter_blocks(layer, 45)) > 3 or layer.fastfood
    assert np.allclose(got, want)


def test_floats_are_widened_inside_tasks(spark):
    rows = np.random.default_rng(7).normal(size=(5, 64)).astype(np.float32)
    narrow = image_table(spark, rows.astype(float)).withColumn("pixels", F.col("pixels").cast("array<float>"))
    layer = cv.Layer(Shape(8, 8), 3, 4)
    want = collected(cv.layer_stack(image_table(spark, rows.astype(float)), [layer]), "features")
    assert np.array_equal(collected(cv.layer_stack(narrow, [layer]), "features"), want)
    floats = cv.layer_stack(narrow, [layer], as_float=True)
    assert floats.schema["features"].dataType.simpleString() == "array<float>"
    assert np.array_equal(collected(floats, "features"), want.astype(np.float32))


def test_images_of_one_size_are_resampled_together(spark):
    rng = np.random.default_rng(9)
    sizes = [(4, 3, 1), (2, 6, 3), (4, 3, 3)]
    rows = [(k, *sizes[k % 3], rng.normal(size=int(np.prod(sizes[k % 3]))).tolist()) for k in range(60)] + [(99, None, None, None, None)]
    table = spark.createDataFrame(rows, "image_id bigint, width int, height int, n_channels int, pixels array<double>").coalesce(1)
    whole = pooling.resize_each(table, 5, 2)
    assert whole.count() == 61
    got = {r["image_id"]: r for r in whole.collect()}
    assert got[99]["pixels"] is None
    for k, w, h, c, pixels in rows[:60]:
        alone = pooling.resize(spark.createDataFrame([(k, pixels)], "image_id bigint, pixels array<double>"), Shape(w, h, c), 5, 2) if k < 6 else None
        assert (got[k]["width"], got[k]["height"], got[k]["n_channels"]) == (5, 2, c) and len(got[k]["pixels"]) == 10 * c
        if alone is not None:
            assert np.allclose(alone.first()["pixels"], got[k]["pixels"])

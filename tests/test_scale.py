"""No size, label or place may change what is computed."""

import numpy as np
import pytest
from conftest import collected, feature_table, image_table
from pyspark.sql import functions as F

from patchlight import seeded
from patchlight.layout import Shape
from patchlight.operators import evaluation, joins, patches, sampling, statistics
from patchlight.plans import runs
from patchlight.solvers import linear, softmax, whitening


def test_ridge_is_the_same_on_both_sides_of_the_gram_width(spark, embeddings):
    table = embeddings.selectExpr("vec_id AS image_id", "embedding AS features", "label")
    whole = linear.fit_ridge(table, 1.0, 10)
    blocks = linear.fit_ridge(table, 1.0, 10, gram_width=63)
    assert np.abs(whole.weights - blocks.weights).max() < 1e-6 and np.abs(whole.intercept - blocks.intercept).max() < 1e-6


@pytest.mark.parametrize("mean", [0.0, 1e6, 1e8])
def test_moments_far_from_zero(spark, mean):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(400, 5)), rng.integers(0, 3, 400)
    near, far = (linear.fit_ridge(feature_table(spark, x + m, y), 1.0, 3) for m in (0.0, mean))
    assert np.abs(near.weights - far.weights).max() < 1e-5
    made = whitening.fit_whitener(feature_table(spark, x + mean, y))
    assert np.allclose(made.covariance, np.cov(x.T, bias=True), atol=1e-5) and np.allclose(made.mean, x.mean(0) + mean, rtol=1e-9)


def test_unknown_and_null_labels_are_misses_everywhere(spark):
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(60, 6))
    labels = [*rng.integers(0, 6, 50).tolist(), *[-1] * 4, *[6] * 3, *[None] * 3]
    rows = [(i, label, s.tolist()) for i, (label, s) in enumerate(zip(labels, scores))]
    table = spark.createDataFrame(rows, "image_id bigint, label int, scores array<double>")
    order = np.argsort(-scores, axis=1, kind="stable")
    top1 = np.mean([label == order[i, 0] for i, label in enumerate(labels)])
    top5 = np.mean([label in order[i, :5].tolist() for i, label in enumerate(labels)])
    assert np.isclose(evaluation.accuracy(table).first()["accuracy"], top1)
    assert np.isclose(evaluation.top_k_accuracy(table, 5).first()["topk_accuracy"], top5)
    assert np.isclose(evaluation.top_k_accuracy(table, 50).first()["topk_accuracy"], 50 / 60)
    chance = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    loss = -np.log(chance[np.arange(50), labels[:50]] + 1e-12).sum() - 10 * np.log(1e-12)
    assert np.isclose(evaluation.cross_entropy(table).first()["loss"], loss)
    model = linear.LinearModel(np.eye(6), np.zeros(6))
    found = runs.evaluate(table.withColumnRenamed("scores", "features"), model)
    assert np.isclose(found["accuracy"], top1) and np.isclose(found["top5_accuracy"], top5) and found["n"] == 60


@pytest.mark.parametrize("classes", [64, 65])
def test_null_sources_vote_at_any_number_of_classes(spark, classes):
    rows = [(None, 1, [1.0] * classes), (None, 1, [3.0] * classes), (5, 2, [0.5] * classes)]
    table = spark.createDataFrame(rows, "source bigint, label int, scores array<double>")
    got = {r["source"]: (r["copies"], r["scores"]) for r in evaluation.average_scores(table, "source", classes).collect()}
    assert got == {None: (2, [2.0] * classes), 5: (1, [0.5] * classes)}


@pytest.mark.parametrize("stride,pad", [(1, False), (3, True)])
def test_patches_of_large_images_leave_in_bounded_batches(spark, stride, pad):
    shape = Shape(96, 80, 3)
    images = np.random.default_rng(3).normal(size=(3, shape.size))
    parts = list(patches.cut_patches(images, shape, 5, stride, pad, budget=20_000))
    assert max(block.size for *_, block in parts) <= max(20_000, 96 * 75)
    number, x0, y0, block = (np.concatenate(c) for c in zip(*parts))
    want = patches.patch_cube(images, shape, 5, stride, pad)
    assert np.array_equal(block, want.reshape(-1, 75)) and len(number) == 3 * want.shape[1] * want.shape[2]
    made = patches.extract_patches(image_table(spark, images), shape, 5, stride, pad)
    assert made.count() == len(number)
    text = made._jdf.queryExecution().toString()
    assert "Generate" not in text
    row = made.where((F.col("image_id") == 2) & (F.col("x0") == int(x0[-1])) & (F.col("y0") == int(y0[-1]))).first()
    assert row["patch"] == block[-1].tolist()


def test_sampled_patches_are_those_with_the_smallest_hash(spark):
    shape = Shape(9, 7, 2)
    images = np.random.default_rng(4).normal(size=(40, shape.size))
    table = image_table(spark, images).repartition(5)
    rows = sampling.sample_patches(table, shape, 3, 25, 11).collect()
    places = [(i, x, y) for i in range(40) for y in range(5) for x in range(7)]
    order = {p: int(seeded.order_values(np.array([p[0]]), np.array([p[1] + p[2] * 9]), 11)[0]) for p in places}
    assert {(r["image_id"], r["x0"], r["y0"]) for r in rows} == set(sorted(places, key=lambda p: (order[p], p))[:25])
    cube = images.reshape(40, 7, 9, 2)
    for r in rows:
        assert r["patch"] == cube[r["image_id"], r["y0"] : r["y0"] + 3, r["x0"] : r["x0"] + 3].reshape(-1).tolist()
    assert sampling.sample_patches(table, shape, 3, 10_000, 11).count() == len(places)
    assert sampling.sample_patches(table, shape, 3, 0, 11).count() == 0
    assert "Generate" not in sampling.sample_patches(table, shape, 3, 25, 11)._jdf.queryExecution().toString()


def test_order_hashes_of_far_keys_and_places(spark):
    keys = [(5, 4099), (1_000_008, 0), (0, 0), (1_000_003, 0), (0, 1), (2**60 + 7, 3), (-4, 2)]
    table = spark.createDataFrame(keys, "k bigint, p bigint")
    got = {(r["k"], r["p"]): r["h"] for r in seeded.with_order(table, "h", F.col("k"), F.col("p"), 3).collect()}
    assert len(set(got.values())) == len(keys)
    for k, p in keys:
        assert got[k, p] == int(seeded.order_values(np.array([k]), np.array([p]), 3)[0])


def test_lookups_too_wide_to_broadcast_are_salted_and_equal(spark, monkeypatch):
    facts = spark.createDataFrame([(1, {"a": 1})] * 30 + [(2, {"b": 2})], "k int, m map<string,int>")
    lookup = spark.createDataFrame([(1, "x" * 100), (3, "y")], "k int, v string")
    small = sorted(map(str, joins.lookup_join(facts, lookup, "k").collect()))
    monkeypatch.setattr(joins, "BROADCAST_CHARS", 50)
    assert sorted(map(str, joins.lookup_join(facts, lookup, "k").collect())) == small and len(small) == 30


def test_line_search_takes_one_pass_and_never_stands_still(spark):
    rng = np.random.default_rng(5)
    table = feature_table(spark, rng.normal(size=(50, 4)), rng.integers(0, 3, 50))
    weights, direction = rng.normal(size=(3, 4)), rng.normal(size=(3, 4))
    sizes = np.array([0.0, 0.5, 2.0])
    want = [softmax.penalised(softmax.softmax_pass(table, weights + s * direction), weights + s * direction, 0.1) for s in sizes]
    assert np.allclose(softmax.line_losses(table, weights, direction, sizes, 0.1), want)
    with pytest.raises(RuntimeError, match="no step"):
        softmax.backtrack(lambda sizes: np.full(len(sizes), 9.0), 1.0, direction)
    assert softmax.backtrack(lambda sizes: np.full(len(sizes), 9.0), 1.0, 0 * direction) == 1.0


def test_unknown_nonlinearity_is_an_error(spark, embeddings):
    from patchlight.operators import convolve as cv

    table = image_table(spark, np.zeros((2, 64)))
    with pytest.raises(Exception, match="nonlinearity"):
        cv.layer_stack(table, [cv.Layer(Shape(8, 8, 1), 3, 2, nonlinearity="sine")]).collect()


def test_grand_totals_of_empty_tables(spark):
    assert collected(patches.extract_patches(image_table(spark, np.zeros((0, 27))), Shape(3, 3, 3), 2), "patch").size == 0
    assert np.array_equal(statistics.provisional_mean(feature_table(spark, np.zeros((0, 4))), 4), np.zeros(4))


def test_mixed_sizes_are_forced_to_one(spark):
    from patchlight.operators import pooling

    rng = np.random.default_rng(6)
    sizes = [(4, 3, 3), (6, 6, 1), (4, 3, 3), (1, 2, 2)]
    images = [rng.normal(size=w * h * c) for w, h, c in sizes]
    rows = [(k, *s, x.tolist()) for k, (s, x) in enumerate(zip(sizes, images))] + [(9, -1, -1, -1, None)]
    table = spark.createDataFrame(rows, "image_id bigint, width int, height int, n_channels int, pixels array<double>")
    got = {r["image_id"]: r for r in pooling.resize_each(table, 5, 2).collect()}
    assert got[9]["pixels"] is None and len(got) == 5
    for k, ((w, h, c), x) in enumerate(zip(sizes, images)):
        want = pooling.pool_cube(x.reshape(1, h, w, c), pooling.resize_sides(Shape(w, h, c), 5, 2)).reshape(-1)
        assert np.allclose(got[k]["pixels"], want) and (got[k]["width"], got[k]["height"], got[k]["n_channels"]) == (5, 2, c)


def test_banks_of_any_size_are_drawn_in_blocks(spark, embeddings, monkeypatch):
    from patchlight.layout import as_images
    from patchlight.operators import convolve as cv

    table = as_images(embeddings.limit(20), "vec_id", "embedding")
    layer = cv.Layer(Shape(8, 8, 1), 5, 200, seed=3)
    want = collected(cv.layer_stack(table, [layer]), "features")
    monkeypatch.setattr(cv, "MODEL_VALUES", 1000)
    monkeypatch.setattr(cv, "BATCH_DOUBLES", 4000)
    assert np.allclose(collected(cv.layer_stack(table, [layer]), "features"), want, atol=1e-12)
    monkeypatch.undo()
    huge = cv.Layer(Shape(1, 1, 32_768), 1, 16_384, seed=3)
    assert huge.filters * huge.inputs > cv.MODEL_VALUES
    cv.layer_stack(image_table(spark, np.zeros((1, 32_768))), [huge])
    small = cv.Layer(Shape(1, 1, 32_768), 1, 8, seed=3)
    assert np.array_equal(cv.random_filters(huge, 2, 5), cv.random_filters(small)[2:5])

"""Fits, draws and models that must not depend on width, number of settings or table size."""

import numpy as np
import pytest
from conftest import SF_DIR, collected, feature_table
from test_solvers import problem, softmax_by_hand

from patchlight import seeded
from patchlight.functions import batches
from patchlight.operators import random_features, sampling, statistics
from patchlight.plans import runs
from patchlight.plans.catalog import QUERIES
from patchlight.plans.config import SolveConf
from patchlight.solvers import linear, parts, softmax


@pytest.fixture
def scans(monkeypatch):
    """Counts the scans that sum something."""
    seen = []

    def counted(*args, **kwargs):
        seen.append(args[3:5])
        return batches.sum_rows(*args, **kwargs)

    for module in (linear, softmax, statistics, sampling):
        monkeypatch.setattr(module, "sum_rows", counted)
    return seen


def log_loss_slope(rows, labels, model, reg):
    chance = softmax_by_hand(np.column_stack([rows, np.ones(len(rows))]), np.column_stack([model.weights.T, model.intercept]))
    rest = np.eye(model.weights.shape[1])[labels] - chance
    return np.abs(rest.T @ rows / len(rows) - reg * model.weights.T).max(), np.abs(rest.mean(axis=0)).max()


def test_quasi_newton_settles_for_every_weight_in_shared_scans(spark, scans):
    rows, labels = problem()
    rows = rows * np.geomspace(0.1, 10, 12) + np.linspace(-500, 500, 12)  # features of unlike size, far from zero
    table = feature_table(spark, rows, labels)
    regs = [0.1, 1.0, 10.0]
    models = softmax.softmax_quasi_newton(table, regs, 200, 1e-7)
    together = len(scans)
    for reg, model in zip(regs, models, strict=True):
        assert max(log_loss_slope(rows, labels, model, reg)) < 1e-4
    alone = []
    for reg, model in zip(regs, models, strict=True):
        scans.clear()
        one = softmax.softmax_quasi_newton(table, [reg], 200, 1e-7)[0]
        alone.append(len(scans))
        assert np.allclose(one.weights, model.weights, atol=1e-5)
    assert together == max(alone) < sum(alone)


def test_quasi_newton_says_when_it_has_not_settled(spark):
    rows, labels = problem()
    with pytest.warns(UserWarning, match="not settled"):
        softmax.softmax_quasi_newton(feature_table(spark, rows, labels), [1e-3], 3, 1e-12)
    with pytest.raises(ValueError):
        softmax.softmax_quasi_newton(feature_table(spark, np.zeros((0, 3))), [1.0], classes=2)


def test_settings_beyond_one_broadcast_go_in_several_scans(spark, monkeypatch, scans):
    rows, labels = problem()
    table = feature_table(spark, rows, labels)
    weights = 0.05 * np.random.default_rng(0).normal(size=(5, 4, 12))
    whole = softmax.stacked_pass(table, weights)
    assert len(scans) == 1
    monkeypatch.setattr(softmax, "MODEL_VALUES", 2 * 4 * 12 + 12)
    split = softmax.stacked_pass(table, weights)
    assert len(scans) == 4
    assert np.allclose(whole.gradients, split.gradients) and np.allclose(whole.losses, split.losses)
    for w, loss, gradient in zip(weights, whole.losses, whole.gradients, strict=True):
        single = softmax.softmax_pass(table, w)
        assert np.allclose(single.gradient, gradient) and np.isclose(single.loss / single.rows, loss)


@pytest.mark.parametrize("solver", ["ridge", "weighted_ridge", "softmax_newton", "log_rest", "hinge"])
def test_a_sweep_has_as_many_scans_as_one_fit(spark, scans, solver):
    rows, labels = problem(skew=True)
    table = feature_table(spark, rows, labels)
    confs = [SolveConf(solver, reg, iterations=3, classes=4, mixture=0.3) for reg in (0.05, 0.5, 5.0)]
    models = runs.fit_all(table, confs)
    many = len(scans)
    scans.clear()
    runs.fit_all(table, confs[:1])
    assert many == len(scans)
    for conf, model in zip(confs, models, strict=True):
        one = runs.fit(table, conf)
        assert np.allclose(one.weights, model.weights) and np.allclose(one.intercept, model.intercept)
    side = runs.evaluate_all(table, models, [2, 3, 9])
    for model, found, top in zip(models, side, [2, 3, 9], strict=True):
        assert found == pytest.approx(runs.evaluate(table, model, top))


@pytest.mark.parametrize("width,block", [(11, 3), (12, 4), (5, 8), (64, 24)])
def test_tiles_cover_the_matrix(spark, width, block):
    rows = np.random.default_rng(1).normal(size=(40, width))
    tiles = statistics.gram_tiles(feature_table(spark, rows), width, block, 0.5, doubles=2 * block**2)
    gram = np.zeros((width, width))
    for cell in statistics.gram_cells(tiles, block).collect():
        gram[cell["i"], cell["j"]] = cell["v"]
    assert np.allclose(gram, rows.T @ rows + 0.5 * np.eye(width))
    assert {(r["bi"], r["bj"]) for r in tiles.collect()} == set(statistics.tile_pairs(-(-width // block)))


def test_tiles_of_wide_vectors_are_few_scans_of_bounded_tasks():
    for block in (512, 1024, 4096):
        scans = statistics.tile_scans(65536, block)
        blocks = 65536 // block
        assert len(scans) <= blocks and sum(map(len, scans)) == blocks * (blocks + 1) // 2
        assert max(map(len, scans)) * block**2 <= max(statistics.TILE_DOUBLES, 0.6 * block * 65536)


def test_wide_ridge_solves_several_blocks_in_a_scan(spark, monkeypatch, scans):
    rows, labels = problem(d=23)
    table = feature_table(spark, rows, labels)
    narrow = linear.fit_ridge(table, 2.0, 4, block=4, passes=3, mixture=0.2)
    found = {}
    for blocks in (1, 2, 3, 6):
        monkeypatch.setattr(linear, "MODEL_VALUES", linear.group_height(blocks, 4, 4) * 4)
        scans.clear()
        found[blocks] = linear.fit_ridge(table, 2.0, 4, block=4, passes=3, mixture=0.2, gram_width=6)
        assert len(scans) == 1 + 3 * -(-6 // blocks)
        assert np.allclose(found[blocks].weights, narrow.weights) and np.allclose(found[blocks].intercept, narrow.intercept)


def test_models_too_large_to_broadcast_score_by_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows, model = rng.normal(size=(70, 13)), linear.LinearModel(rng.normal(size=(13, 7)), rng.normal(size=7))
    table = feature_table(spark, rows, np.arange(70) % 7)
    want = rows @ model.weights + model.intercept
    assert np.allclose(collected(model.transform(table), "scores"), want)
    by_parts = parts.scores_by_parts(table, "image_id", model.table(spark), 7, features=4, class_block=3, group_values=60)
    assert np.allclose(collected(by_parts, "scores"), want)
    assert by_parts.count() == 70
    out = parts.scored(table, "image_id", model, limit=10)
    assert sorted(out.columns) == ["image_id", "label", "scores"] and np.allclose(collected(out, "scores"), want)
    assert parts.scored(table, "image_id", model).columns == ["image_id", "label", "scores"]
    monkeypatch.setattr(batches, "MODEL_VALUES", 20)
    for fit in (
        lambda: model.transform(table),
        lambda: softmax.softmax_pass(table, model.weights.T),
        lambda: softmax.line_losses(table, model.weights.T, model.weights.T, np.ones(2), 0.1),
        lambda: softmax.rest_descent(table, "hinge", [0.1], 1, 7),
        lambda: linear.dual_coefficients(table, model, 0.1),
    ):
        with pytest.raises(ValueError, match="too many to broadcast"):
            fit()


@pytest.mark.parametrize("most,counts", [(64, 1 << 18), (2, 16), (1, 8)])
def test_numbers_are_found_by_splitting_hit_intervals(spark, most, counts):
    ids = np.arange(0, 15000, 5)
    keys = spark.createDataFrame([(int(i),) for i in ids], "key bigint").repartition(4)
    ordered = ids[np.lexsort((ids, seeded.order_values(ids, np.int64(0), 3)))]
    numbers = np.array([0, 1, 7, 700, 701, 1500, 2999])
    found = sampling.numbered_members(keys, numbers, 3, len(ids), most, counts)
    rows = {r["number"]: r["key"] for r in found.collect()}
    assert {n: rows[n] for n in numbers.tolist()} == {n: int(ordered[n]) for n in numbers.tolist()}
    assert all(ordered[n] == key for n, key in rows.items())
    assert len(rows) <= max(most, 1) * len(numbers) if most < 64 else len(rows) <= 64 * len(numbers)


def test_draws_rank_rows_in_proportion_to_the_draws(spark, scans):
    table = spark.range(200_000).selectExpr("id AS image_id")
    pairs = sampling.sample_pairs(table, "image_id", 20, 4)
    assert pairs.count() == 20
    numbers = np.arange(0, 200_000, 20_000)
    found = sampling.numbered_members(table.selectExpr("image_id AS key"), numbers, 4, 200_000)
    assert found.count() <= 64 * len(numbers)


def test_log_loss_query_is_stationary(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    assert QUERIES["logistic_ml"](spark, SF_DIR).count() == rows


def test_fast_draws_are_the_integer_draws():
    for rows, columns, seed, first in ((7, 5, 0, 0), (3, 40000, 11, 0), (300, 70, 123456, 5_000_000)):
        f, px = np.arange(first, first + rows)[:, None], np.arange(columns)[None, :]
        for stream in (seeded.NORMAL_A, seeded.CHI_B):
            assert np.array_equal(seeded.fast_mixed(f.astype(float), px.astype(float), seed, stream), seeded.mixed(f, px, seed, stream))
        whole = seeded.normals(rows, columns, seed, first=first)
        assert np.array_equal(whole[2:], seeded.normals(rows - 2, columns, seed, first=first + 2))


def test_wide_banks_are_drawn_in_blocks_without_a_broadcast(spark, monkeypatch):
    rows = np.random.default_rng(3).normal(size=(30, 12))
    table = feature_table(spark, rows)
    for weights in random_features.WEIGHTS:
        small = collected(random_features.cosine_features(table, 12, 50, 4, weights=weights), "features")
        with monkeypatch.context() as patched:
            patched.setattr(random_features, "BANK_VALUES", 100)
            patched.setattr(random_features, "BLOCK_VALUES", 12 * 7)
            patched.setattr(random_features, "shared_matrix", None)
            wide = random_features.cosine_features(table, 12, 50, 4, weights=weights)
            assert np.allclose(collected(wide, "features"), small, atol=1e-12)
            assert sorted(wide.columns) == sorted(table.columns)
    bank, phase = np.random.default_rng(4).normal(size=(50, 12)), np.linspace(0, 1, 50)
    monkeypatch.setattr(random_features, "BANK_VALUES", 100)
    monkeypatch.setattr(random_features, "BLOCK_VALUES", 12 * 7)
    given = random_features.cosine_features_given(table, bank, phase)
    assert np.allclose(collected(given, "features"), np.cos(rows @ bank.T + phase))

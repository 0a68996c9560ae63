"""Whitening, ridge, softmax and evaluation against NumPy."""

import numpy as np
import pytest
from conftest import collected, feature_table, image_table
from pyspark.sql import functions as F

from patchlight.layout import Shape
from patchlight.operators import convolve as cv
from patchlight.operators import evaluation, kernels
from patchlight.operators.patches import patch_cube
from patchlight.operators.sampling import position_blocks
from patchlight.operators.statistics import observed
from patchlight.solvers import linear, softmax, whitening


def problem(n=300, d=12, k=4, seed=0, skew=False):
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, k, n)
    if skew:
        labels[: n // 3] = 0
    rows = rng.normal(size=(n, d)) + rng.normal(size=(k, d))[labels]
    return rows, labels


def indicator(labels, k):
    return np.where(np.arange(k)[None, :] == labels[:, None], 1.0, -1.0)


def ridge_by_hand(rows, labels, k, lam, weights=None):
    w = np.ones(len(rows)) if weights is None else weights
    y = indicator(labels, k)
    mean, target = (w[:, None] * rows).sum(0) / w.sum(), (w[:, None] * y).sum(0) / w.sum()
    x, t = rows - mean, y - target
    solution = np.linalg.solve(x.T @ (w[:, None] * x) + lam * np.eye(rows.shape[1]), x.T @ (w[:, None] * t))
    return solution, target - mean @ solution


def test_ridge(spark):
    rows, labels = problem()
    table = feature_table(spark, rows, labels)
    model = linear.fit_ridge(table, 0.7)
    weights, intercept = ridge_by_hand(rows, labels, 4, 0.7)
    assert np.allclose(model.weights, weights) and np.allclose(model.intercept, intercept)
    assert linear.normal_residual(table, model, 0.7) < 1e-10
    assert np.allclose(collected(model.transform(table), "scores"), rows @ weights + intercept)


@pytest.mark.parametrize("order", ["shuffled", "one", "seven"])
def test_fit_does_not_depend_on_order(spark, order):
    rows, labels = problem()
    table = feature_table(spark, rows, labels)
    other = {"shuffled": table.orderBy(F.xxhash64("image_id")), "one": table.repartition(1), "seven": table.repartition(7)}[order]
    for options in ({}, {"mixture": 0.5}, {"block": 5, "passes": 2}):
        a, b = linear.fit_ridge(table, 0.5, 4, **options), linear.fit_ridge(other, 0.5, 4, **options)
        assert np.allclose(a.weights, b.weights, atol=1e-12)


def test_weighted_ridge_with_a_hot_class(spark):
    rows, labels = problem(skew=True)
    table = feature_table(spark, rows, labels)
    counts = np.bincount(labels, minlength=4)
    weights = 0.7 + 0.3 * len(labels) / (4 * counts[labels])
    model = linear.fit_ridge(table, 0.5, 4, mixture=0.3)
    assert np.allclose(model.weights, ridge_by_hand(rows, labels, 4, 0.5, weights)[0])
    plain = linear.fit_ridge(table, 0.5, 4, mixture=0.0)
    assert np.allclose(plain.weights, ridge_by_hand(rows, labels, 4, 0.5)[0])
    assert linear.normal_residual(table, model, 0.5, mixture=0.3) < 1e-10


def test_block_passes_converge_to_ridge(spark):
    rows, labels = problem()
    table = feature_table(spark, rows, labels)
    exact = linear.fit_ridge(table, 2.0, 4)
    for gram_width in (4096, 6):
        model = linear.fit_ridge(table, 2.0, 4, block=5, passes=25 if gram_width > 6 else 8, gram_width=gram_width)
        assert np.abs(model.weights - exact.weights).max() < 1e-3
    wide = linear.fit_ridge(table, 2.0, 4, block=5, passes=2, mixture=0.2, gram_width=6)
    narrow = linear.fit_ridge(table, 2.0, 4, block=5, passes=2, mixture=0.2)
    assert np.allclose(wide.weights, narrow.weights) and np.allclose(wide.intercept, narrow.intercept)


def test_sweep_equals_single_fits(spark):
    rows, labels = problem()
    table = feature_table(spark, rows, labels)
    for lam, model in linear.ridge_sweep(table, [0.1, 1.0, 10.0]).items():
        assert np.allclose(model.weights, ridge_by_hand(rows, labels, 4, lam)[0])


def test_reg_modes(spark):
    rows, labels = problem()
    table = feature_table(spark, rows, labels)
    for mode, lam in (("trace_over_d", 0.1 * (rows**2).sum() / 12), ("trace_over_n", 0.1 * (rows**2).sum() / 300)):
        assert np.allclose(linear.fit_ridge(table, 0.1, 4, reg_mode=mode).weights, ridge_by_hand(rows, labels, 4, lam)[0])
    with pytest.raises(ValueError):
        linear.fit_ridge(table, 0.1, 4, reg_mode="x")


def test_dual_equals_primal(spark):
    rows, labels = problem()
    table = feature_table(spark, rows, labels)
    model = linear.fit_ridge(table, 0.1, 4)
    duals = linear.dual_coefficients(table, model, 0.1)
    x, y = rows - rows.mean(0), indicator(labels, 4)
    by_hand = np.linalg.solve(x @ x.T + 0.1 * np.eye(len(x)), y - y.mean(0))
    assert np.allclose(collected(duals, "alpha"), by_hand, atol=1e-8)
    scores = collected(kernels.dual_scores(duals, table, 12, 4), "scores")
    assert np.allclose(scores, rows @ (x.T @ by_hand), atol=1e-8)
    primal = collected(model.transform(table), "scores")
    assert np.array_equal((scores + model.intercept).argmax(1), primal.argmax(1))
    with pytest.raises(ValueError):
        linear.dual_coefficients(table, model, 0.0)


def test_one_class_and_bad_labels(spark):
    rows, labels = problem()
    one = feature_table(spark, rows, np.zeros(len(rows), int))
    model = linear.fit_ridge(one, 1.0)
    assert model.weights.shape == (12, 1) and np.allclose(model.weights, 0)
    with pytest.raises(Exception, match="labels must lie"):
        linear.fit_ridge(feature_table(spark, rows, labels), 1.0, 2)


def test_empty_fit_is_refused(spark):
    rows, labels = problem()
    with pytest.raises(ValueError, match="empty"):
        linear.fit_ridge(feature_table(spark, rows, labels).filter("image_id < 0"), 1.0, 4)


def test_model_table_roundtrip(spark):
    rows, labels = problem()
    model = linear.fit_ridge(feature_table(spark, rows, labels), 1.0)
    back = linear.LinearModel.from_table(model.table(spark))
    assert np.array_equal(back.weights, model.weights) and np.array_equal(back.intercept, model.intercept)


def softmax_by_hand(rows, w):
    s = rows @ w.T
    s = np.exp(s - s.max(1, keepdims=True))
    return s / s.sum(1, keepdims=True)


def test_softmax_newton(spark):
    rows, labels = problem()
    table = feature_table(spark, rows, labels)
    hot, n = np.eye(4)[labels], len(rows)
    gram = rows.T @ rows / n
    lam = 0.01 * np.trace(gram) / 12
    w = np.zeros((4, 12))
    for _ in range(4):
        gradient = (hot - softmax_by_hand(rows, w)).T @ rows / n - lam * w
        w = w + np.linalg.solve(gram + lam * np.eye(12), gradient.T).T
    model = softmax.softmax_newton(table, 0.01, 4)
    assert np.allclose(model.weights.T, w)
    slopes = [
        np.abs(softmax.softmax_pass(table, at).gradient - lam * at).max() for at in (np.zeros((4, 12)), model.weights.T)
    ]
    assert slopes[1] < 0.5 * slopes[0]


def test_softmax_descent_and_line_search(spark):
    rows, labels = problem()
    table = feature_table(spark, rows, labels)
    hot, n, w = np.eye(4)[labels], len(rows), np.zeros((4, 12))
    for k in range(3):
        w = w + 0.5 / (k + 1) * ((hot - softmax_by_hand(rows, w)).T @ rows / n - 0.01 * w)
    assert np.allclose(softmax.softmax_descent(table, 0.01, 3, lambda k: 0.5 / (k + 1)).weights.T, w)
    trace = []
    searched = softmax.softmax_descent(table, 0.01, 5, "backtrack", trace=trace)
    assert trace == sorted(trace, reverse=True)
    assert softmax.softmax_loss(table, searched) < trace[0] / n


def test_softmax_blocks_by_hand(spark):
    rows, labels = problem()
    table = feature_table(spark, rows, labels)
    hot, n, w = np.eye(4)[labels], len(rows), np.zeros((4, 12))
    lam = 0.01 * (rows**2).mean()
    for epoch in range(2):
        for block in position_blocks(12, 5, 1 + epoch):
            own = rows[:, block]
            gram = own.T @ own / n + lam * np.eye(len(block))
            for _ in range(2):
                gradient = (hot - softmax_by_hand(rows, w)).T @ own / n - lam * w[:, block]
                w[:, block] += np.linalg.solve(gram, gradient.T).T
    model = softmax.softmax_block_newton(table, 0.01, 2, block=5, epochs=2, seed=1)
    assert np.allclose(model.weights.T, w)


@pytest.mark.parametrize("loss", ["log", "hinge"])
def test_named_losses(spark, loss):
    rows, labels = problem()
    table = feature_table(spark, rows, labels)
    # Counters leave state in the session, which models must not drag into tasks.
    counted, seen = observed(table, f"counted_{loss}")
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == len(rows)
    model = softmax.fit_named_loss(table, loss, 0.01, 20)
    assert evaluation.accuracy(model.transform(table)).first()["accuracy"] > 0.7
    with pytest.raises(ValueError):
        softmax.fit_named_loss(table, "cubic", 0.1)


def test_logistic_fit_is_stationary(spark):
    rows, labels = problem()
    model = softmax.fit_named_loss(feature_table(spark, rows, labels), "log", 0.0, 200)
    chance = softmax_by_hand(np.column_stack([rows, np.ones(len(rows))]), np.column_stack([model.weights.T, model.intercept]))
    assert np.abs((np.eye(4)[labels] - chance).T @ rows / len(rows)).max() < 1e-3


def test_whitener(spark):
    rows = np.random.default_rng(1).normal(size=(400, 6)) @ np.random.default_rng(2).normal(size=(6, 6))
    table = feature_table(spark, rows)
    model = whitening.fit_whitener(table, epsilon=0.1)
    white = collected(model.transform(table), "features")
    values, basis = np.linalg.eigh(np.cov(rows.T, bias=True))
    assert np.allclose(np.cov(white.T, bias=True), (basis * (values / (values + 0.1))) @ basis.T)
    assert np.allclose(white.mean(0), 0)
    root = model.covariance_root()
    assert np.allclose(root @ root.T, model.covariance, atol=1e-6)
    back = whitening.Whitener.from_table(model.table(spark))
    assert np.array_equal(back.matrix, model.matrix) and np.array_equal(back.covariance, model.covariance)


def test_patch_whitener_on_all_and_on_a_sample(spark):
    shape = Shape(6, 6, 1)
    rows = np.random.default_rng(3).normal(size=(50, 36))
    table = image_table(spark, rows)
    whole = whitening.fit_patch_whitener(table, shape, 3)
    cut = patch_cube(rows, shape, 3).reshape(-1, 9)
    assert np.allclose(whole.covariance, np.cov(cut.T, bias=True))
    assert np.allclose(whitening.fit_patch_whitener(table, shape, 3, sample=50 * 16).matrix, whole.matrix)
    assert whitening.fit_patch_whitener(table, shape, 3, sample=100).matrix.shape == (9, 9)


def test_covariance_shaped_filters(spark):
    shape = Shape(6, 6, 1)
    table = image_table(spark, np.random.default_rng(4).normal(size=(50, 36)))
    whitener = whitening.fit_patch_whitener(table, shape, 3)
    bank = cv.random_filters(cv.Layer(shape, 3, 20000, whitener=whitener))
    assert np.abs(np.cov(bank.T, bias=True) - whitener.covariance).max() < 0.05
    packed = cv.pack_filters(bank[:4], 1, 3, whitener)
    assert np.allclose(packed, whitener.apply(bank[:4]) @ whitener.matrix.T)


def scored_table(spark, scores, labels):
    rows = [(i, int(label), [float(s) for s in row]) for i, (row, label) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "image_id bigint, label int, scores array<double>")


def test_measures(spark):
    rng = np.random.default_rng(6)
    scores, labels = rng.normal(size=(200, 8)), rng.integers(0, 8, 200)
    table = scored_table(spark, scores, labels)
    order = np.argsort(-scores, axis=1, kind="stable")
    assert np.isclose(evaluation.accuracy(table).first()["accuracy"], (order[:, 0] == labels).mean())
    assert np.isclose(evaluation.top_k_accuracy(table, 5).first()["topk_accuracy"], (order[:, :5] == labels[:, None]).any(1).mean())
    chance = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    assert np.isclose(evaluation.cross_entropy(table).first()["loss"], -np.log(chance[np.arange(200), labels]).sum())
    table_counts = {(r["label"], r["prediction"]): r["n"] for r in evaluation.confusion(table).collect()}
    assert sum(table_counts.values()) == 200
    for row in evaluation.class_report(table).collect():
        assert row["actual"] == (labels == row["class"]).sum() and row["predicted"] == (order[:, 0] == row["class"]).sum()


def test_ties_go_to_the_lower_class(spark):
    table = scored_table(spark, np.ones((3, 6)), [0, 4, 5])
    assert np.isclose(evaluation.accuracy(table).first()["accuracy"], 1 / 3)
    assert np.isclose(evaluation.top_k_accuracy(table, 5).first()["topk_accuracy"], 2 / 3)


@pytest.mark.parametrize("classes", [2, 70])
def test_augmented_average(spark, classes):
    """Copies of a source need not be adjacent, and one source may hold a third of all rows."""
    ids = [3, 4, 3, 4] + [9] * 300 + list(range(100, 700))
    rng = np.random.default_rng(7)
    scores = rng.normal(size=(len(ids), classes))
    rows = [(i, i % classes, s.tolist()) for i, s in zip(ids, scores)]
    table = spark.createDataFrame(rows, "source bigint, label int, scores array<double>").repartition(6)
    got = {r["source"]: r for r in evaluation.average_scores(table, "source", classes).collect()}
    assert len(got) == len(set(ids))
    for source in (3, 4, 9, 100):
        own = scores[[i for i, s in enumerate(ids) if s == source]]
        assert got[source]["copies"] == len(own) and np.allclose(got[source]["scores"], own.mean(0))
    voted = evaluation.augmented_accuracy(table, "source", classes).first()
    assert voted["n"] == len(set(ids))

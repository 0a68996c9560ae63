"""Random features, kernels, samples and sums."""

import numpy as np
import pytest
from conftest import collected, feature_table, image_table
from pyspark.sql import functions as F

from patchlight import seeded
from patchlight.functions import vectors
from patchlight.layout import Shape
from patchlight.operators import joins, kernels, patches, sampling, statistics
from patchlight.operators import random_features as rf


def gaussian_rows(n, d, seed=0):
    return np.random.default_rng(seed).normal(size=(n, d))


def unit_rows(n, d, seed=0):
    rows = gaussian_rows(n, d, seed)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def test_draws_agree_between_numpy_and_columns(spark):
    table = spark.range(40).select((F.col("id") % 8).alias("f"), F.floor(F.col("id") / 8).cast("bigint").alias("px"))
    column = table.withColumn("t", seeded.mixed_column(F.col("f"), F.col("px"), 7, 2)).collect()
    for row in column:
        assert row["t"] == seeded.mixed(np.int64(row["f"]), np.int64(row["px"]), 7, 2)


def test_draws_look_normal():
    draws = seeded.normals(512, 64, 3)
    assert abs(draws.mean()) < 0.02 and abs(draws.std() - 1) < 0.02
    assert np.abs(np.corrcoef(draws[:50]) - np.eye(50)).max() < 0.6
    phases = seeded.phases(4096, 3)
    assert abs(phases.mean() - np.pi) < 0.1 and phases.min() > 0 and phases.max() < 2 * np.pi


@pytest.mark.parametrize("width", [1, 2, 8, 64, 128, 4096])
def test_hadamard_twice_is_a_multiple(width):
    rows = gaussian_rows(3, width)
    assert np.allclose(rf.hadamard_rows(rf.hadamard_rows(rows)), width * rows)


def test_hadamard_is_the_sylvester_matrix():
    matrix = np.array([[1.0]])
    for _ in range(7):
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    assert np.array_equal(rf.hadamard_rows(np.eye(128)), matrix)
    with pytest.raises(ValueError):
        rf.hadamard_rows(np.ones((1, 6)))


def kernel_gap(project, rows, sigma, outputs, seed):
    phase = seeded.phases(outputs, seed)
    lifted = np.sqrt(2.0 / outputs) * np.cos(project(rows) + phase)
    return np.abs(lifted @ lifted.T - kernels.gaussian_kernel(rows, rows, sigma))


@pytest.mark.parametrize("d,sigma", [(4, 1.0), (9, 1.0), (64, 1.0)])
def test_cosine_features_approximate_the_kernel(d, sigma):
    """Close points, so that the kernel is far from 0 and 1; the mean is over ten seeds,
    as the errors of one seed go together."""
    gaps = []
    for seed in range(10):
        bank = seeded.normals(8192, d, seed) / sigma
        gaps.append(kernel_gap(lambda rows: rows @ bank.T, unit_rows(64, d), sigma, 8192, seed))
    assert np.mean(gaps) <= 1e-2 and np.max(gaps) <= 1e-1


@pytest.mark.parametrize("permute", [True, False])
@pytest.mark.parametrize("d,sigma", [(4, 1.0), (9, 1.0), (64, 0.8)])
def test_fastfood_approximates_the_kernel(d, sigma, permute):
    parts = rf.fastfood_matrices(d, 8192, 1, permute)
    gap = kernel_gap(lambda rows: rf.fastfood_rows(rows, parts, 8192, sigma), unit_rows(64, d), sigma, 8192, 1)
    assert gap.max() <= 1e-1


def test_wide_spread_rows_have_a_unit_kernel():
    rows = 17 + 32 * gaussian_rows(64, 4)
    bank = seeded.normals(8192, 4, 2)
    assert kernel_gap(lambda x: x @ bank.T, rows, 1.0, 8192, 2).mean() <= 1e-2


def test_fastfood_output_length_and_scale(spark):
    rows = gaussian_rows(5, 9)
    table = feature_table(spark, rows)
    batch = collected(rf.fastfood(table, 9, 40, 3, 2.0), "features")
    vector = collected(rf.fastfood(table, 9, 40, 3, 2.0, root=False), "features")
    assert batch.shape == (5, 40) and np.allclose(batch * 4.0, vector)


def test_cosine_features_given_and_seeded_agree(spark):
    table = feature_table(spark, gaussian_rows(6, 8))
    bank, phase = 0.5 * seeded.normals(32, 8, 9), seeded.phases(32, 9)
    seeded_form = collected(rf.cosine_features(table, 8, 32, 9, 0.5), "features")
    assert np.allclose(seeded_form, collected(rf.cosine_features_given(table, bank, phase), "features"))
    projected = table.withColumn("features", F.col("features"))
    assert np.allclose(collected(rf.cosine_node(projected, np.zeros(8)), "features"), np.cos(gaussian_rows(6, 8)))
    with pytest.raises(ValueError, match="as many phases"):
        rf.cosine_features_given(table, bank, phase[:3])


def test_large_banks_are_broadcast(spark):
    table = feature_table(spark, gaussian_rows(3, 64))
    wide = collected(rf.cosine_features(table, 64, 8192, 1), "features")
    want = np.cos(gaussian_rows(3, 64) @ seeded.normals(8192, 64, 1).T + seeded.phases(8192, 1))
    assert np.allclose(wide, want)


@pytest.mark.parametrize("m", [0, 1, 7, 60, 100, 500])
def test_exact_samples(spark, m):
    table = feature_table(spark, gaussian_rows(100, 2))
    picked = [row["image_id"] for row in sampling.sample_rows(table, "image_id", m, 5).collect()]
    again = [row["image_id"] for row in sampling.sample_rows(table.repartition(7), "image_id", m, 5).collect()]
    assert len(picked) == len(set(picked)) == min(m, 100) and sorted(picked) == sorted(again)


def test_smallest_refines_hot_buckets(spark, monkeypatch):
    """Far more rows than a bucket may hold, a third of them with one hash value."""
    monkeypatch.setattr(sampling, "SORTED_ROWS", 5)
    monkeypatch.setattr(sampling, "BUCKETS", 4)
    rng = np.random.default_rng(0)
    order = np.concatenate([np.full(300, 123456789), rng.integers(0, seeded.ORDER_RANGE, 600)])
    table = spark.createDataFrame([(int(i), int(o)) for i, o in enumerate(order)], "id bigint, o bigint")
    want = sorted(zip(order.tolist(), range(900)))
    for m in (1, 50, 250, 400, 899, 900, 1000):
        got = sorted((row["o"], row["id"]) for row in sampling.smallest(table, "o", ["id"], m).collect())
        assert got == want[:m]


def test_bernoulli_share(spark):
    table = spark.range(20000).withColumnRenamed("id", "k")
    assert abs(sampling.bernoulli(table, "k", 0.25, 3).count() / 20000 - 0.25) < 0.02


def test_pairs_cover_all_rows_evenly(spark):
    table = spark.range(50).withColumnRenamed("id", "k")
    pairs = sampling.sample_pairs(table, "k", 2000, 1).collect()
    assert len(pairs) == 2000 and sorted(row["draw"] for row in pairs) == list(range(2000))
    seen = np.bincount([row["left_key"] for row in pairs], minlength=50)
    assert seen.min() > 10 and seen.max() < 90


def test_learn_gamma_by_brute_force(spark):
    rows = gaussian_rows(80, 6)
    table = feature_table(spark, rows)
    pairs = {r["draw"]: (r["left_key"], r["right_key"]) for r in sampling.sample_pairs(table, "image_id", 300, 2).collect()}
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    median = np.median([np.linalg.norm(unit[a] - unit[b]) for a, b in pairs.values()])
    got = kernels.learn_gamma(table, "image_id", 300, 2).first()
    assert np.isclose(got["median_distance"], median) and np.isclose(got["gamma"], 1 / (median / 1.414) ** 2)


def test_positions():
    kept = sampling.random_positions(50, 9, 4)
    assert kept == sorted(kept) and len(set(kept)) == 9
    blocks = sampling.position_blocks(50, 20, 4)
    assert [len(b) for b in blocks] == [20, 20, 10] and sorted(sum(blocks, [])) == list(range(50))
    with pytest.raises(ValueError):
        sampling.random_positions(5, 6, 0)


def test_sums_and_moments(spark):
    rows = gaussian_rows(200, 7) + 3
    table = feature_table(spark, rows).repartition(5)
    assert np.isclose(statistics.grand_mean(table).first()[0], rows.mean())
    n, mean = statistics.count_and_mean(table, 7)
    assert n == 200 and np.allclose(mean, rows.mean(axis=0))
    cov = np.zeros((7, 7))
    for row in statistics.covariance_rows(table, 7).collect():
        cov[row["i"], row["j"]] = row["cov"]
    assert np.allclose(cov, np.cov(rows.T, bias=True))
    done = collected(statistics.standardize(table), "features")
    assert np.allclose(done.mean(axis=0), 0) and np.allclose(done.std(axis=0), 1)


def test_standardize_constant_column(spark):
    rows = np.column_stack([np.full(5, 2.0), np.arange(5.0)])
    assert np.allclose(collected(statistics.standardize(feature_table(spark, rows)), "features")[:, 0], 0)


def test_patch_moments_equal_patch_rows(spark):
    shape = Shape(5, 4, 2)
    table = image_table(spark, gaussian_rows(6, shape.size))
    direct = collected(statistics.patch_moment_rows(table, shape, 2).withColumnRenamed("i", "image_id"), "row")
    cut = patches.extract_patches(table, shape, 2)
    rows = collected(statistics.moment_rows(cut, 8, "patch").withColumnRenamed("i", "image_id"), "row")
    assert np.allclose(direct, rows)


def test_ridge_scale_modes(spark):
    rows = gaussian_rows(20, 4)
    table, squares = feature_table(spark, rows), (gaussian_rows(20, 4) ** 2).sum()
    assert statistics.scaled_ridge(table, 0.3) == 0.3
    assert np.isclose(statistics.scaled_ridge(table, 0.3, "trace_over_d"), 0.3 * squares / 4)
    assert np.isclose(statistics.scaled_ridge(table, 0.3, "trace_over_n"), 0.3 * squares / 20)
    with pytest.raises(ValueError):
        statistics.scaled_ridge(table, 0.3, "other")


def test_observed_counts(spark):
    table, seen = statistics.observed(
        image_table(spark, gaussian_rows(9, 64)), "images", patches=statistics.patch_count(Shape(8, 8), 5)
    )
    table.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 9, "patches": 144}


def test_vectors_of_two_lengths_are_refused(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "image_id bigint, features array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        rf.cosine_node(table, np.zeros(1)).collect()


def test_row_expressions(spark):
    table = feature_table(spark, np.array([[3.0, -4.0, 0.0, 5.0]]), [2])
    col = F.col("features")
    row = table.select(
        vectors.l2_norm(col).alias("norm"),
        vectors.l2_normalize(col, normalize=False)[1].alias("one"),
        vectors.floor_normalize(F.transform(col, lambda v: v * 0))[1].alias("floor"),
        vectors.pick(col, [3, 0]).alias("pick"),
        vectors.block(col, 3, 3).alias("short"),
        vectors.indicator(F.col("label"), 4, 0.0).alias("hot"),
        vectors.rotate(col, 1, 4).alias("turned"),
        vectors.argmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))).alias("first"),
        vectors.top_k(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)), 2).alias("top"),
        vectors.scale_bytes(F.array(F.lit(0), F.lit(255))).alias("bytes"),
        vectors.dot(col, col).alias("dot"),
    ).first()
    assert np.isclose(row["norm"], np.sqrt(50)) and row["one"] == 1.0 and row["floor"] == 1e-4
    assert row["pick"] == [5.0, 3.0] and row["short"] == [5.0] and row["hot"] == [0.0, 0.0, 1.0, 0.0]
    assert row["turned"] == [-4.0, 0.0, 5.0, 3.0] and row["first"] == 1 and row["top"] == [1, 2]
    assert row["bytes"] == [0.0, 1.0] and row["dot"] == 50.0


def test_param_grid(spark):
    grid = joins.param_grid(spark, {"gamma": [0.1, 1.0], "filters": [8, 16, 32], "solver": ["ridge"]})
    assert sorted(map(tuple, grid.collect())) == sorted((g, f, "ridge") for g in (0.1, 1.0) for f in (8, 16, 32))


def test_lookup_joins_agree(spark):
    facts = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id")
    lookup = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "key string, class int")
    for how in ("inner", "left", "left_anti"):
        small = joins.lookup_join(facts, lookup, "key", how)
        large = joins.lookup_join(facts, lookup, "key", how, limit=5, salts=4)
        assert sorted(map(str, small.collect())) == sorted(map(str, large.select(*small.columns).collect()))


def test_lookup_join_spreads_a_hot_key(spark):
    facts = spark.range(9000).select(F.when(F.col("id") < 3000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"), "id")
    spread = facts.withColumn("__salt", F.pmod(F.xxhash64("key", "id"), F.lit(joins.SALTS)))
    largest = spread.groupBy("key", "__salt").count().agg(F.max("count")).first()[0]
    assert largest < 200

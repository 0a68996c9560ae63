"""Whole runs, settings, streams, and what plans may and may not contain."""

import io
import contextlib
from dataclasses import replace

import numpy as np
import pytest
from conftest import SF_DIR, collected, image_table
from pyspark.sql import functions as F

from patchlight.layout import Shape, as_images
from patchlight.operators import convolve as cv
from patchlight.operators import joins, kernels, statistics
from patchlight.plans import catalog, runs
from patchlight.plans.config import FeatureConf, SolveConf, from_mapping, run_options
from patchlight.session import fresh_path, written
from patchlight.solvers import linear
from patchlight.sources import writers
from patchlight.streaming.features import featurize_stream


def digits(spark, n, seed):
    """Blurred class templates with noise, as 8x8 images."""
    templates = np.random.default_rng(0).normal(size=(10, 64))
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 10, n)
    return image_table(spark, templates[labels] + 0.8 * rng.normal(size=(n, 64)), labels)


CONF = FeatureConf(dataset="t", filters=(40,), bandwidth=(1.0,), seed=3)


@pytest.mark.parametrize("solver", ["ridge", "weighted_ridge", "softmax_newton", "log"])
def test_run_learns(spark, solver):
    solve = SolveConf(solver, reg=1e-2, reg_mode="trace_over_d" if "ridge" in solver else "absolute", mixture=0.2, iterations=8)
    results = fresh_path(spark, "results")
    record = runs.run(digits(spark, 600, 1), digits(spark, 200, 2), CONF, solve, results=results)
    assert record["test"]["accuracy"] > 0.9 and record["test"]["top5_accuracy"] >= record["test"]["accuracy"]
    assert writers.read_runs(spark, results).count() == 1


def test_two_layer_whitened_run_with_stored_features(spark):
    conf = FeatureConf(
        dataset="t", patch_sizes=(3, 2), filters=(16, 40), bandwidth=(1.5, 1.0), conv_stride=(1, 1), pool=(2, 1),
        pool_stride=(2, 1), whiten=True, fastfood=(1,), float_layers=(1,),
    )
    folder = fresh_path(spark, "features")
    solve = SolveConf(reg=1e-2, reg_mode="trace_over_d")
    first = runs.run(digits(spark, 500, 1), digits(spark, 100, 2), conf, solve, folder)
    again = runs.run(digits(spark, 500, 1), digits(spark, 100, 2), conf, solve, folder)
    assert first["test"] == again["test"] and first["test"]["accuracy"] > 0.8


def test_bandwidth_is_learnt_from_patches_when_none_is_given(spark):
    train = digits(spark, 80, 1)
    learnt = runs.with_bandwidth(train, replace(CONF, bandwidth=()), 500)
    gamma = kernels.learn_gamma_patches(train, CONF.shape, 5, 500, CONF.seed).first()
    assert learnt.bandwidth == ((2 * gamma["gamma"]) ** 0.5,) and 0.1 < gamma["median_distance"] < 2.0
    assert runs.with_bandwidth(train, CONF) is CONF


def test_restart_from_a_stored_layer(spark):
    conf = FeatureConf(dataset="t", patch_sizes=(3, 2), filters=(6, 8), bandwidth=(1.0, 1.0), conv_stride=(1, 1), pool=(2, 1), pool_stride=(2, 1))
    table = digits(spark, 30, 1)
    direct = collected(runs.featurize(table, conf), "features")
    folder = fresh_path(spark, "restart")
    assert np.allclose(collected(runs.featurize_stored(table, conf, folder, layers=1), "features"), direct)
    stored = {conf.prefix(1).feature_id, conf.feature_id}
    assert len(stored) == 2


def test_sweep_reuses_features(spark):
    grid = joins.param_grid(spark, {"solver": ["ridge", "softmax_newton"], "reg": [0.1, 1.0]}).orderBy("solver", "reg").collect()
    solvers = [SolveConf(g["solver"], reg=g["reg"], iterations=3, classes=10) for g in grid]
    records = runs.sweep(digits(spark, 300, 1), digits(spark, 100, 2), [CONF], solvers, fresh_path(spark, "sweep"))
    assert [r["solve"] for r in records] == solvers and all(r["accuracy"] > 0.7 for r in records)


def test_run_goes_on_from_a_stored_layer_and_whitener(spark):
    folder, train, test = fresh_path(spark, "restart"), digits(spark, 120, 1), digits(spark, 40, 2)
    conf = FeatureConf("d", 8, 8, 1, 3, patch_sizes=(3, 2), filters=(6, 5), bandwidth=(1.0, 1.0), pool=(2, 1), pool_stride=(2, 1), whiten=(True, False))
    solve = SolveConf(reg=0.1, classes=10)
    first = runs.run(train, test, conf, solve, folder)
    for split in ("train", "test"):
        whole = spark.read.parquet(f"{folder}/{replace(conf, dataset=f'd-{split}').feature_id}")
        assert whole.count() == (120 if split == "train" else 40)
    again = runs.run(train, test, conf, solve, fresh_path(spark, "other"), layers=1)
    loaded = runs.run(train, test, conf, solve, folder, layers=1, load_whitener=True)
    assert first["test"] == again["test"] == loaded["test"]
    with pytest.raises(ValueError):
        runs.run(train, test, conf, solve, load_whitener=True)


def test_feature_mean_is_moderate(spark):
    """Cosine features of given data lie in [-1, 1]; with norm scaling and wide filters they differ."""
    features = runs.featurize(digits(spark, 50, 1), CONF)
    assert abs(statistics.grand_mean(features).first()[0]) < 0.5


def test_settings():
    features, solve = from_mapping(
        {
            "dataset": "d", "patch_sizes": [5, 2], "filters": [50, 200], "bandwidth": [1.8, 2.2], "convStride": {0: 1, 1: 1},
            "poolStride": [2, 1], "pool": [2, 1], "solver": "BlockWeightedLeastSquares", "solverWeight": 0.3, "blockSize": 64,
            "insanity": True,
        }
    )
    with pytest.raises(ValueError, match="notAField"):
        from_mapping({"notAField": 1})
    flags = {(): False, (True,): True, (False, False): False, (True, False): True}
    for flag, whitens in flags.items():
        assert from_mapping({"patch_sizes": [5, 2], "filters": [5, 5], "whiten": list(flag)})[0].whitens is whitens
    assert from_mapping({"whiten": False})[0].whitens is False and from_mapping({"whiten": True})[0].whitens
    with pytest.raises(ValueError, match="first layer"):
        from_mapping({"patch_sizes": [5, 2], "filters": [5, 5], "whiten": [False, True]})
    mapping = {
        "dataset": "d", "expid": "e", "mode": "scala", "layers": 1, "patch_sizes": [5, 2], "filters": [50, 60], "whiten": [True, False], "whitenerOffset": 0.1,
        "whitenerValue": 0.01, "loadWhitener": True, "layerToLoad": 2, "fastfood": False, "solve": True, "yarn": True, "numClasses": 10, "loss": "softmax",
    }
    shaped, named = from_mapping(mapping)
    assert shaped.norm_offset == 0.1 and shaped.layers == 1 and shaped.whiten == (True,) and named.solver == "softmax_newton"
    assert run_options(mapping) == {"layers": 2, "load_whitener": True}
    assert features.conv_stride == (1, 1) and features.rescale and features.layers == 2
    assert solve.solver == "weighted_ridge" and solve.mixture == 0.3 and solve.block == 64
    assert features.feature_id == from_mapping({**features.__dict__})[0].feature_id
    assert features.feature_id != FeatureConf(seed=1).feature_id
    layers = features.build()
    assert layers[1].seed == features.seed + 1 and layers[1].shape == layers[0].out_shape
    with pytest.raises(ValueError):
        SolveConf("unknown")
    with pytest.raises(ValueError, match="none of"):
        runs.choose({"a": None}, "b")


def test_whiten_images(spark):
    train, test = runs.whiten_images(digits(spark, 100, 1), digits(spark, 20, 2))
    assert collected(train).shape == (100, 64) and collected(test).shape == (20, 64)
    assert np.abs(collected(train).mean(0)).max() < 1e-8


def test_stream(spark):
    source, path = fresh_path(spark, "in"), fresh_path(spark, "out")
    table = digits(spark, 60, 1)
    table.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    featurize_stream(stream, CONF, path, path + "-checkpoint").awaitTermination(120)
    assert np.allclose(collected(spark.read.parquet(path), "features"), collected(runs.featurize(table, CONF), "features"))
    with pytest.raises(ValueError):
        featurize_stream(table, CONF, path, path + "-checkpoint")


# ---- plans


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_featurising_has_no_shuffle_and_reads_two_columns(spark, embeddings):
    text = plan(cv.layer_stack(as_images(embeddings, "vec_id", "embedding"), [catalog.FLAT_LAYER]))
    assert "Exchange" not in text and "label" not in text.split("ReadSchema")[1].split("\n")[0]


def test_relational_form_shuffles_images_only(spark, embeddings):
    text = plan(cv.relational_conv_cosine_pool(as_images(embeddings, "vec_id", "embedding"), catalog.FLAT_LAYER))
    assert text.count("Arguments: hashpartitioning") == 1


def test_filters_and_splits_reach_the_scan(spark):
    path = fresh_path(spark, "split")
    table = digits(spark, 40, 1).withColumn("split", F.when(F.col("label") < 5, "train").otherwise("test"))
    table.write.partitionBy("split").parquet(path)
    text = plan(spark.read.parquet(path).filter((F.col("split") == "train") & (F.col("label") == 2)))
    assert "PartitionFilters: [isnotnull(split" in text and "EqualTo(label,2)" in text


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_no_cross_joins_and_no_unbounded_single_task(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for part in text.split("\n\n"):
        if "Window" in part.split("\n")[0]:
            assert "windowspecdefinition(bucket" in part


# ---- partitioning and size


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(spark, embeddings, parts):
    table = as_images(embeddings, "vec_id", "embedding", "label")
    other = table.orderBy(F.xxhash64("image_id")).repartition(parts)
    for layers in ([catalog.FLAT_LAYER], [cv.Layer(Shape(4, 4, 4), 2, 6, fastfood=True)]):
        assert np.allclose(collected(cv.layer_stack(table, layers), "features"), collected(cv.layer_stack(other, layers), "features"))
    a = linear.fit_ridge(table.withColumnRenamed("pixels", "features"), 1.0, 10)
    b = linear.fit_ridge(other.withColumnRenamed("pixels", "features"), 1.0, 10)
    assert np.allclose(a.weights, b.weights, atol=1e-12)


def test_replicated_table(spark, embeddings):
    """100 copies of every row: same model, a hundred times the weight."""
    table = as_images(embeddings, "vec_id", "embedding", "label").withColumnRenamed("pixels", "features")
    many = table.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(100))))
    once, often = linear.fit_ridge(table, 1.0, 10), linear.fit_ridge(many, 100.0, 10)
    assert np.allclose(once.weights, often.weights, atol=1e-10)


def test_written_cuts_lineage(spark):
    table = written(spark.range(10).withColumn("v", F.col("id") * 2), "cut")
    assert table.count() == 10 and "Range" not in plan(table)


def test_slices_do_not_change_results(spark, monkeypatch):
    from patchlight.functions import batches

    table = image_table(spark, np.random.default_rng(0).normal(size=(300, 64)))
    want = collected(cv.layer_stack(table, [catalog.FLAT_LAYER]), "features")
    monkeypatch.setattr(batches, "WORK_DOUBLES", 5000)
    monkeypatch.setattr(batches, "BATCH_DOUBLES", 1000)
    assert np.array_equal(collected(cv.layer_stack(table, [catalog.FLAT_LAYER]), "features"), want)

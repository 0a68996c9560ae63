"""Featurise, fit and evaluate: the runs a user starts."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.operators import evaluation, kernels
from patchlight.operators.convolve import Layer, layer_stack, sampled_filters
from patchlight.operators.joins import param_grid
from patchlight.plans.config import FeatureConf, SolveConf
from patchlight.session import path_exists
from patchlight.solvers import linear, softmax, whitening
from patchlight.solvers.whitening import Whitener
from patchlight.sources.writers import append_run, materialize, read_whitener, write_whitener


def choose(readers: dict[str, Callable[[SparkSession], DataFrame]], name: str) -> Callable[[SparkSession], DataFrame]:
    """The reader of a named dataset."""
    if name not in readers:
        raise ValueError(f"dataset {name} is none of {sorted(readers)}")
    return readers[name]


def fit_first_whitener(train: DataFrame, conf: FeatureConf) -> Whitener | None:
    if not conf.whitens:
        return None
    return whitening.fit_patch_whitener(
        train, conf.shape, conf.patch_sizes[0], conf.whitener_epsilon, conf.whitener_sample, conf.seed
    )


def featurize(images: DataFrame, conf: FeatureConf, whitener: Whitener | None = None) -> DataFrame:
    """Images to feature vectors, all layers in one pass and without a shuffle."""
    return layer_stack(images, conf.build(whitener), as_float=conf.layers - 1 in conf.float_layers)


def featurize_stored(images: DataFrame, conf: FeatureConf, folder: str, layers: int | None = None, whitener: Whitener | None = None) -> DataFrame:
    """Features read back from their keyed table, computed and written if missing.

    With ``layers`` the output of the first ``layers`` layers is stored under its
    own key and the rest goes on from there.
    """
    spark = images.sparkSession
    if layers and layers < conf.layers:
        start = conf.prefix(layers)
        stored = materialize(spark, f"{folder}/{start.feature_id}", lambda: featurize(images, start, whitener))
        rest = layer_stack(stored.withColumnRenamed("features", "pixels"), conf.build(whitener, first=layers), as_float=conf.layers - 1 in conf.float_layers)
        return materialize(spark, f"{folder}/{conf.feature_id}", lambda: rest)
    return materialize(spark, f"{folder}/{conf.feature_id}", lambda: featurize(images, conf, whitener))


def fit(features: DataFrame, conf: SolveConf) -> linear.LinearModel:
    """Fit the named solver."""
    if conf.solver in ("ridge", "weighted_ridge"):
        return linear.fit_ridge(
            features,
            conf.reg,
            conf.classes,
            conf.block,
            conf.passes,
            conf.mixture if conf.solver == "weighted_ridge" else 0.0,
            reg_mode=conf.reg_mode,
        )
    if conf.solver == "softmax_newton":
        return softmax.softmax_newton(features, conf.reg, conf.iterations, conf.classes)
    if conf.solver == "softmax_block_newton":
        return softmax.softmax_block_newton(features, conf.reg, conf.iterations, conf.block or 4000, conf.passes, classes=conf.classes)
    if conf.solver == "softmax_descent":
        return softmax.softmax_descent(features, conf.reg, conf.iterations, "backtrack", conf.classes)
    return softmax.fit_named_loss(features, conf.solver, conf.reg, conf.iterations)


def evaluate(features: DataFrame, model: linear.LinearModel, top_k: int = 5) -> dict[str, float]:
    """Top-1 accuracy, and top-k accuracy if there are at least k classes, by the rules of ``evaluation``."""
    scored = model.transform(features)
    scores, label = F.col("scores"), F.col("label")
    row = scored.agg(
        F.count("*").alias("n"),
        F.max(F.size("scores")).alias("classes"),
        F.avg(evaluation.hits(scores, label, 1)).alias("top1"),
        F.avg(evaluation.hits(scores, label, top_k)).alias("topk"),
    ).first()
    metrics = {"n": row["n"], "accuracy": row["top1"]}
    if row["classes"] is not None and row["classes"] >= top_k:
        metrics[f"top{top_k}_accuracy"] = row["topk"]
    return metrics


def with_bandwidth(train: DataFrame, conf: FeatureConf, draws: int = 3000) -> FeatureConf:
    """The settings with a bandwidth for the first layer learnt from pairs of its patches, if they name none."""
    if conf.bandwidth:
        return conf
    gamma = kernels.learn_gamma_patches(train, conf.shape, conf.patch_sizes[0], draws, conf.seed).first()["gamma"]
    return replace(conf, bandwidth=(math.sqrt(2.0 * gamma),))


def stored_whitener(train: DataFrame, conf: FeatureConf, folder: str, load: bool = True) -> Whitener | None:
    """The whitener of these settings from the folder; fitted and written there if it is missing or not to be loaded."""
    if not conf.whitens:
        return None
    spark, path = train.sparkSession, f"{folder}/{conf.prefix(1).feature_id}_whitener"
    if load and path_exists(spark, f"{path}/_SUCCESS"):
        return read_whitener(spark, path)
    whitener = fit_first_whitener(train, conf)
    write_whitener(spark, whitener, path, mode="overwrite")
    return whitener


def split_features(
    train: DataFrame, test: DataFrame, conf: FeatureConf, folder: str, layers: int | None = None, load_whitener: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Stored features of both splits, from a stored layer on if ``layers`` says so. One table for both splits is stored once."""
    whitener = stored_whitener(train, conf, folder, load_whitener)
    named = {split: replace(conf, dataset=f"{conf.dataset}-{split}") for split in ("train", "test")}
    first = featurize_stored(train, named["train"], folder, layers, whitener)
    return first, first if test is train else featurize_stored(test, named["test"], folder, layers, whitener)


def run(
    train: DataFrame,
    test: DataFrame,
    features: FeatureConf,
    solve: SolveConf,
    folder: str | None = None,
    results: str | None = None,
    layers: int | None = None,
    load_whitener: bool = False,
) -> dict:
    """Whiten, featurise, fit, evaluate; optionally store features and append a run record.

    With a folder, ``layers`` goes on from the stored output of that many layers,
    and ``load_whitener`` takes a whitener that an earlier run has stored.
    """
    spark = train.sparkSession
    started = time.time()
    features = with_bandwidth(train, features)
    if folder is None and (layers or load_whitener):
        raise ValueError("stored layers and whiteners need a folder")
    if folder:
        train_rows, test_rows = split_features(train, test, features, folder, layers, load_whitener)
    else:
        # Solvers and scoring pass over the features several times; rows that are lost with an executor are computed again.
        whitener = fit_first_whitener(train, features)
        train_rows = featurize(train, features, whitener).persist(StorageLevel.MEMORY_AND_DISK)
        test_rows = featurize(test, features, whitener)
    model = fit(train_rows, solve)
    seen = evaluate(train_rows, model, solve.top_k)
    record = {
        "features": asdict(features),
        "solve": asdict(solve),
        "train": seen,
        "test": dict(seen) if test is train else evaluate(test_rows, model, solve.top_k),
        "seconds": round(time.time() - started, 3),
    }
    if not folder:
        train_rows.unpersist()
    if results:
        append_run(spark, record, results)
    return record


#: Solvers whose settings differ in the weight only and share every scan.
STACKED = ("ridge", "weighted_ridge", "softmax_newton", "log", "log_rest", "hinge")


def fit_all(features: DataFrame, confs: Sequence[SolveConf]) -> list[linear.LinearModel]:
    """A model for every setting; those that differ in ``reg`` alone are fitted by the same scans."""
    groups: dict[SolveConf, list[int]] = {}
    for k, conf in enumerate(confs):
        groups.setdefault(replace(conf, reg=0.0, top_k=0), []).append(k)
    models: dict[int, linear.LinearModel] = {}
    for conf, members in groups.items():
        regs = [confs[k].reg for k in members]
        stacked = conf.solver in STACKED and conf.block is None
        found = stacked_models(features, conf, regs) if stacked else [fit(features, confs[k]) for k in members]
        models.update(zip(members, found, strict=True))
    return [models[k] for k in range(len(confs))]


def stacked_models(features: DataFrame, conf: SolveConf, regs: Sequence[float]) -> list[linear.LinearModel]:
    if conf.solver in ("ridge", "weighted_ridge"):
        mixture = conf.mixture if conf.solver == "weighted_ridge" else 0.0
        scale = linear.scaled_ridge(features, 1.0, conf.reg_mode)
        lams = [reg * scale for reg in regs]
        models = linear.ridge_sweep(features, lams, conf.classes, mixture)
        return [models[lam] for lam in lams]
    if conf.solver == "softmax_newton":
        return softmax.softmax_newton_sweep(features, regs, conf.iterations, conf.classes)
    return softmax.named_loss_sweep(features, conf.solver, regs, conf.iterations, conf.classes)


def solve_grid(spark: SparkSession, params: dict[str, list]) -> list[SolveConf]:
    """Solver settings for every combination of the given values."""
    return [SolveConf(**row.asDict()) for row in param_grid(spark, params).orderBy(*params).collect()]


def evaluate_all(features: DataFrame, models: Sequence[linear.LinearModel], top_ks: Sequence[int]) -> list[dict[str, float]]:
    """``evaluate`` of several models on the same rows, in one scan: their scores lie side by side."""
    classes = [model.weights.shape[1] for model in models]
    ends = np.cumsum(classes).tolist()
    side = linear.LinearModel(np.concatenate([m.weights for m in models], axis=1), np.concatenate([m.intercept for m in models]))
    scored, label = side.transform(features), F.col("label")
    wanted = [F.count("*").alias("n")]
    for k, (end, own, top) in enumerate(zip(ends, classes, top_ks, strict=True)):
        scores = F.slice("scores", end - own + 1, own)
        wanted += [F.avg(evaluation.hits(scores, label, 1)).alias(f"first_{k}"), F.avg(evaluation.hits(scores, label, top)).alias(f"top_{k}")]
    row = scored.agg(*wanted).first()
    return [
        {"n": row["n"], "accuracy": row[f"first_{k}"], **({f"top{top}_accuracy": row[f"top_{k}"]} if own >= top else {})}
        for k, (own, top) in enumerate(zip(classes, top_ks, strict=True))
    ]


def sweep(
    train: DataFrame, test: DataFrame, feature_confs: Sequence[FeatureConf], solve_confs: Sequence[SolveConf], folder: str
) -> list[dict]:
    """Every feature setting with every solver setting; features are computed once.

    Settings of one solver that differ in the weight only share every scan of the
    features, and all models of a feature setting are evaluated in one.
    """
    records = []
    for conf in feature_confs:
        train_rows, test_rows = split_features(train, test, conf, folder)
        models = fit_all(train_rows, solve_confs)
        metrics = evaluate_all(test_rows, models, [solve.top_k for solve in solve_confs])
        records += [{"features": conf, "solve": solve, **found} for solve, found in zip(solve_confs, metrics, strict=True)]
    return records


def whiten_images(train: DataFrame, test: DataFrame, epsilon: float = whitening.EPSILON) -> tuple[DataFrame, DataFrame]:
    """Contrast-normalise and whiten whole images, fitted on the training images."""
    whitener = whitening.fit_image_whitener(train, epsilon)
    return whitening.whiten_images(train, whitener), whitening.whiten_images(test, whitener)


def patch_bank_features(train: DataFrame, images: DataFrame, layer: Layer, seed: int = 0) -> DataFrame:
    """Features from a bank of patches sampled from the training images: convolve, rectify, pool."""
    bank = sampled_filters(train, layer.shape, layer.patch, layer.filters, seed)
    return layer_stack(images, [replace(layer, nonlinearity="rectify", norm="none")], filters=bank)



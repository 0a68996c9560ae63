"""Time the headline jobs and print one JSON line.

    BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
    BENCH_CPUS     cores (default 8)
    BENCH_QUERIES  "headline" (default), "all", or a comma-separated list
"""

from __future__ import annotations

import json
import os
import statistics as st
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from patchlight.operators import convolve as cv  # noqa: E402
from patchlight.operators import random_features as rf  # noqa: E402
from patchlight.layout import Shape  # noqa: E402
from patchlight.operators import sampling, statistics  # noqa: E402
from patchlight.plans import catalog  # noqa: E402
from patchlight.session import spark_session, written  # noqa: E402
from patchlight.solvers import linear, softmax, whitening  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WHICH = os.environ.get("BENCH_QUERIES", "headline")


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def replicated(spark, times: int):
    """The image table ``times`` over, written once in as many files as there are tasks to keep busy."""
    copies = catalog.stored_images(spark, SF_DIR).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return written(copies.repartition(int(CPUS) * 2), "bench-copies")


def headline(spark) -> dict:
    many = replicated(spark, 100)
    images, features = catalog.stored_images(spark, SF_DIR), catalog.stored_features(spark, SF_DIR)
    jobs = {
        "features_arrow": lambda: sink(cv.layer_stack(images, [catalog.FLAT_LAYER])),
        "features_arrow_x100": lambda: sink(cv.layer_stack(many, [catalog.FLAT_LAYER])),
        "features_relational": lambda: sink(cv.relational_conv_cosine_pool(catalog.images(spark, SF_DIR), catalog.FLAT_LAYER)),
        "gram_64": lambda: sink(statistics.moment_rows(features, 64)),
        "gram_64_x100": lambda: sink(statistics.moment_rows(many, 64, "pixels")),
        "fastfood_8192": lambda: sink(rf.fastfood(features, 64, 8192, 1)),
        "cosine_features_8192": lambda: sink(rf.cosine_features(features, 64, 8192, 1)),
        "whitener_fit": lambda: whitening.fit_patch_whitener(images, catalog.FLAT, 5),
        "ridge_fit": lambda: linear.fit_ridge(features, 1.0, 10),
        "ridge_sweep": lambda: linear.ridge_sweep(features, catalog.SWEEP, 10),
        "softmax_newton_5": lambda: softmax.softmax_newton(features, iterations=5, classes=10),
    }
    # Photos of 64x64x3 and vectors of 4096, made of the stored values over and over.
    wide = lambda times: F.flatten(F.array_repeat("pixels", times))
    photos = written(images.select("image_id", "label", wide(192).alias("pixels")).repartition(int(CPUS)), "bench-photos")
    vectors = written(images.select("image_id", "label", wide(64).alias("features")).repartition(int(CPUS)), "bench-vectors")
    photo = Shape(64, 64, 3)
    jobs |= {
        "photos_layer": lambda: sink(cv.layer_stack(photos, [cv.Layer(photo, 5, 32, pool=4, pool_stride=4)])),
        "photos_sample_patches": lambda: sink(sampling.sample_patches(photos, photo, 5, 1000, 1)),
        "gram_4096": lambda: sink(statistics.moment_rows(vectors, 4096)),
        "fastfood_4096": lambda: sink(rf.fastfood(vectors, 4096, 8192, 1)),
        "cosine_features_4096": lambda: sink(rf.cosine_features(vectors, 4096, 8192, 1)),
    }
    for name in ("two_layer_features", "patch_normalize", "pool_general_max", "learn_gamma", "sample_patches",
                 "augmented_accuracy", "top5_accuracy", "covariance", "featurize_fit_evaluate", "feature_text_roundtrip"):
        jobs[name] = lambda name=name: sink(catalog.QUERIES[name](spark, SF_DIR))
    return jobs


def main() -> None:
    spark = spark_session(f"local[{CPUS}]", int(CPUS), **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    jobs = headline(spark)
    if WHICH != "headline":
        names = list(catalog.QUERIES) if WHICH == "all" else WHICH.split(",")
        jobs = {name: jobs.get(name, lambda name=name: sink(catalog.QUERIES[name](spark, SF_DIR))) for name in names}
    times = {}
    for name, job in jobs.items():
        job()
        runs = []
        for _ in range(3 if WHICH == "headline" else 1):
            started = time.perf_counter()
            job()
            runs.append(time.perf_counter() - started)
        times[name] = round(st.median(runs), 4)
    print(
        json.dumps(
            {
                "metric": "sum of warm medians over the headline jobs" if WHICH == "headline" else f"sum over {WHICH}",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Session settings and the shared folder for everything that must outlive a task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.session.timeZone": "UTC",
    # One BLAS thread per task: Spark already runs one task per core.
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def spark_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Build a session; the master comes from spark-submit unless given."""
    builder = SparkSession.builder.appName("patchlight")
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            os.environ.setdefault("OMP_NUM_THREADS", "1")
            os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    Only a local master without the setting gets a temporary folder; a cluster
    without it is an error, since a machine-local path would be lost there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fallback = getattr(spark, "_patchlight_dir", None)
    if fallback is None:
        fallback = tempfile.mkdtemp(prefix="patchlight-")
        spark._patchlight_dir = fallback
    return fallback


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store_of(spark: SparkSession, path: str):
    """The Hadoop file system that holds a path."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    return store_of(spark, path).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as tasks open it, or None in a store that only Spark opens."""
    uri = store_of(spark, path).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path)).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

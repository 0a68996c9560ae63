import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from patchlight.session import spark_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = spark_session("local[8]", 8, **{"spark.checkpoint.dir": folder, "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def embeddings(spark):
    return spark.read.parquet(f"{SF_DIR}/embeddings.parquet")


def image_table(spark, matrix, labels=None):
    """Rows (image_id, pixels, label) from a NumPy matrix."""
    labels = np.zeros(len(matrix), int) if labels is None else labels
    rows = [(i, row.tolist(), int(label)) for i, (row, label) in enumerate(zip(matrix, labels))]
    return spark.createDataFrame(rows, "image_id bigint, pixels array<double>, label int").coalesce(3)


def feature_table(spark, matrix, labels=None):
    return image_table(spark, matrix, labels).withColumnRenamed("pixels", "features")


def collected(df, column="pixels", key="image_id"):
    """The vector column as a matrix, rows in key order."""
    rows = df.select(key, column).toPandas().sort_values(key)
    return np.stack(rows[column]) if len(rows) else np.zeros((0, 0))

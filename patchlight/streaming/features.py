"""Featurising a stream of images.

All operators without a fit step are row-local, so a stream needs no state,
watermark or window: the same plan runs on every micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from patchlight.plans.config import FeatureConf
from patchlight.plans.runs import featurize
from patchlight.solvers.whitening import Whitener


def featurize_stream(
    images: DataFrame, conf: FeatureConf, path: str, checkpoint: str, whitener: Whitener | None = None
) -> StreamingQuery:
    """Append the features of arriving images to a Parquet table, exactly once for one ``checkpoint`` folder, also over restarts."""
    if not images.isStreaming:
        raise ValueError("featurize_stream needs a streaming table; use featurize for a batch")
    features = featurize(images, conf, whitener)
    return (
        features.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )

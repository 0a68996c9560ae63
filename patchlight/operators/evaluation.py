"""Scoring tables of predictions. Every measure is a one-pass aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.functions import vectors


def predictions(df: DataFrame, scores: str = "scores") -> DataFrame:
    return df.withColumn("prediction", vectors.argmax(F.col(scores)))


# Classes ahead of a label that is null or no class: more than any k.
NEVER = (1 << 31) - 1


def classes_ahead(scores: Column, label: Column) -> Column:
    """How many classes beat the label: with a larger score, or an equal one and a lower index.

    A label that is null or outside the scores is beaten by more classes than
    there are, so it is a miss at every k.
    """
    known = label.isNotNull() & (label >= 0) & (label < F.size(scores))
    own = F.get(scores, F.when(known, label))
    beats = F.transform(scores, lambda s, i: ((s > own) | ((s == own) & (i < label))).cast("int"))
    return F.when(known, F.aggregate(beats, F.lit(0), lambda acc, v: acc + v)).otherwise(F.lit(NEVER))


def hits(scores: Column, label: Column, k: int) -> Column:
    return (classes_ahead(scores, label) < k).cast("double")


def accuracy(df: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """One row (n, accuracy, error_percent) for the best class; unknown and null labels are misses."""
    hit = F.avg(hits(F.col(scores), F.col(label), 1))
    return df.agg(F.count("*").alias("n"), hit.alias("accuracy"), ((1.0 - hit) * 100.0).alias("error_percent"))


def top_k_accuracy(df: DataFrame, k: int = 5, scores: str = "scores", label: str = "label") -> DataFrame:
    """One row (n, topk_accuracy): the label is among the k best classes; unknown and null labels are misses."""
    return df.agg(F.count("*").alias("n"), F.avg(hits(F.col(scores), F.col(label), k)).alias("topk_accuracy"))


def confusion(df: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """Rows (label, prediction, n)."""
    return (
        df.select(F.col(label).alias("label"), vectors.argmax(F.col(scores)).alias("prediction"))
        .groupBy("label", "prediction")
        .agg(F.count("*").alias("n"))
    )


def class_report(df: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """Rows (class, tp, actual, predicted, precision, recall) from the confusion table."""
    table = confusion(df, scores, label)
    both = table.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
                F.struct(
                    F.col("prediction").alias("class"),
                    F.lit(0).cast("bigint").alias("actual"),
                    F.col("n").alias("predicted"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                ),
            )
        ).alias("r")
    ).select("r.*")
    counts = both.groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted")
    )
    return counts.withColumns(
        {
            "precision": F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")),
            "recall": F.when(F.col("actual") > 0, F.col("tp") / F.col("actual")),
        }
    )


def cross_entropy(df: DataFrame, scores: str = "scores", label: str = "label", offset: float = vectors.LOG_OFFSET) -> DataFrame:
    """One row (n, loss): the sum of -log p[label]; an unknown or null label has probability zero, so costs -log of the offset."""
    known = classes_ahead(F.col(scores), F.col(label)) < NEVER
    loss = F.when(known, vectors.cross_entropy(F.col(scores), F.col(label), offset)).otherwise(F.lit(-math.log(offset)))
    return df.agg(F.count("*").alias("n"), F.sum(loss).alias("loss"))


def average_scores(df: DataFrame, source: str, classes: int, scores: str = "scores", carry: dict[str, Column] | None = None) -> DataFrame:
    """Mean scores over all rows of one source: (source, ..., scores, copies), in one scan for any number of classes.

    Rows of a source need not be adjacent, and null is a source. Partial sums are
    made before the shuffle, so a source with very many copies stays cheap. Every
    class of a source sees the same rows, so ``copies`` and the aggregates in
    ``carry`` are taken from any of them.
    """
    carry = carry or {}
    extra = [column.alias(name) for name, column in carry.items()]
    others = [c for c in df.columns if c != scores]
    cells = df.select(*others, F.posexplode(scores).alias("__c", "__s")).where(F.col("__c") < classes)
    means = cells.groupBy(source, "__c").agg(F.avg("__s").alias("__s"), F.count("*").alias("copies"), *extra)
    # One entry per class and source.
    back = F.transform(F.array_sort(F.collect_list(F.struct("__c", "__s"))), lambda r: r["__s"]).alias(scores)
    return means.groupBy(source).agg(F.max("copies").alias("copies"), *(F.first(name).alias(name) for name in carry), back)


def augmented_accuracy(df: DataFrame, source: str, classes: int, scores: str = "scores", label: str = "label") -> DataFrame:
    """Accuracy after the copies of each source vote by their mean scores."""
    voted = average_scores(df, source, classes, scores, {label: F.max(label)})
    return accuracy(voted, scores, label)

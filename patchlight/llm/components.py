"""Connected components of an edge table, by contraction in rounds.

Each round maps every node to the least node among itself and its neighbours and
relabels the edges, until none is left. Odd rounds order nodes by value, which
folds stars round their least node at once; even rounds by a hash of the round,
which halves long chains. Once few edges are left, one task unites what they join.
Only (node, node) rows move, every round is written to
the shared folder, and nothing of it reaches the driver but how many edges are left.
Both joins of a round are plain sort-merge joins, whose large partitions Spark
splits when one node has a large part of all edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight.session import written

MAX_ROUNDS = 200
#: Edges that one task unites.
FEW = 100_000


def united(edges: DataFrame) -> DataFrame:
    """(node, component) of a few edges (a, b), in one task; the component is some node of it."""
    kind = edges.schema["a"].dataType

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [batch for batch in batches if batch.num_rows]
        if not found:
            return
        rows = pa.Table.from_batches(found)
        nodes = pa.concat_arrays([*rows.column("a").chunks, *rows.column("b").chunks])
        keys = [tuple(v.values()) if isinstance(v, dict) else v for v in nodes.to_pylist()]
        first: dict = {}
        places = [first.setdefault(key, k) for k, key in enumerate(keys)]
        up = list(range(len(keys)))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for a, b in zip(places[: rows.num_rows], places[rows.num_rows :], strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        held = list(first.values())
        roots = [root(k) for k in held]
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(held)), nodes.take(pa.array(roots))], names=["node", "component"])

    schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])
    return edges.select("a", "b").coalesce(1).mapInArrow(unite, schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its least node.

    Null ends, loops and repeated edges change nothing; an empty table gives an
    empty one. Any type that can be ordered will do for nodes.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    left = written(left.select(low, high).distinct(), "edges")
    labels = None
    for turn in range(1, MAX_ROUNDS + 1):
        n = left.count()
        if not n:
            break
        if n <= FEW:
            last = written(united(left), "labels")
            if labels is None:
                labels = last
            else:
                moved = last.select(F.col("node").alias("component"), F.col("component").alias("to"))
                labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
                labels = written(labels, "labels")
            break
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        if turn % 2:
            best = both.groupBy("node").agg(F.min("other").alias("other"))
            step = best.select("node", F.least("node", "other").alias("to"))
        else:
            rank = lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)).alias("h"), F.col(c).alias("n"))
            best = both.groupBy("node").agg(F.min(rank("other")).alias("best"))
            step = best.select("node", F.least(rank("node"), "best")["n"].alias("to"))
        step = written(step, "step")
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            moved = step.select(F.col("node").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = written(labels, "labels")
        to_a = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        to_b = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = left.join(to_a, "a").join(to_b, "b").where(F.col("x") != F.col("y"))
        left = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").select("node", F.col("least").alias("component"))

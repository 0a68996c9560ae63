"""Label lookup and pairing of tables that share a row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side up to this many rows and characters (as JSON) is broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 64 << 20
SALTS = 32


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows and BROADCAST_CHARS characters; reads no more rows than that."""
    size = F.length(F.to_json(F.struct(*df.columns))).cast("bigint")
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(size).alias("chars")).first()
    return found["n"] <= rows and (found["chars"] or 0) <= BROADCAST_CHARS


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: str, how: str = "inner", limit: int = BROADCAST_ROWS, salts: int = SALTS
) -> DataFrame:
    """Join a table to a keyed lookup (inner, left or left_anti).

    A lookup of checked size is broadcast, so a key that holds a third of the
    facts costs nothing. A larger one is joined on (key, salt): every lookup
    row is copied to all salts and the facts are dealt to them in turn, equal
    rows too.
    """
    if is_small(lookup, limit):
        return facts.join(F.broadcast(lookup), on, how)
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return facts.withColumn("__salt", spread).join(copies, [on, "__salt"], how).drop("__salt")


def label_files(files: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Class of every file by its key; files without a class are left out."""
    return lookup_join(files, labels, key)


def unmapped(files: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Files whose key the label map does not have."""
    return lookup_join(files, labels, key, "left_anti")


def pair_rows(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One-to-one pairing of two tables on a unique row key."""
    return left.join(right, key, "inner")


def param_grid(spark: SparkSession, params: dict[str, list], rows: DataFrame | None = None) -> DataFrame:
    """Every combination of the given parameter values, one row each; with ``rows``, each of them under every combination."""
    grid = spark.range(1) if rows is None else rows
    for name, values in params.items():
        grid = grid.withColumn(name, F.explode(F.lit(values)))
    return grid.drop("id") if rows is None else grid

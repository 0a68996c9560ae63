"""Near copies by SimHash: meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a common value within
``radius / 2`` bits of both. So every distinct fingerprint emits its whole ball
of half the radius, balls meet in a shuffle on the emitted value, and members of
one value are linked to the least of them. The link is checked by counting bits;
the triangle inequality says that it always holds, so no pair within a ball is
needed and a value with k members gives k - 1 links. A value has at most as many
members as a ball has points, so no group grows with the data.

Copies share a fingerprint and fold into one row before anything is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlight.llm import texts as tx
from patchlight.llm.components import connected_components
from patchlight.llm.registry import query, table
from patchlight.session import written

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles, repeats included, as a signed 64-bit number; 0 for no word."""
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        digest = xxhash.xxh64_intdigest
        spans = zip(starts, ends[shingle - 1 :].tolist(), strict=False)
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; null and wordless texts have fingerprint 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in tx.slices(batches):
            marks = [fingerprint(tx.lowered(text or b"").split(), shingle, seed) for text in held]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """All masks with at most ``radius`` bits, as signed numbers."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs within ``radius`` bits."""
    if radius % 2:
        raise ValueError("the radius must be even: each side covers half of it")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    near = marks.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    first = F.min("fp").over(Window.partitionBy("value").orderBy("fp").rowsBetween(Window.unboundedPreceding, 0))
    pairs = near.select("fp", first.alias("a")).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_copies(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): documents linked through fingerprints at most ``radius`` bits apart.

    ``component_id`` is the least doc_id that can be reached, the document itself
    included. Null and wordless texts have fingerprint 0 and are linked like any
    other. Repeated rows stay rows; a null doc_id keeps its row and is never a
    component id unless the component has no other. Other columns are ignored.
    """
    found = written(fingerprints(docs, shingle, seed), "fingerprints")
    marks = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "marks")
    groups = connected_components(links(marks.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = marks.join(groups, "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    placed = written(placed.select("fp", "first", "group"), "placed")
    least = placed.groupBy("group").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "group").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The row with the least doc_id of each group, with all its columns as they are.

    Rows without an id are kept, since no order says which of them comes first.
    Rows that share the least id of a group all stay: they are one document.
    """
    groups = near_copies(docs.where("doc_id is not null"), radius, shingle, seed)
    later = written(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "later")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("later_id"))
    return rows.join(later.withColumnRenamed("doc_id", "later_id"), "later_id", "left_anti").select("row.*")


@query
def op9_simhash_near_dedup(spark, sf_dir):
    """Component of near copies of every document."""
    out = near_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

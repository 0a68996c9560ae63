"""Line dedup by pairwise alignment.

Documents overlap when they share a rare line of some words: each holder is paired
with every earlier one. Lines that many documents hold, and short ones, count by
the runs they stand in: the fewest consecutive lines from a line on, or up to it,
that hold the words of a block. Each holder of a run is paired with the run's first
holder, and with the first in some shares of the documents, so pairs grow with the
lines and not with the square of a group. Every line of a block that two
documents share stands in such a run inside the block, and so in a compared pair.
Alignment may still leave a run out where its lines stand in another order in all of these
first holders; that is what comparing all pairs could find beyond this.
Each pair is aligned by patience diff over line hashes, and common blocks of enough
words are deleted from the later document.

Only hashes of lines are joined; texts move once, to lose their lines. All joins
are plain sort-merge joins, whose large partitions Spark splits, so a line or a
document that occurs in a third of all rows is no single task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.llm import texts as tx
from patchlight.llm.registry import query, table
from patchlight.llm.texts import WORD_PATTERN
from patchlight.session import written


@dataclass(frozen=True)
class Settings:
    """Words of a rare line that pairs documents; holders up to which a line is rare; words of a block that is deleted;
    shares of the documents (by a hash) whose first holder of a run the later holders meet."""

    anchor_words: int = 5
    rare: int = 4
    block_words: int = 10
    firsts: int = 4


def patience_matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences, in order: unique common elements in longest increasing order, then the gaps between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _anchors(a, b, a0, a1, b0, b1)
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if anchors:
                todo.append((i + 1, k, j + 1, m))
        out.extend(anchors)
    return sorted(out)


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    seen_a: dict[int, int] = {}
    seen_b: dict[int, int] = {}
    for seen, line, start, stop in ((seen_a, a, a0, a1), (seen_b, b, b0, b1)):
        for k in range(start, stop):
            seen[line[k]] = -1 if line[k] in seen else k
    pairs = [(i, seen_b[x]) for x, i in seen_a.items() if i >= 0 and seen_b.get(x, -1) >= 0]
    pairs.sort()
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at:at + 1] = [j]
        ends[at:at + 1] = [k]
        before[k] = ends[at - 1] if at else -1
    chain = []
    k = ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def common_blocks(later: list[int], earlier: list[int], words: list[int], least: int) -> list[int]:
    """Places of the later document in blocks of consecutive aligned lines that have ``least`` words at least."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience_matches(later, earlier), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= least:
                out.extend(block)
            block = []
        block.append(i)
        last = (i, j)
    return out


def runs_of(lines: np.ndarray, words: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of the shortest runs of lines with ``least`` words from each line on and up to each line.

    ``offsets`` bound the lines of each document. A run that a document has twice is one.
    """
    held = np.concatenate(([0], np.cumsum(words)))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(lines))
    stop = np.searchsorted(held, held[:-1] + least, "left")
    inside = stop <= offsets[1:][owner]
    start = np.searchsorted(held, held[1:] - least, "right") - 1
    after = (start >= offsets[:-1][owner]) & (held[1:] - least >= held[offsets[:-1][owner]])
    sums = tx.PrefixHash(tx.mixed(lines.view(np.uint64)))
    low, high = np.concatenate((place[inside], start[after])), np.concatenate((stop[inside], place[after] + 1))
    found = np.stack((np.concatenate((owner[inside], owner[after])), sums.spans(low, high).view(np.int64)))
    found = np.unique(found, axis=1)
    return found[0], found[1]


def runs(held: DataFrame, least: int) -> DataFrame:
    """(key, run) of every run of every document in ``held(key, lines, words)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column("lines")
            if not len(lines):
                continue
            offsets = lines.offsets.to_numpy()
            owner, run = runs_of(lines.flatten().to_numpy(), batch.column("words").flatten().to_numpy(), offsets - offsets[0], least)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owner)), pa.array(run)], names=["key", "run"])

    return held.select("key", "lines", "words").mapInArrow(cut, "key struct<doc_id:bigint,hash:bigint>, run bigint")


def order_key(doc_id: Column, text: Column) -> Column:
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("hash"))


def removals(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(key, places, earlier): the lines to delete of each later document, and the ids of the documents that hold them.

    ``key`` is (doc_id, hash of the text). Rows without an id or a text take no
    part. Rows that repeat an id and a text are one document, so neither loses
    lines to the other; one id with two texts is two documents.
    """
    lines = F.split("text", "\n")
    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    held = known.select(
        order_key(F.col("doc_id"), F.col("text")).alias("key"), F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD_PATTERN))).alias("words"),
    )
    held = written(held.dropDuplicates(["key"]), "lines")
    zipped = F.explode(F.arrays_zip("lines", "words"))
    spread = held.select("key", zipped.alias("z")).where(F.col("z.words") >= settings.anchor_words)
    holders = spread.select("key", F.col("z.lines").alias("line")).distinct()
    holders = written(holders, "holders")
    shared = holders.groupBy("line").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= settings.rare))
    few = written(holders.join(shared.select("line"), "line"), "rare")
    before = few.select("line", F.col("key").alias("earlier"))
    pairs = few.join(before, "line").where(F.col("earlier") < F.col("key")).select("key", "earlier")
    cut = written(runs(held, settings.block_words), "runs")
    share = F.pmod(F.xxhash64("key"), F.lit(settings.firsts))
    firsts = F.array(*[F.min(F.when(share == k, F.col("key"))) for k in range(settings.firsts)])
    first = cut.groupBy("run").agg(F.count("*").alias("n"), firsts.alias("firsts")).where("n > 1").select("run", "firsts")
    before = F.filter("firsts", lambda x: x < F.col("key"))
    many = cut.join(first, "run").select("key", F.explode(before).alias("earlier")).distinct()
    pairs = written(pairs.union(many).distinct(), "pairs")
    other = held.select(F.col("key").alias("earlier"), F.col("lines").alias("other"))
    ready = pairs.join(held, "key").join(other, "earlier").select("key", "earlier", "lines", "words", "other")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c) for c in ("lines", "other", "words"))
            found = [common_blocks(a.as_py(), b.as_py(), w.as_py(), settings.block_words) for a, b, w in zip(*columns, strict=True)]
            some = pa.array([bool(f) for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("earlier"), pa.array(found, pa.list_(pa.int32()))], names=["key", "earlier", "places"]
            ).filter(some)

    kind = "struct<doc_id:bigint,hash:bigint>"
    cut = ready.mapInArrow(align, f"key {kind}, earlier {kind}, places array<int>")
    # At most as many distinct places as the document has lines, and earlier documents as it has pairs.
    return cut.select("key", "earlier", F.explode("places").alias("place")).groupBy("key").agg(
        F.array_sort(F.collect_set("place")).alias("places"), F.array_sort(F.collect_set("earlier.doc_id")).alias("earlier")
    )


def without_lines(text: Column, places: Column) -> Column:
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda line, k: ~F.array_contains(places, k.cast("int")))
    return F.when(places.isNull(), text).otherwise(F.array_join(kept, "\n"))


def deduplicated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(row, places, earlier, new_text) of every row; ``row`` holds all its columns as they are.

    Rows without an id or a text keep theirs, ``places`` and ``earlier`` are null where
    nothing is deleted, blank lines are lines of no word, and an empty table gives an empty one.
    """
    cut = written(removals(docs, settings), "cuts")
    cut = cut.select(F.col("key.doc_id").alias("cut_id"), F.col("key.hash").alias("cut_hash"), "places", "earlier")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("cut_id"), F.xxhash64("text").alias("cut_hash"))
    # Texts are shuffled at any size: a broadcast while the cuts are few would only hide what the join costs later.
    joined = rows.join(cut.hint("merge"), ["cut_id", "cut_hash"], "left")
    return joined.select("row", "places", "earlier", without_lines(F.col("row.text"), F.col("places")).alias("new_text"))


def deduplicated_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with the text left over; rows that lose all their words this way go, and n_chars follows the text where it is a column.

    Null, empty and blank texts and rows without an id stay as they are; rows that
    repeat an id and a text lose the same lines; other columns stay as they are.
    """
    done = deduplicated(docs, settings)
    done = done.where(F.col("places").isNull() | F.col("new_text").rlike(WORD_PATTERN))
    changed = {"text": F.col("new_text"), "n_chars": F.when(F.col("places").isNull(), F.col("row.n_chars")).otherwise(F.length("new_text").cast("long"))}
    return done.select(*((changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


@query
def op7_line_dedup(spark, sf_dir):
    """Lines and what is left of every document, and the earlier documents that hold what was deleted."""
    done = deduplicated(table(spark, sf_dir, "documents"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"), F.size(F.split(F.coalesce("row.text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_deleted"), F.coalesce("earlier", F.array().cast("array<long>")).alias("earlier_ids"),
        F.sha2(F.coalesce("new_text", F.lit("")), 256).alias("kept_sha256"),
    )

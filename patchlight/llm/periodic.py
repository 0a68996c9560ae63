"""Runs of repeated words: suffix classes united by decreasing common prefix.

A run is a stretch of words with smallest period q that no neighbouring word
extends. At its first place s the suffixes of s and s + q share all of the run but
its first q words, and no place between them shares as much. So a run shows itself
when classes of suffixes are united in the order of decreasing common prefix
(Kruskal on the neighbours of the suffix array): s and s + q become neighbours in
the ordered set of places of one class, at a distance within that prefix.

Suffixes are ordered by doubling, for all documents of a slice at once; a word's
number holds its document, so no prefix crosses texts. Classes of one member leave
at once, and a run that is asked for needs a common prefix of some words (five for
six words and four periods), so that unions only walk over places whose words repeat.
Everything is local to a document: nothing moves between tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight.llm import texts as tx
from patchlight.llm.registry import query, table

#: A run has at least so many words and so many periods.
LEAST, PERIODS = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_BLOCK = 512


class Places:
    """An ordered set of places in blocks, so that one more costs little at any size."""

    def __init__(self, at: int):
        self.blocks, self.last, self.size = [[at]], [at], 1

    def around(self, at: int) -> tuple[int, int]:
        """The places before and after ``at``, which is not held; -1 for none."""
        k = bisect_left(self.last, at)
        if k == len(self.last):
            return self.last[-1], -1
        block = self.blocks[k]
        p = bisect_left(block, at)
        return (block[p - 1] if p else self.last[k - 1] if k else -1), block[p]

    def add(self, at: int) -> None:
        k = min(bisect_left(self.last, at), len(self.last) - 1)
        block = self.blocks[k]
        insort(block, at)
        if len(block) > 2 * _BLOCK:
            self.blocks[k : k + 1] = [block[:_BLOCK], block[_BLOCK:]]
            self.last[k : k + 1] = [block[_BLOCK - 1], block[-1]]
        else:
            self.last[k] = block[-1]
        self.size += 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def suffix_levels(ids: np.ndarray, shared: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the windows of 1, 2, 4, ... words until no two are alike, and the places alike in the widest of up to ``shared`` words.

    Every text ends with a number of its own. A rank is the place of the first of
    its class in the order of windows, so ranks of one level stay comparable with
    those of places that settled earlier.
    """
    _, first, counts = np.unique(ids, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[first].astype(np.int32)
    active = alike = np.flatnonzero(counts[first] > 1)
    levels, width = [rank], 1
    while len(active):
        own, ahead = rank[active], rank[active + width]
        order = np.lexsort((ahead, own))
        active, own, ahead = active[order], own[order], ahead[order]
        at = np.arange(len(active))
        new_class = np.concatenate(([True], own[1:] != own[:-1]))
        new_part = new_class | np.concatenate(([True], ahead[1:] != ahead[:-1]))
        class_at = np.maximum.accumulate(np.where(new_class, at, 0))
        part_at = np.maximum.accumulate(np.where(new_part, at, 0))
        rank = rank.copy()
        rank[active] = own + (part_at - class_at).astype(np.int32)
        levels.append(rank)
        sizes = np.diff(np.append(np.flatnonzero(new_part), len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
        width *= 2
        if width <= shared:
            alike = active
    return levels, alike


def shared_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` share."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a + length] == levels[k][b + length]
        length[same] += 1 << k
    return length


def runs_of(ids: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in texts of word numbers, by start and period.

    ``periods`` is two or more; every text ends with a number of its own.
    """
    needed = min(max(least - d, (periods - 1) * d) for d in range(1, least + 1))
    levels, alike = suffix_levels(ids, needed)
    if not len(alike):
        return []
    order = alike[np.argsort(levels[-1][alike])]
    left, right = order[:-1], order[1:]
    shared = shared_prefix(levels, left, right)
    edges = np.flatnonzero(shared >= needed)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    sets: dict[int, Places] = {}
    found = []

    def seed(a: int, b: int, prefix: int) -> None:
        d = b - a
        if prefix >= (periods - 1) * d and prefix + d >= least and (a == 0 or ids[a - 1] != ids[b - 1]):
            found.append((a, prefix + d, d))

    for a, b, prefix in zip(left[edges].tolist(), right[edges].tolist(), shared[edges].tolist()):
        x = sets.get(a) or sets.setdefault(a, Places(a))
        y = sets.get(b) or sets.setdefault(b, Places(b))
        small, large = (x, y) if x.size <= y.size else (y, x)
        added = list(small)
        ends = [*added[1:], -1]
        before = -1
        for at, after in zip(added, ends):
            low, high = large.around(at)
            if low > before:  # no other place of the small set between them
                seed(low, at, prefix)
            if high >= 0 and (after < 0 or high < after):
                seed(at, high, prefix)
            before = at
        for at in added:
            large.add(at)
            sets[at] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_numbers(pages: tx.Pages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words with a number of its own after each text; first place of each text; word bounds."""
    starts, ends, text_of = pages.words()
    hashes = pages.prefix_sums().spans(starts, ends)
    keys = tx.mixed(hashes + tx.mixed(text_of.astype(tx.U64) + tx.U64(1)))
    sizes = np.bincount(text_of, minlength=pages.count)
    bases = np.cumsum(sizes + 1) - sizes - 1
    ids = np.empty(len(starts) + pages.count, np.int64)
    ids[np.arange(len(starts)) + text_of] = np.unique(keys, return_inverse=True)[1]
    ids[bases + sizes] = len(starts) + np.arange(pages.count)
    return ids, bases, starts, ends


def with_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of docs(doc_id, text).

    ``runs`` lists (start, length, period) by start and period: stretches of words
    `[^\\x20\\x09-\\x0D]+` with that smallest period, at least ``least`` words and
    ``periods`` periods long, that no neighbouring word extends; words are numbered
    from 0. ``collapsed`` is the text without the words that a run holds after its first
    period, joined by one space. A null, empty or blank text has no word, no run and
    an empty ``collapsed``. Repeated rows and null ids stay rows; other columns are
    ignored; an empty table gives an empty one. A text is worked on whole in one task.
    """
    if periods < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.slices(batches):
            ids, bases, starts, ends = word_numbers(tx.Pages(texts))
            sizes = np.diff(np.append(bases, len(ids))) - 1
            found: list[list[dict]] = [[] for _ in texts]
            dropped = np.zeros(len(ids) + 1, np.int64)
            runs = runs_of(ids, least, periods)
            owners = np.searchsorted(bases, [r[0] for r in runs], side="right") - 1
            for (start, length, period), k in zip(runs, owners.tolist()):
                found[k].append({"start": start - int(bases[k]), "length": length, "period": period})
                dropped[start + period] += 1
                dropped[start + length] -= 1
            kept = np.cumsum(dropped)[:-1] == 0
            collapsed = []
            for k, text in enumerate(texts):
                words = (text or b"").split()
                if found[k]:
                    keep = kept[bases[k] : bases[k] + sizes[k]].tolist()
                    words = [w for w, stays in zip(words, keep, strict=True) if stays]
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    run = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = T.StructType([docs.schema["doc_id"]]).add("n_words", "long").add("runs", T.ArrayType(run)).add("collapsed", "string")
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def strongest(runs: Column) -> Column:
    """The run with the most periods, compared as fractions; ties go to the least start, then period. Null for none."""

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, better)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one text in ten, by crc32 of its id, goes on with a period of its own words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n = F.size("words")
    a = g % n
    period = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % period)
    edited = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("words", (place(i) + 1).cast("int"))), " ")
    found = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"))
    return found.select("doc_id", F.when(F.size("words") > 0, edited).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark, sf_dir):
    """Runs of every document and the text without their repeats."""
    found = with_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )

"""Benchmark decontamination: q-gram counts in diagonal bands, then banded alignment.

An item of m characters occurs in a text with at most e edits only if some
diagonal band of the pair shares at least ``m - q + 1 - q * e`` q-grams (the
q-gram lemma). Bands are e + 1 diagonals wide and overlap by e, so the diagonals
of an occurrence always lie in one band. Bands that reach the bound are aligned
exactly, within the band; nothing else is ever compared.

Texts and items are compared lower-cased with every run of other characters than
letters and digits as one space. Documents are never shuffled: the items, a
stated query set, travel to the tasks in blocks of bounded size, and the
documents are read once for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm import texts as tx
from patchlight.llm.registry import query, table

Q = 10
EDIT_RATE = 0.08
#: Characters of items that travel to the tasks at once.
BLOCK_CHARS = 4_000_000
FILTER_BITS = 22
CHUNK = 1 << 21

_OTHER = re.compile(r"[\W_]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place, by doubling."""
    if len(chars) < q:
        return np.empty(0, np.uint64)
    have, width = tx.mixed(chars.astype(np.uint64) + np.uint64(1)), 1
    out, covered = None, 0
    while True:
        if q & width:
            part = have[covered : covered + len(chars) - q + 1]
            out = part.copy() if out is None else (out ^ (out >> np.uint64(29))) * _B + part
            covered += width
        if covered == q:
            return tx.mixed(out)
        have = (have[:-width] ^ (have[:-width] >> np.uint64(31))) * _A + have[width:]
        width *= 2


def budget(length: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits that an item of this length may differ by; small enough for the lemma to ask for one q-gram at least."""
    return max(0, min(int(rate * length), (length - q) // q))


@dataclass(frozen=True)
class Index:
    """Items of one block: their ids, texts and budgets, and the places of every q-gram."""

    ids: list[list[int | None]]
    texts: list[str]
    edits: np.ndarray
    needed: np.ndarray
    short: list[int]
    grams: np.ndarray
    first: np.ndarray
    item_at: np.ndarray
    place_at: np.ndarray
    seen: np.ndarray
    q: int


def build_index(items: dict[str, list[int | None]], q: int = Q, rate: float = EDIT_RATE) -> Index:
    names = sorted(items)
    sizes = np.array([len(t) for t in names], np.int64)
    edits = np.array([budget(m, q, rate) for m in sizes.tolist()], np.int64)
    hashes = [gram_hashes(characters(t), q) for t in names]
    counts = [len(h) for h in hashes]
    grams = np.concatenate([*hashes, np.empty(0, np.uint64)])
    item_at = np.repeat(np.arange(len(names)), counts)
    place_at = np.concatenate([*(np.arange(c) for c in counts), np.empty(0, np.int64)]).astype(np.int64)
    order = np.argsort(grams, kind="stable")
    distinct, first = np.unique(grams[order], return_index=True)
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[distinct >> np.uint64(64 - FILTER_BITS)] = True
    return Index(
        [items[t] for t in names], names, edits, sizes - q + 1 - q * edits, [k for k, m in enumerate(sizes.tolist()) if 0 < m < q],
        distinct, np.append(first, len(grams)), item_at[order], place_at[order], seen, q,
    )


def blocks(benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, size: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes over the items, each over at most ``size`` characters or one item; null and empty items are in none."""
    held: dict[str, list[int | None]] = {}
    chars = 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if held and chars + len(text) > size:
            yield build_index(held, q, rate)
            held, chars = {}, 0
        ids = held.setdefault(text, [])
        if row["item_id"] not in ids:
            ids.append(row["item_id"])
        chars += len(text)
    if held:
        yield build_index(held, q, rate)


def band_counts(index: Index, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, band, shared q-grams) of the bands of one text that reach the bound of their item."""
    places = np.flatnonzero(index.seen[hashes >> np.uint64(64 - FILTER_BITS)])
    at = np.searchsorted(index.grams, hashes[places])
    hit = at < len(index.grams)
    hit[hit] = index.grams[at[hit]] == hashes[places[hit]]
    places, at = places[hit], at[hit]
    many = index.first[at + 1] - index.first[at]
    ends = np.cumsum(many)
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    span = int(len(hashes) + max(map(len, index.texts), default=0)) * 2 + 2
    start = 0
    while start < len(places):
        # Counts add up over chunks, so hits are expanded a bounded number at a time.
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
        n = many[start:stop]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(index.first[at[start:stop]], n) + offset
        item = index.item_at[place]
        width = index.edits[item] + 1
        diagonal = np.repeat(places[start:stop], n) - index.place_at[place]
        band = diagonal // width
        overlap = diagonal - band * width < index.edits[item]
        key = np.concatenate((item * span + band + span // 2, (item * span + band - 1 + span // 2)[overlap]))
        got, count = np.unique(key, return_counts=True)
        both = np.concatenate((keys, got))
        keys, inverse = np.unique(both, return_inverse=True)
        sums = np.bincount(inverse, np.concatenate((sums, count)), len(keys)).astype(np.int64)
        start = stop
    item, band = keys // span, keys % span - span // 2
    enough = sums >= index.needed[item]
    return item[enough], band[enough], sums[enough]


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Least edits between the item and any part of the text on diagonals low..high, and where that part ends."""
    d = np.arange(low, high + 1)
    far = len(item) + len(text) + 1
    row = np.where((d >= 0) & (d <= len(text)), 0, far)
    padded = np.concatenate((np.full(max(0, -low), 0xFFFFFFFF, np.uint32), text, np.full(max(0, high + len(item) - len(text)), 0xFFFFFFFF, np.uint32)))
    shift = max(0, -low)
    steps = np.arange(len(d))
    for i, c in enumerate(item):
        column = padded[low + shift + i : low + shift + i + len(d)]
        best = row + (column != c)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        inside = (d + i + 1 >= 0) & (d + i + 1 <= len(text))
        best = np.where(inside, best, far)
        row = np.where(inside, np.minimum.accumulate(best - steps) + steps, far)
    end = int(row.argmin())
    return int(row[end]), int(d[end]) + len(item)


def matches(index: Index, text: str) -> list[tuple[int, int, int]]:
    """(item, distance, end) of the items that occur in a text within their budgets, the best occurrence of each."""
    line = normal(text)
    best: dict[int, tuple[int, int]] = {}
    for item in index.short:
        at = f" {line} ".find(f" {index.texts[item]} ")
        if at >= 0:
            best[item] = (0, at + len(index.texts[item]))
    chars = characters(line)
    hashes = gram_hashes(chars, index.q)
    if len(hashes):
        for item, band, _ in zip(*(x.tolist() for x in band_counts(index, hashes)), strict=True):
            if best.get(item, (1, 0))[0] == 0:
                continue
            e, m = int(index.edits[item]), len(index.texts[item])
            low, high = band * (e + 1), band * (e + 1) + 2 * e
            left = max(0, low)
            part = line[left : max(0, high + m) + e]
            at = part.find(index.texts[item])
            if at >= 0:
                best[item] = (0, left + at + m)
                continue
            distance, end = banded_distance(characters(index.texts[item]), characters(part), low - left - e, high - left + e)
            if distance <= e and distance < best.get(item, (e + 1, 0))[0]:
                best[item] = (distance, left + end)
    return [(item, d, end) for item, (d, end) in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end) for every document and item that occurs in it.

    ``distance`` are the edits of the best occurrence and ``end`` its end in the
    normalised text. An item of m characters may be off by ``rate * m`` edits;
    items under q characters must occur word for word. Null and empty texts and
    items match nothing, and equal items or repeated rows match each on their own.
    Other columns are ignored; empty tables give an empty one.
    """
    schema = "doc_id long, item_id long, distance int, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in blocks(benchmark, q, rate, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for part, texts in tx.slices(batches):
                found = [
                    (key, item_id, distance, end)
                    for key, text in zip(part.column("doc_id").to_pylist(), texts, strict=True)
                    for item, distance, end in matches(index, (text or b"").decode("utf-8", "replace"))
                    for item_id in index.ids[item]
                ]
                columns = list(zip(*found, strict=True)) or [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "end"]
                )

        out = out.union(docs.select("doc_id", "text").mapInArrow(rows, schema))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns as they are.

    Null and empty texts hold no item and stay, as do all rows where there are no
    items; repeated rows and null ids are like any other; an empty table gives an empty one.
    """
    schema = docs.schema
    for index in blocks(benchmark, q, rate, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, texts in tx.slices(batches):
                kept = [not matches(shared.value, (text or b"").decode("utf-8", "replace")) for text in texts]
                yield part.filter(pa.array(kept, pa.bool_()))

        docs = docs.mapInArrow(rows, schema)
    return docs


@query
def op5_benchmark_decontamination(spark, sf_dir):
    """Every document and benchmark item that occurs in it."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", F.col("distance").cast("long").alias("distance"))

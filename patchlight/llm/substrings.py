"""Exact substring dedup: bytes covered by a string of fixed length that also starts earlier.

Each window of ``length`` bytes names one place inside itself, its anchor: the
leftmost of its ``gram``-byte strings with the least hash. Equal windows have
their anchors at the same offset over the same bytes, so a window can only repeat
one whose anchor holds the same gram. Consecutive windows with one anchor make a
segment, about one for every 35 bytes.

1. Tasks cut texts into segments (gram, hash of the whole segment, place). A
   segment that a task has seen before is a repeat; runs of them go on as one row.
   The others are sorted by gram, then hash, in a shuffle. Equal segments repeat
   all their windows, and the first of them stays.
2. Segments with one gram but different bytes, the borders of repeats, are the
   only ones whose windows are compared one by one. Their bytes meet by gram, and
   a task compares the windows of some grams at a time; grams with more borders than a
   task takes at a time are dealt to several tasks, whose first windows are rows of their
   own, shuffled by (gram, hash), so that no gram is one task's work.
3. Spans of repeats go back to their texts, which lose them.

Nothing is paired, groups are sorted on disk and streamed, and all joins with the
texts read one exchange. Places are packed in one number: 17 bits of a hash of the
text (one id may have two texts), 32 bits of position, 14 bits for the number of
windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlight.llm import texts as tx
from patchlight.llm.registry import query, table
from patchlight.session import written

LENGTH = 100
GRAM = 32
TIE_BITS, PLACE_BITS, COUNT_BITS = 17, 32, 14
#: Segments a task compares with each other before it passes them on.
FLUSH = 1 << 19
#: Borders whose windows a task compares at a time; grams with more are dealt to several tasks.
BORDERS = 1 << 14

_NO_ID = np.int64(np.iinfo(np.int64).max)


def tie_of(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 7) >> (64 - TIE_BITS)


def pack(tie: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (tie << PLACE_BITS | place) << COUNT_BITS | count


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tie, place and number of windows."""
    return packed >> (PLACE_BITS + COUNT_BITS), packed >> COUNT_BITS & ((1 << PLACE_BITS) - 1), packed & ((1 << COUNT_BITS) - 1)


def merged(doc: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of windows with those that follow one another in a text put together, as long as the count fits."""
    order = np.lexsort((packed, doc))
    doc, packed = doc[order], packed[order]
    tie, place, count = unpack(packed)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (place[1:] > place[:-1] + count[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return doc, packed
    stop = np.maximum.reduceat(place + count, first)
    size = stop - place[first]
    most = (1 << COUNT_BITS) - 1
    parts = -(-size // most)
    step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * most
    held = np.repeat(first, parts)
    return doc[held], pack(tie[held], place[held] + step, np.minimum(most, np.repeat(size, parts) - step))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, by doubling."""
    have, size = values, 1
    while 2 * size <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


class Segments:
    """Segments of a slice: text, first window in it, number of windows, gram at the anchor, hash of the whole."""

    def __init__(self, texts: list[bytes | None], length: int = LENGTH, gram: int = GRAM):
        pages = tx.Pages(texts)
        self.pages, self.sums = pages, pages.prefix_sums()
        none = np.empty(0, np.int64)
        self.text = self.place = self.count = none
        self.gram = self.whole = np.empty(0, np.uint64)
        n = len(pages.buffer) - length + 1
        if n <= 0:
            return
        at = np.arange(len(pages.buffer) - gram + 1)
        grams = self.sums.spans(at, at + gram)
        bits = np.uint64(24)
        # The hash above, the place below: the least is the leftmost of the least hashes.
        at = (at & ((1 << 24) - 1)).astype(np.uint64) if len(at) <= 1 << 24 else None
        if at is None:
            raise ValueError("a slice is longer than 16 MB")
        least = sliding_min((grams >> bits) << bits | at, length - gram + 1)[:n]
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        sizes = np.maximum(pages.ends - pages.starts - length + 1, 0)
        valid = np.zeros(n + 1, np.int64)
        np.add.at(valid, pages.starts[sizes > 0], 1)
        np.add.at(valid, (pages.starts + sizes)[sizes > 0], -1)
        valid = np.cumsum(valid[:n]) > 0
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        begin = np.flatnonzero(begins)
        if not len(begin):
            return
        run = np.flatnonzero(valid)
        self.count = np.diff(np.append(np.searchsorted(run, begin), len(run)))
        self.text = np.searchsorted(pages.ends, begin, "left")
        self.place = begin - pages.starts[self.text]
        self.gram = grams[anchor[begin]]
        self.whole = self.sums.spans(begin, begin + self.count - 1 + length)


#: Above this a text is cut into overlapping pieces, since places in a slice have 24 bits.
PIECE = 1 << 23


def pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(id, tie, first byte, bytes) of texts; long ones in pieces that overlap by ``length - 1``, so each window is in one piece."""
    for part, texts in tx.slices(batches):
        ids = part.column("doc_id").fill_null(int(_NO_ID)).to_numpy()
        ties = np.array([tie_of(t or b"") for t in texts], np.int64)
        if max((len(t or b"") for t in texts), default=0) <= PIECE:
            yield ids, ties, np.zeros(len(ids), np.int64), texts
            continue
        for doc_id, tie, text in zip(ids, ties, texts, strict=True):
            for at in range(0, max(len(text or b"") - length + 1, 1), PIECE):
                yield np.array([doc_id]), np.array([tie]), np.array([at]), [(text or b"")[at : at + PIECE + length - 1]]


def firsts(columns: list[np.ndarray], key: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows sorted by all columns, and which of them have the same first ``key`` columns as a row before and another place."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    same = np.ones(len(order), bool)
    same[:1] = False
    for c in columns[:key]:
        same[1:] &= c[1:] == c[:-1]
    group = np.cumsum(~same) - 1
    first = np.flatnonzero(~same)
    again = np.zeros(len(order), bool)
    for c in columns[key:]:
        again |= c != c[first[group]]
    return columns, again


SEGMENT = "gram long, whole int, doc long, place long, again boolean"
WINDOW = "gram int, whole long, doc long, place long, again boolean"


def low32(values: np.ndarray) -> np.ndarray:
    """32 bits of a hash: with the 64 of the other one, 96 bits tell strings apart."""
    return (values.view(np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of all texts, and as rows that are ``again`` the spans that a task knows to repeat earlier ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            columns, again = firsts([np.concatenate(c) for c in zip(*held, strict=True)], 2)
            # A place is passed on once: rows that repeat an id and a text are one document.
            fresh = ~again
            same = np.ones(max(len(again) - 1, 0), bool)
            for c in columns:
                same &= c[1:] == c[:-1]
            fresh[1:] &= ~same
            doc, place = merged(columns[2][again], columns[3][again])
            # Spans have no gram; the place spreads them.
            spans = [tx.mixed(place.astype(np.uint64)).view(np.int64), np.zeros(len(doc), np.int32), doc, place, np.ones(len(doc), bool)]
            grams, hashes, docs, places = (c[fresh] for c in columns)
            kept = [grams.view(np.int64), low32(hashes), docs, places, np.zeros(len(docs), bool)]
            for rows in (kept, spans):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["gram", "whole", "doc", "place", "again"])

        rows = 0
        for ids, ties, at, texts in pieces(batches, length):
            s = Segments(texts, length, gram)
            held.append([s.gram, s.whole, ids[s.text], pack(ties[s.text], s.place + at[s.text], s.count)])
            rows += len(s.text)
            if rows >= FLUSH:
                yield from flushed()
                held, rows = [], 0
        if held:
            yield from flushed()

    return docs.select("doc_id", "text").mapInArrow(cut, SEGMENT)


def windows_of(gram: np.ndarray, doc: np.ndarray, packed: np.ndarray, held: list[bytes], length: int) -> list[np.ndarray]:
    """(gram, hash, doc, place) of every window of segments given by their bytes."""
    tie, place, count = unpack(packed)
    sizes = count - 1 + length
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(sizes) - sizes, count) + step
    whole = tx.PrefixHash(np.frombuffer(b"".join(held), np.uint8)).spans(begin, begin + length)
    places = pack(np.repeat(tie, count), np.repeat(place, count) + step, np.ones(len(step), np.int64))
    return [np.repeat(gram, count), whole.view(np.int64), np.repeat(doc, count), places]


def border_texts(placed: DataFrame, borders: DataFrame, length: int) -> DataFrame:
    """(gram, border, doc, place, part) of the segments in ``borders(doc, places, grams, sizes)``: their bytes, cut from the texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.slices(batches):
            columns: list[list] = [[], [], [], [], []]
            lists = (part.column(c) for c in ("places", "grams", "sizes"))
            for doc, text, places, grams, sizes in zip(part.column("doc").to_pylist(), texts, *lists, strict=True):
                packed = places.values.to_numpy()
                tie, place, count = unpack(packed)
                mine = np.flatnonzero(tie == tie_of(text))
                columns[0].append(grams.values.to_numpy()[mine])
                columns[1].append(sizes.values.to_numpy()[mine])
                columns[2].append(np.full(len(mine), doc))
                columns[3].append(packed[mine])
                columns[4].extend(text[place[k] : place[k] + count[k] - 1 + length] for k in mine.tolist())
            arrays = [pa.array(np.concatenate(c)) for c in columns[:4]]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(columns[4], pa.binary())], names=["gram", "border", "doc", "place", "part"])

    kind = "gram long, border long, doc long, place long, part binary"
    return placed.join(borders, "doc").select("doc", "text", "places", "grams", "sizes").mapInArrow(cut, kind)


def repeats_in_task(parts: DataFrame, length: int) -> DataFrame:
    """(doc, place) of the windows of border segments that start earlier in another segment of their gram."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rows.num_rows < BORDERS:
                rest = rows
                continue
            grams = rows.column("gram").to_numpy()
            # The last gram may go on in the next batch.
            stop = int(np.searchsorted(grams, grams[-1], "left"))
            rest = rows.slice(stop)
            if stop:
                yield from resolved(rows.slice(0, stop))
        if rest is not None and rest.num_rows:
            yield from resolved(rest)

    def resolved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, doc, place = (rows.column(c).to_numpy() for c in ("gram", "doc", "place"))
        columns, again = firsts(windows_of(gram, doc, place, rows.column("part").to_pylist(), length), 2)
        spans = merged(columns[2][again], columns[3][again])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans], names=["doc", "place"])

    return parts.repartition("gram").sortWithinPartitions("gram").mapInArrow(compare, "doc long, place long")


def repeats_by_window(parts: DataFrame, length: int) -> DataFrame:
    """The same for grams with more than ``BORDERS`` borders, which are dealt to as many tasks as they need.

    What a task knows to repeat goes on as spans; only the first of equal windows of
    a task is a row of its own, and those of all tasks meet by (gram, hash).
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BORDERS):
                rows = batch.slice(start, BORDERS)
                gram, doc, place = (rows.column(c).to_numpy() for c in ("gram", "doc", "place"))
                columns, again = firsts(windows_of(gram, doc, place, rows.column("part").to_pylist(), length), 2)
                docs, places = merged(columns[2][again], columns[3][again])
                # Spans have no gram; the place spreads them.
                spans = [low32(tx.mixed(places.astype(np.uint64)).view(np.int64)), np.zeros(len(docs), np.int64), docs, places, np.ones(len(docs), bool)]
                kept = [low32(columns[0][~again]), *(c[~again] for c in columns[1:]), np.zeros(int((~again).sum()), bool)]
                for some in (kept, spans):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in some], names=["gram", "whole", "doc", "place", "again"])

    share = F.pmod(F.xxhash64("doc"), F.ceil(F.col("border") / BORDERS))
    windows = parts.repartition("gram", share).sortWithinPartitions("gram").mapInArrow(spread, WINDOW)
    first = F.first(F.struct("doc", "place")).over(Window.partitionBy("again", "gram", "whole").orderBy("doc", "place"))
    return windows.withColumn("first", first).where(F.col("again") | (F.col("first") != F.struct("doc", "place"))).select("doc", "place")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(text: bytes, places: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """Bytes removed, runs removed and what is left when windows at packed places are cut from a text."""
    if not len(places):
        return 0, 0, text
    tie, place, count = unpack(places)
    mine = tie == tie_of(text)
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, place[mine], 1)
    np.add.at(change, place[mine] + count[mine] - 1 + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Null texts are empty. Rows that repeat an id and a text are one document;
    one id with two texts is two, in the order of a hash of the text; rows without
    an id come last. Texts under ``length`` bytes lose nothing. Other columns are
    ignored; an empty table gives an empty one.
    """
    found = segments(docs, length, gram).select("again", "gram", "whole", F.struct("doc", "place").alias("at"))
    same = Window.partitionBy("again", "gram", "whole").orderBy("at")
    group = Window.partitionBy("again", "gram")
    ranked = (
        found.repartition("gram")
        .withColumn("repeat", F.col("again") | (F.first("at").over(same) != F.col("at")))
        .withColumn("border", F.when(F.min("whole").over(group) < F.max("whole").over(group), F.sum((~F.col("repeat")).cast("int")).over(group)))
        .where(F.col("repeat") | F.col("border").isNotNull())
        .select("at.doc", "at.place", F.when(~F.col("repeat"), F.col("gram")).alias("gram"), F.when(~F.col("repeat"), F.col("border")).alias("border"))
    )
    level = written(ranked, "segments")
    # Texts move once: all joins below read the same exchange.
    placed = docs.select(F.coalesce("doc_id", F.lit(int(_NO_ID))).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).repartition("doc")

    def parts(which) -> DataFrame:
        own = level.where(which).groupBy("doc").agg(F.collect_list(F.struct("place", "gram", "border")).alias("b"))
        named = own.select("doc", F.col("b.place").alias("places"), F.col("b.gram").alias("grams"), F.col("b.border").alias("sizes"))
        return border_texts(placed, named, length)

    few = repeats_in_task(parts(F.col("border") <= BORDERS), length)
    many = repeats_by_window(parts(F.col("border") > BORDERS), length)
    spans = level.where(F.col("border").isNull()).select("doc", "place").union(few).union(many)
    cuts = spans.groupBy("doc").agg(F.collect_list("place").alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.slices(batches):
            columns: list[list] = [[], [], [], []]
            for text, places in zip(texts, part.column("places"), strict=True):
                gone, runs, left = removed(text, places.values.to_numpy() if places.is_valid else np.empty(0, np.int64), length)
                for column, value in zip(columns, (len(text), gone, runs, tx.sha256_hex(left)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    out = placed.join(cuts, "doc", "left").select("doc", "text", "places").mapInArrow(cut, RESULT)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(int(_NO_ID))))


@query
def op10_substring_dedup(spark, sf_dir):
    """What is left of every document without the 100-byte strings that start earlier."""
    return deduplicated(table(spark, sf_dir, "documents"))

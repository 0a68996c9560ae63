"""Substring dedup by MinHash banding of paragraphs.

Equal paragraphs fold into classes first. Classes that share a band of their
signature meet in a bucket; every member is first compared with the most central member
of its bucket, and linked ones become one group. In every bucket that this leaves
with several groups all members of different groups are then compared, in tasks that
read a bucket, or two blocks of a large one, and multiply its table of classes and
shingles by itself piece by piece. So no pair that shares a band is left out, while rows are
classes in buckets and the links that join groups. Similarity is the exact Jaccard
similarity of shingles, and components of the links are the groups
of which the first paragraph stays.

Paragraphs are the lines of a text, or whole texts (``Settings.whole``), which is
how near copies among documents are found; words are lower-cased in A-Z. With
lines, passages that repeat inside longer lines or across them are folded as well:
windows of words that the text itself chooses (see ``passages_of``), so that no
passage of ``Settings.surely`` words that occurs twice is missed. Buckets,
classes and hubs are joined by plain sort-merge joins, whose large partitions
Spark splits, and counts are pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlight.llm import texts as tx
from patchlight.llm.components import connected_components
from patchlight.llm.registry import query, table
from patchlight.session import written

SHINGLE = 5


def collision(similarity: float, bands: int, rows: int) -> float:
    """Chance that two sets of this similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def tune(threshold: float, recall: float, most_hashes: int = 128, most_false: float = 0.5) -> tuple[int, int]:
    """The fewest bands that reach the recall at the threshold, and their rows.

    Every band is a row to shuffle for each paragraph, while a false candidate only
    costs a comparison. So of the shapes that reach the recall, with sets of half
    the threshold colliding at most at ``most_false`` (or as little above it as can
    be), the one with fewest bands.
    """
    shapes = [(b, r) for r in range(1, 9) for b in range(1, most_hashes // r + 1) if collision(threshold, b, r) >= recall]
    return min(shapes, key=lambda s: (max(collision(threshold / 2, *s) - most_false, 0.0), s))


@dataclass(frozen=True)
class Settings:
    """Words from which a paragraph or a passage counts, words from which a passage is surely found, least similarity,
    wanted recall at it; whether a text is one paragraph, whatever its words."""

    least_words: int = 20
    surely: int = 51
    threshold: float = 0.8
    recall: float = 0.999
    shape: tuple[int, int] = field(default=(0, 0))
    whole: bool = False

    def bands(self) -> tuple[int, int]:
        return self.shape if self.shape[0] else tune(self.threshold, self.recall)


@dataclass
class Found:
    """Paragraphs of a slice: text number, line number, words, shingle hashes and where each paragraph's begin."""

    text_of: np.ndarray
    line_no: np.ndarray
    n_words: np.ndarray
    shingles: np.ndarray
    begin: np.ndarray
    names: tuple[np.ndarray, np.ndarray]


def paragraphs_of(texts: list[bytes | None], least_words: int, whole: bool = False) -> Found:
    """Lines of enough words; or texts of any word, which are their line 0 and, below a shingle, one shingle of all words."""
    pages = tx.Pages(texts, lower=True)
    starts, ends, text_of = pages.words()
    words = pages.prefix_sums().spans(starts, ends)
    breaks = np.flatnonzero(pages.buffer == 10)
    line_of = text_of if whole else np.searchsorted(breaks, starts, "left")
    lines, first, n = np.unique(line_of, return_index=True, return_counts=True)
    held = n >= (1 if whole else max(least_words, SHINGLE))
    lines, first, n = lines[held], first[held], n[held]
    # The last break of a text closes its last line, so line numbers count from the end of the text before.
    owner = text_of[first]
    before = lines if whole else np.where(owner > 0, np.searchsorted(breaks, pages.ends[owner - 1], "right"), 0)
    counts = np.maximum(n - SHINGLE + 1, 1)
    begin = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) - np.repeat(begin - first, counts)
    shingles = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        if whole:
            inside = k < np.repeat(n, counts)
            shingles = np.where(inside, shingles * np.uint64(0x9E3779B97F4A7C15) + words[np.where(inside, at + k, 0)], shingles)
        else:
            shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + words[at + k]
    shingles = tx.mixed(shingles)
    names = []
    for salt in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
        # Order matters in a name: each shingle is mixed with its place.
        place = (at - np.repeat(first, counts)).astype(np.uint64) * np.uint64(salt)
        total = np.add.reduceat(tx.mixed(shingles + place), begin) if len(begin) else np.empty(0, np.uint64)
        names.append(tx.mixed(total + n.astype(np.uint64)).view(np.int64))
    return Found(owner, (lines - before).astype(np.int64), n.astype(np.int64), shingles, begin, (names[0], names[1]))


def signatures(shingles: np.ndarray, begin: np.ndarray, bands: int, rows: int, seed: int = 0) -> np.ndarray:
    """A number for each paragraph and band, equal where all the least hashes of a band are."""
    if not len(begin):
        return np.empty((0, bands), np.int64)
    factors = tx.mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
    out = np.zeros((len(begin), bands), np.uint64)
    for k, factor in enumerate(factors):
        values = shingles * factor
        values ^= values >> np.uint64(32)
        band = k // rows
        out[:, band] = tx.mixed(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(values, begin) + np.uint64(band))
    return out.view(np.int64)


def passages_of(texts: list[bytes | None], size: int, surely: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Windows of ``size`` words that texts choose: text number, line number, first word and two names of each.

    Of any ``surely - size + 1`` windows in a row the one with the least hash is
    chosen, the first of equal ones. So a passage of ``surely`` words has a window that is chosen wherever it stands.
    """
    pages = tx.Pages(texts, lower=True)
    starts, ends, text_of = pages.words()
    words = pages.prefix_sums().spans(starts, ends)
    hashes, at = tx.word_grams(words, text_of, size)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, [none, none]
    wide, owner = surely - size + 1, text_of[at]
    firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    counts = np.diff(np.append(firsts, len(at)))
    # Windows of windows that lie in one text, or all of a text that has fewer.
    many = np.maximum(counts - wide + 1, 1)
    begins = np.repeat(firsts - (np.cumsum(many) - many), many) + np.arange(many.sum())
    stops = np.repeat(firsts + counts, many)
    padded = np.append(hashes, np.full(wide - 1, np.iinfo(np.uint64).max, np.uint64))
    chosen = []
    for cut in range(0, len(begins), 1 << 16):
        own = begins[cut : cut + (1 << 16)]
        span = own[:, None] + np.arange(wide)
        values = np.where(span < stops[cut : cut + (1 << 16), None], padded[span], np.iinfo(np.uint64).max)
        chosen.append(own + values.argmin(axis=1))
    picked = np.unique(np.concatenate(chosen))
    at, owner = at[picked], owner[picked]
    breaks = np.flatnonzero(pages.buffer == 10)
    before = np.where(owner > 0, np.searchsorted(breaks, pages.ends[owner - 1], "right"), 0)
    line = np.searchsorted(breaks, starts[at], "left") - before
    first_word = np.searchsorted(text_of, owner, "left")
    other = np.zeros(len(at), np.uint64)
    for k in range(size):
        other = tx.mixed(other + words[at + k])
    return owner, line, at - first_word, [hashes[picked].view(np.int64), other.view(np.int64)]


CLASS = "class struct<a:bigint,b:bigint>"


def named(found: Found) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x) for x in found.names], names=["a", "b"])


def signed_paragraphs(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, line, n_words, class, bands) of every paragraph with enough words."""
    bands, rows = settings.bands()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.slices(batches):
            found = paragraphs_of(texts, settings.least_words, settings.whole)
            marks = signatures(found.shingles, found.begin, bands, rows)
            offsets = pa.array(np.arange(len(marks) + 1) * bands, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(found.text_of)), pa.array(found.line_no), pa.array(found.n_words), named(found),
                    pa.ListArray.from_arrays(offsets, pa.array(marks.reshape(-1))),
                ],
                names=["doc_id", "line", "n_words", "class", "bands"],
            )

    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    return known.mapInArrow(sign, f"doc_id long, line long, n_words long, {CLASS}, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(class, shingles) of the classes in ``wanted(class, doc_id)``: distinct hashes of the shingles of a text that holds it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.slices(batches):
            found = paragraphs_of(texts, settings.least_words, settings.whole)
            asked = [{(c["a"], c["b"]) for c in row} for row in part.column("classes").to_pylist()]
            stops = np.append(found.begin[1:], len(found.shingles))
            rows = list(zip(found.text_of.tolist(), *(x.tolist() for x in found.names), found.begin.tolist(), stops.tolist(), strict=True))
            out = {}
            for text, a, b, start, stop in rows:
                if (a, b) in asked[text] and (text, a, b) not in out:
                    out[text, a, b] = np.unique(found.shingles[start:stop]).view(np.int64)
            keys = pa.array([{"a": a, "b": b} for _, a, b in out], pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([keys, pa.array(list(out.values()), pa.list_(pa.int64()))], names=["class", "shingles"])

    # A text asks for as many classes as it has paragraphs at most.
    asked = wanted.groupBy("doc_id").agg(F.collect_set("class").alias("classes"))
    rows = docs.select("doc_id", "text").where("text is not null").join(asked, "doc_id").select("text", "classes")
    # One id may stand for several rows, of which each may hold the class.
    return rows.mapInArrow(cut, f"{CLASS}, shingles array<long>").dropDuplicates(["class"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets are similar enough.

    Sizes meet first: sets of very unequal sizes are not similar, so only the shingles of the other pairs move.
    """
    size = lambda end: sets.select(F.col("class").alias(end), F.size("shingles").alias(f"n_{end}"))
    sized = pairs.select("a", "b").join(size("a"), "a").join(size("b"), "b")
    like = written(sized.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")).select("a", "b"), "pairs")
    some = sets.join(like.select(F.col("a").alias("class")).union(like.select("b")).distinct(), "class", "left_semi")
    left = some.select(F.col("class").alias("a"), F.col("shingles").alias("in_a"))
    right = some.select(F.col("class").alias("b"), F.col("shingles").alias("in_b"))
    common = F.size(F.array_intersect("in_a", "in_b"))
    return (
        like.join(left, "a").join(right, "b")
        .withColumn("common", common)
        .where(F.col("common") >= threshold * (F.size("in_a") + F.size("in_b") - F.col("common")))
        .select("a", "b")
    )


#: Classes of a bucket that meet in one task; larger buckets are cut into blocks of half as many, of which every two meet.
MEET = 4096
#: Numbers in a table of classes and shingles that are multiplied at a time.
CELLS = 1 << 22


def links_among(groups: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of sets, given one after another in ``shingles``, that join all groups with a similar pair of sets between them.

    Every pair of sets in different groups is compared, but for those of too unequal sizes.
    """
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    begins = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(ranked) - ranked, ranked) + np.repeat(begins[order], ranked)
    owner = np.repeat(np.arange(len(order)), ranked)
    _, number, times = np.unique(shingles[at], return_inverse=True, return_counts=True)
    # What one set holds alone is in no intersection.
    held = times[number] > 1
    owner, number = owner[held], number[held]
    bounds = np.searchsorted(owner, np.arange(len(order) + 1))
    column = np.full(len(times), -1)
    up = np.unique(groups[order], return_inverse=True, return_index=True)
    up = up[1][up[2]]
    found = []
    low = 0
    while low < len(order):
        step = max(1, min(256, int((CELLS / max(ranked[min(low + 255, len(order) - 1)], 1)) ** 0.5)))
        high = min(low + step, len(order))
        # Sets are in the order of their sizes, so those that may be alike are next to each other.
        last = int(np.searchsorted(ranked, ranked[high - 1] / threshold, "right"))
        mine = number[bounds[low] : bounds[high]]
        names = np.unique(mine)
        if len(names) and (up[low:last] != up[low]).any():
            column[names] = np.arange(len(names))
            left = np.zeros((high - low, len(names)), np.float32)
            left[owner[bounds[low] : bounds[high]] - low, column[mine]] = 1
            wide = max(1, CELLS // len(names))
            for start in range(low, last, wide):
                stop = min(start + wide, last)
                theirs = column[number[bounds[start] : bounds[stop]]]
                inside = theirs >= 0
                right = np.zeros((stop - start, len(names)), np.float32)
                right[owner[bounds[start] : bounds[stop]][inside] - start, theirs[inside]] = 1
                # Whole numbers below 2^24 are exact.
                common = (left @ right.T).astype(np.float64)
                like = common >= threshold * (ranked[low:high, None] + ranked[None, start:stop] - common)
                for i, j in np.argwhere(like & (up[low:high, None] != up[None, start:stop])).tolist():
                    i, j = i + low, j + start
                    if up[i] != up[j]:
                        found.append((int(order[i]), int(order[j])))
                        up[up == up[j]] = up[i]
            column[names] = -1
        low = high
    return found


def links_in_buckets(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, group_a, group_b): links between the groups in ``members(bucket, class, group)``.

    In every bucket of several groups all classes of different groups are compared by
    their whole shingle sets, whatever the size of the bucket; of the links found, those that join groups are returned.
    """
    several = members.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("size")).where("low <> high")
    met = members.join(several.select("bucket", "size"), "bucket")
    # Each two blocks of a large bucket meet, and so do the classes of one block.
    blocks = F.when(F.col("size") > MEET, F.ceil(F.col("size") / (MEET // 2))).otherwise(1)
    met = met.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    pairs = F.filter(others, lambda p: (p["i"] < p["j"]) | (F.col("blocks") == 1))
    met = met.select("class", "group", "bucket", F.explode(pairs).alias("pair")).select("class", "group", F.xxhash64("bucket", "pair").alias("place"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            places = batch.column("place").to_numpy()
            cuts = [0, *(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), len(places)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start < stop:
                    if held and places[start] != last:
                        yield linked(held)
                        held = []
                    held.append(batch.slice(start, stop - start))
                    last = places[start]
        if held:
            yield linked(held)

    def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: rows.column(name).combine_chunks()
        classes, groups, lists = column("class"), column("group"), column("shingles")
        names = np.stack([groups.field(k).to_numpy() for k in (0, 1)], axis=1)
        _, group = np.unique(names, axis=0, return_inverse=True)
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        pairs = links_among(group.reshape(-1), sizes, lists.flatten().to_numpy(), threshold)
        ends = [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]
        columns = [values.take(end) for values in (classes, groups) for end in ends]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "group_a", "group_b"])

    rows = met.join(sets.select("class", "shingles"), "class").repartition("place").sortWithinPartitions("place")
    kind = ", ".join(f"{name} struct<a:bigint,b:bigint>" for name in ("a", "b", "group_a", "group_b"))
    return rows.select("class", "group", "shingles", "place").mapInArrow(compare, kind)


def linked_groups(members: DataFrame, sets: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """(class, group) of the classes of ``sets(class, shingles)``: components of ``links`` and of all similar pairs in a bucket of ``members(class, bucket)``."""
    found = connected_components(links).withColumnRenamed("node", "class")
    groups = sets.select("class").join(found, "class", "left").select("class", F.coalesce("component", "class").alias("group"))
    groups = written(groups, "groups")
    rest = written(links_in_buckets(members.join(groups, "class"), sets, threshold), "links")
    merged = connected_components(rest.select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))).withColumnRenamed("node", "group")
    return groups.join(merged, "group", "left").select("class", F.coalesce("component", "group").alias("group"))


def repeated_passages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, line, word, n_words, kept_doc_id, kept_line, kept_word) of the passages that occur earlier.

    A passage is a stretch of chosen windows that touch, each of which occurs at an
    earlier place, by doc_id and word; it is told by its first line and word and by those of the first
    place of its first window. Rows without an id or a text take no part; rows that repeat an id and a text are one document.
    """
    size = settings.least_words

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.slices(batches):
            owner, line, word, names = passages_of(texts, size, settings.surely)
            keys = part.column("doc_id").take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([keys, pa.array(line), pa.array(word), pa.array(names[0]), pa.array(names[1])], names=["doc_id", "line", "word", "a", "b"])

    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    cuts = written(known.mapInArrow(cut, "doc_id long, line long, word long, a long, b long"), "passages")
    place = F.struct("doc_id", "word", "line")
    # Half a name finds what may repeat; both halves decide.
    halves = cuts.groupBy("a").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("a")
    some = written(cuts.join(halves, "a", "left_semi"), "passages")
    kept = some.groupBy("a", "b").agg(F.min(place).alias("kept"))
    later = some.join(kept, ["a", "b"]).where(place != F.col("kept")).select("doc_id", "line", "word", "kept").distinct()
    # The rows of one document, which is one text, are ordered in one task.
    order = Window.partitionBy("doc_id").orderBy("word", "line")
    starts = F.coalesce(F.col("word") > F.lag("word").over(order) + size, F.lit(True))
    numbered = later.withColumn("starts", starts).withColumn("island", F.sum(F.col("starts").cast("int")).over(order))
    first = F.min(F.struct("word", "line", "kept")).alias("first")
    islands = numbered.groupBy("doc_id", "island").agg(first, (F.max("word") + size).alias("end"))
    return islands.select(
        "doc_id", "first.line", "first.word", (F.col("end") - F.col("first.word")).alias("n_words"), F.col("first.kept.doc_id").alias("kept_doc_id"),
        F.col("first.kept.line").alias("kept_line"), F.col("first.kept.word").alias("kept_word"),
    )


def repeated_paragraphs(docs: DataFrame, settings: Settings = Settings(), met: DataFrame | None = None) -> DataFrame:
    """(doc_id, line, n_words, kept_doc_id, kept_line) of every paragraph that repeats an earlier one.

    The first paragraph of a group, by doc_id and line, is kept and not returned.
    Lines are counted from 0. Rows without an id or a text take no part;
    paragraphs under ``least_words`` words are never removed. Rows that repeat an
    id and a text are one document. Other columns are ignored; an empty table gives
    an empty one. ``met(doc_id, bucket)`` are buckets of whole documents in which paragraphs meet beside
    those of their bands.
    """
    signed = written(signed_paragraphs(docs, settings), "paragraphs")
    place = F.struct("doc_id", "line")
    classes = written(signed.groupBy("class").agg(F.min(place).alias("first"), F.max(place).alias("last")), "classes")
    # Buckets know a class by half of its name; the other half comes back before anything is verified.
    spread = signed.select(F.col("class.a").alias("half"), F.explode("bands").alias("bucket"))
    if met is not None:
        spread = spread.union(signed.join(met, "doc_id").select(F.col("class.a").alias("half"), F.col("bucket")))
    shared = spread.groupBy("bucket").agg(F.min("half").alias("low"), F.max("half").alias("high"), F.count("*").alias("size"))
    halves = written(spread.join(shared.where("low <> high").select("bucket", "size"), "bucket").distinct(), "halves")
    # The hub of a bucket is the member whose buckets hold most: near copies of one text differ from each other, but little from it.
    central = halves.groupBy("half").agg(F.sum("size").alias("weight"))
    weighed = halves.join(central, "half")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "half")).alias("top")).select("bucket", F.col("top.half").alias("hub"))
    to_hubs = written(halves.join(hubs, "bucket").select("half", "hub").distinct(), "hubs")
    named = halves.select("half").distinct()
    named = classes.join(named, F.col("class.a") == F.col("half")).select("half", "class", F.col("first.doc_id").alias("doc_id"))
    named = written(named, "named")
    members = to_hubs.join(named.select("half", "class"), "half")
    members = members.join(named.select(F.col("half").alias("hub"), F.col("class").alias("hub_class")), "hub")
    stars = members.where("class <> hub_class").select(F.least("hub_class", "class").alias("a"), F.greatest("hub_class", "class").alias("b"))
    stars = written(stars.distinct(), "stars")
    sets = written(shingle_sets(docs, named.select("class", "doc_id"), settings), "shingles")
    links = written(verified(stars, sets, settings.threshold), "links")
    groups = linked_groups(halves.join(named.select("half", "class"), "half").select("class", "bucket"), sets, links, settings.threshold)
    named = classes.join(groups, "class", "left").where(F.col("group").isNotNull() | (F.col("first") != F.col("last")))
    named = written(named.select("class", F.coalesce("group", "class").alias("group"), "first"), "named")
    firsts = named.groupBy("group").agg(F.min("first").alias("kept"))
    kept = named.join(firsts, "group").select("class", "kept")
    out = signed.select("doc_id", "line", "n_words", "class").join(kept, "class").where(F.struct("doc_id", "line") != F.col("kept"))
    return out.select("doc_id", "line", "n_words", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line").alias("kept_line"))


def one_of_each(docs: DataFrame, settings: Settings = Settings(whole=True), met: DataFrame | None = None) -> DataFrame:
    """The row with the least doc_id of each group of similar texts, with all its columns as they are.

    Texts that share a bucket of ``met(doc_id, bucket)`` are compared beside those that share a band.
    Null and wordless texts are one group. Rows without an id are kept, since no
    order says which of them comes first. Rows that share the least id of a group
    all stay: they are one document.
    """
    blank = docs.where(F.col("doc_id").isNotNull() & ~F.coalesce(F.col("text").rlike(tx.WORD_PATTERN), F.lit(False))).select("doc_id")
    first = blank.agg(F.min("doc_id")).first()[0]
    later = repeated_paragraphs(docs, settings, met).where("doc_id <> kept_doc_id").select("doc_id")
    later = later.union(blank.where(F.col("doc_id") > F.lit(first).cast("long")))
    later = written(later.select(F.col("doc_id").alias("later_id")).distinct(), "later")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("later_id"))
    return rows.join(later, "later_id", "left_anti").select("row.*")


@query
def op4_paragraph_dedup(spark, sf_dir):
    """Every paragraph and every passage that repeats an earlier one; ``word`` is the first word of a passage and null for a whole line."""
    docs = table(spark, sf_dir, "documents")
    whole = repeated_paragraphs(docs).withColumns({"word": F.lit(None).cast("long"), "kept_word": F.lit(None).cast("long")})
    return whole.unionByName(repeated_passages(docs))

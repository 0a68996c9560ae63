"""Language-model scores of whole texts.

Word counts cover all training documents: tasks count, a shuffle adds up. The
most frequent words, a number fixed by a parameter, travel to the tasks; any
other word has at most a small share of all tokens, so the shuffle that brings it
to its count has no hot key. The recurrent model (``gru``) knows the first words
of that list; any other word is the unknown word times the word's share of what
the known words leave, so probabilities add up to one over all words.

Training is distributed: every task learns from its own documents, starting from
the same weights, and the weights are averaged by the words they have seen; each
round takes another part of the documents by a hash of their key, and the rounds
together take all of them.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm import gru
from patchlight.llm import texts as tx
from patchlight.llm.registry import query, table
from patchlight.session import written

#: The end of a text, as a word. No word has a line feed.
END = "\n"
UNKNOWN = 1


@dataclass(frozen=True)
class Settings:
    """Folds, words that travel to the tasks and their length, shares of the training documents in each round, shape.

    Each round has its number of streams: few in the short rounds, for many small steps, more in the long one.
    """

    folds: int = 10
    common: int = 1 << 18
    longest: int = 64
    rounds: tuple[float, ...] = (0.02, 0.08, 0.9)
    streams: tuple[int, ...] = (8, 16, 48)
    rate: float = 0.1
    pool_bytes: int = 16 << 20
    flush: int = 400_000
    shape: gru.Shape = gru.Shape()


def fold(doc_id: int | None, folds: int) -> int:
    """crc32 of the id as text, modulo the folds; 0 (held out) without an id."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def draw(doc_id: int) -> float:
    """A number in [0, 1) for the part of a document, independent of its fold."""
    return zlib.crc32(f"part:{doc_id}".encode()) / 2**32


def word_counts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, c) over the training documents, ends of texts included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for part, texts in tx.slices(batches):
            for key, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                if fold(key, settings.folds):
                    held.update(tx.lowered(text or b"").split())
                    held[END.encode()] += 1
            if len(held) > settings.flush:
                yield flushed()
                held.clear()
        yield flushed()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The most frequent words with their counts; numbers below ``shape.words`` are the model's."""

    words: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int
    known: int

    @property
    def whole(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)

    def base(self) -> np.ndarray:
        return np.log10((self.counts + 0.1) / self.whole)

    def rest(self) -> float:
        """Share that the model's own words leave to all others."""
        own = self.counts[: self.known].copy()
        own[UNKNOWN] = -0.1
        return max(1 - float((own + 0.1).sum()) / self.whole, 1e-300)


def lexicon(counts: DataFrame, settings: Settings = Settings()) -> Lexicon:
    """Numbers 0 and 1 are the end and the unknown word, then words by falling count."""
    sums = counts.agg(F.sum("c"), F.count("*")).first()
    top = counts.where((F.octet_length("word") <= settings.longest) & (F.col("word") != END)).orderBy(F.desc("c"), "word").limit(settings.common).toArrow()
    ends = counts.where(F.col("word") == END).first()
    words = {END.encode(): gru.END} | {w: k + 2 for k, w in enumerate(tx.encoded(top.column("word").combine_chunks()) if top.num_rows else [])}
    held = np.concatenate(([ends["c"] if ends else 0, 0], top.column("c").to_numpy() if top.num_rows else [])).astype(np.int64)
    return Lexicon(words, held, sums[0] or 0, sums[1], min(settings.shape.words, len(held)))


def first_weights(lex: Lexicon, shape: gru.Shape) -> gru.Weights:
    counts = np.zeros(shape.words)
    counts[: lex.known] = lex.counts[: lex.known]
    counts[UNKNOWN] = max(lex.total - counts.sum(), 1)
    return gru.start(shape, counts)


def pools(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes | None]]]:
    """Slices put together up to a number of bytes, so that long texts run beside many short ones."""
    parts, texts, held = [], [], 0
    for part, some in tx.slices(batches):
        bytes_here = sum(len(t or b"") for t in some)
        if parts and held + bytes_here > size:
            yield parts, texts
            parts, texts, held = [], [], 0
        parts.append(part)
        texts.extend(some)
        held += bytes_here
    if parts:
        yield parts, texts


_FOLDED = bytearray(tx.LOWER)
for _space in tx.SPACES:
    _FOLDED[_space] = 32
_FOLDED = bytes(_FOLDED)


def numbers(texts: list[bytes | None], words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of the words of all texts, -1 for a word that is not in the lexicon, and where each text stops, its end included.

    Then the words as places in the last, which has every distinct word once.
    """
    joined = b" \n ".join([*((text or b"").translate(_FOLDED) for text in texts), b""])
    found = pc.split_pattern(pa.array([joined], pa.large_binary()), b" ").values.dictionary_encode()
    distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
    known = np.fromiter(map(words.get, distinct, repeat(-1)), np.int64, len(distinct))
    at = found.indices.to_numpy()
    at = at[np.fromiter(map(len, distinct), np.int64, len(distinct))[at] > 0]
    ids = known[at]
    return ids, np.flatnonzero(ids == gru.END) + 1, at, distinct


def in_model(ids: np.ndarray, known: int) -> np.ndarray:
    return np.where((ids < 0) | (ids >= known), UNKNOWN, ids).astype(np.int32)


CHUNK = 2048


def trained(docs: DataFrame, lex: Lexicon, settings: Settings = Settings()) -> gru.Weights:
    """Rounds of learning in tasks and averaging; only the average of a round comes to the driver."""
    spark = docs.sparkSession
    weights = first_weights(lex, settings.shape)
    size = sum(v.size for v in weights.values())
    shared_words = spark.sparkContext.broadcast(lex)
    low = 0.0
    for k, share in enumerate(settings.rounds):
        streams = settings.streams[min(k, len(settings.streams) - 1)]
        high = low + share
        shared = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], low=low, high=high, shared=shared, streams=streams) -> Iterator[pa.RecordBatch]:
            lex, learner = shared_words.value, gru.Learner(shared.value, settings.rate)
            held: list[np.ndarray] = []
            for part, texts in tx.slices(batches):
                keys = part.column("doc_id").to_pylist()
                own = [text for key, text in zip(keys, texts, strict=True) if fold(key, settings.folds) and low <= draw(key) < high]
                if own:
                    ids, stops = numbers(own, lex.words)[:2]
                    held.extend(np.split(in_model(ids, lex.known), stops[:-1]))
                if sum(map(len, held)) > 1 << 17:
                    learner.learn(held, most=streams)
                    held = []
            learner.learn(held, most=streams)
            values = np.append(gru.packed(learner.w).astype(float) * learner.seen, learner.seen)
            for at in range(0, len(values) if learner.seen else 0, CHUNK):
                row = pa.array([values[at : at + CHUNK].tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), row], names=["i", "row"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, row in zip(batch.column("i").to_pylist(), batch.column("row"), strict=True):
                    sums[i] = sums.get(i, 0) + row.values.to_numpy()
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["i", "row"]
                )

        kind = "i int, row array<double>"
        parts = docs.select("doc_id", "text").mapInArrow(learn, kind)
        rows = {r["i"]: r["row"] for r in parts.repartition(8, "i").mapInArrow(add, kind).collect()}
        if rows:
            values = np.concatenate([np.array(rows[i]) for i in sorted(rows)])
            weights = gru.unpacked(values[:size] / values[size], weights)
        low = high
    return weights


PARTS = (
    "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, words array<string>, times array<int>"
)


def partial_scores(docs: DataFrame, lex: Lexicon, weights: gru.Weights, settings: Settings) -> DataFrame:
    """What a task can tell of each text by itself, and its words that are not in the lexicon with how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast((lex, weights))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, weights = shared.value
        base, known = lex.base(), lex.known
        log_rest = math.log10(lex.rest())
        row = TaskContext.get().partitionId() << 33
        for parts, texts in pools(batches, settings.pool_bytes):
            keys = [k for p in parts for k in p.column("doc_id").to_pylist()]
            columns: dict[str, list] = {c.split()[0]: [] for c in PARTS.split(", ")}
            every, stops, places, distinct = numbers(texts, lex.words)
            sequences = np.split(in_model(every, known), stops[:-1])
            for key, ids, at in zip(keys, np.split(every, stops[:-1]), np.split(places, stops[:-1]), strict=True):
                listed = ids[ids >= 0]
                other = Counter([distinct[k] for k in at[ids < 0].tolist()])
                terms = base[listed]
                outside = listed >= known
                columns["row"].append(row)
                columns["doc_id"].append(key)
                columns["held_out"].append(fold(key, settings.folds) == 0)
                columns["n_tokens"].append(len(ids))
                columns["known"].append(int((lex.counts[listed] > 0).sum()))
                columns["base"].append(float(terms.sum()))
                columns["model"].append(float(terms[outside].sum()) - (int(outside.sum()) + len(ids) - len(listed)) * log_rest)
                columns["words"].append([w.decode("utf-8", "replace") for w in other])
                columns["times"].append(list(other.values()))
                row += 1
            scores = gru.score(weights, sequences) / math.log(10)
            columns["model"] = (np.array(columns["model"]) + scores).tolist()
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)], names=list(columns))

    return docs.select("doc_id", "text").mapInArrow(rows, PARTS)


def scored(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null texts are empty: one token, the end. Rows without an id are held out.
    Without training rows every token has the same base score and the model is
    that of its first weights. Repeated rows are scored each; other columns are
    ignored; an empty table gives an empty one.
    """
    counts = written(word_counts(docs, settings), "words")
    lex = lexicon(counts, settings)
    weights = trained(docs, lex, settings)
    parts = written(partial_scores(docs, lex, weights, settings), "scores")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("z")).select("row", F.col("z.words").alias("word"), F.col("z.times").alias("n"))
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10((c + 0.1) / F.lit(lex.whole))).alias("rare"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known")
    )
    extra = F.coalesce("rare", F.lit(0.0))
    return parts.drop("words", "times").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("model") + extra).alias("score"),
    )


@query
def op6_lm_score(spark, sf_dir):
    """Base and model score of every document."""
    return scored(table(spark, sf_dir, "documents"))

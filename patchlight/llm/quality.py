"""Quality rules: counts over whole texts, and two hashed n-gram logistic regressions.

Features are hashed words, pairs of words, starts of words and byte n-grams. A text is cut into
windows of a fixed number of words, all of which are scored; its quality is the
mean over the windows, since junk fills a text, and its toxicity the maximum,
since one sentence is enough. Both scores are turned into probabilities on held
out labelled rows and held against fixed thresholds.

Fitting takes a bounded sample of the labelled rows (``Fit.rows`` of them, of at
most ``Fit.longest`` words, chosen by a hash of the key). Scoring covers every
text in Arrow batches; nothing is shuffled but the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm import texts as tx
from patchlight.llm.registry import query, table

FEATURE_BITS = 18
WINDOW = 48
SYMBOLS = b"#*$%&|<>"
SHORTEST = 20
REPEATED_PERCENT = 30
GRAM = 8
BLOCK_WINDOWS = 1 << 12

_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
#: Bytes at the start of a word that are a feature; shorter words count whole.
STEMS = (4, 5, 6, 7, 8)

_FAMILIES = tx.mixed(np.arange(1, 10, dtype=np.uint64))


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the fit: sampled rows, longest sampled text in words (and 40 bytes for each), steps, least documents and z
    of a feature, features kept (those with the highest z)."""

    rows: int = 3000
    longest: int = 3000
    steps: int = 120
    least_docs: int = 4
    least_z: float = 3.3
    most_features: int = 1024
    rate: float = 0.3
    shrink: float = 1e-4
    held_out: int = 4


@dataclass(frozen=True)
class Judge:
    """Weights of one regression with its slope and offset to a log odds; ``pool`` joins the windows of a text."""

    weights: np.ndarray
    bias: float
    pool: str
    slope: float = 1.0
    offset: float = 0.0

    def pooled(self, windows: np.ndarray, text_of: np.ndarray, count: int) -> np.ndarray:
        return pool(windows, text_of, count, self.pool)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * pooled + self.offset, -40, 40)))


def pool(values: np.ndarray, text_of: np.ndarray, count: int, how: str) -> np.ndarray:
    """Mean or maximum of the windows of each text; 0 for a text without windows."""
    n = np.bincount(text_of, minlength=count)
    if how == "mean":
        return np.bincount(text_of, values, count) / np.maximum(n, 1)
    out = np.full(count, -np.inf)
    np.maximum.at(out, text_of, values)
    return np.where(n > 0, out, 0.0)


def hashed(values: np.ndarray, family: int) -> np.ndarray:
    spread = (values ^ _FAMILIES[family]) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


def byte_grams(buffer: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place as one number; the last places take what is left."""
    wide = np.concatenate((buffer, np.zeros(n - 1, np.uint8))).astype(np.uint64)
    out = wide[: len(buffer)].copy()
    for k in range(1, n):
        out |= wide[k : len(buffer) + k] << np.uint64(8 * k)
    return out


@dataclass
class Windows:
    """The windows of a slice: text of each, and its features as runs of word places and of bytes."""

    text_of: np.ndarray
    word_at: np.ndarray
    byte_at: np.ndarray
    words: list[np.ndarray]
    bytes: list[np.ndarray]

    def score(self, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.text_of))
        for runs, at in ((self.words, self.word_at), (self.bytes, self.byte_at)):
            for run in runs:
                total += np.add.reduceat(weights[run], at) if len(at) else 0.0
        return total

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, feature) of every feature."""
        rows, found = [], []
        for runs, at in ((self.words, self.word_at), (self.bytes, self.byte_at)):
            for run in runs:
                sizes = np.diff(np.append(at, len(run)))
                rows.append(np.repeat(np.arange(len(at)), sizes))
                found.append(run)
        return np.concatenate(rows), np.concatenate(found)


def windows_of(texts: list[bytes | None], size: int = WINDOW) -> Windows:
    raw, low = tx.Pages(texts), tx.Pages(texts, lower=True)
    starts, ends, text_of = low.words()
    if not len(starts):
        none = np.empty(0, np.int64)
        return Windows(none, none, none, [], [])
    sums = low.prefix_sums()
    words = sums.spans(starts, ends)
    first = np.flatnonzero(np.diff(text_of, prepend=-1))
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    at = np.flatnonzero(place % size == 0)
    pairs = words * np.uint64(3) + np.where(np.append(np.diff(text_of), 1) == 0, np.roll(words, -1), np.uint64(0))
    stems = [hashed(sums.spans(starts, np.minimum(starts + size, ends)), 4 + k) for k, size in enumerate(STEMS)]
    return Windows(
        text_of[at], at, starts[at],
        [hashed(words, 0), hashed(tx.mixed(pairs), 1), *stems],
        [hashed(byte_grams(raw.buffer, 3), 2), hashed(byte_grams(low.buffer, 5), 3)],
    )


def counts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The counts of the base rules over whole texts; a null text counts as one without words."""
    pages = tx.Pages(texts)
    n, buffer = pages.count, pages.buffer
    sums = pages.prefix_sums()
    starts, ends, text_of = pages.words()
    points = np.concatenate(([0], np.cumsum((buffer & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[buffer])))
    out = {
        "n_words": np.bincount(text_of, minlength=n),
        "word_chars": np.bincount(text_of, points[ends] - points[starts], n).astype(np.int64),
        "n_symbols": symbols[pages.ends] - symbols[pages.starts],
    }
    breaks = np.flatnonzero(buffer == 10)
    line_starts = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else breaks
    worded = np.searchsorted(starts, breaks, "left") > np.searchsorted(starts, line_starts, "left")
    line_starts, breaks = line_starts[worded], breaks[worded]
    line_text = np.searchsorted(pages.ends, breaks, "left")
    key = tx.mixed(sums.spans(line_starts, breaks) + line_text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    _, seen_at = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(line_text, minlength=n) - np.bincount(line_text[seen_at], minlength=n)
    grams, at = tx.word_grams(sums.spans(starts, ends), text_of, GRAM)
    key = tx.mixed(grams + text_of[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + GRAM, -1)
    out["n_repeat_words"] = np.bincount(text_of, np.cumsum(change)[:-1] > 0, n).astype(np.int64)
    return out


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < SHORTEST) | (100 * found["n_repeat_words"] > REPEATED_PERCENT * found["n_words"])


@dataclass
class Sample:
    """Labelled texts as windows with the features that tell the labels apart; ``feature`` holds places in ``names``, by rising window."""

    count: int
    labels: np.ndarray
    learn: np.ndarray
    text_of: np.ndarray
    window: np.ndarray
    feature: np.ndarray
    names: np.ndarray


def chunks(texts: list[bytes | None], size: int = 50, most_bytes: int = 1 << 18) -> Iterator[tuple[int, Windows]]:
    """Windows of at most ``size`` texts and ``most_bytes`` bytes, or one text, with the number of the first."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        if at > start and (at - start == size or held + len(text or b"") > most_bytes):
            yield start, windows_of(texts[start:at])
            start, held = at, 0
        held += len(text or b"")
    if start < len(texts):
        yield start, windows_of(texts[start:])


def samples(texts: list[bytes | None], labels: dict[str, np.ndarray], one_sided: set[str], fit: Fit) -> dict[str, Sample]:
    """For each labelling, the features that occur in enough learnt texts and in clearly different shares of the two labels.

    A one-sided labelling takes only features that speak for label 1, so that a
    maximum over windows is evidence found and not evidence against missing. Texts
    are featured twice, some at a time, so only telling features are ever held.
    """
    learn = np.arange(len(texts)) % fit.held_out != 0
    size = 1 << FEATURE_BITS
    seen = {name: np.zeros((2, size), np.int64) for name in labels}
    for start, spans in chunks(texts):
        window, feature = spans.features()
        pairs = np.unique((spans.text_of[window] + start) << FEATURE_BITS | feature)
        text, name_of = pairs >> FEATURE_BITS, pairs & (size - 1)
        for name, values in labels.items():
            for label in (0, 1):
                seen[name][label] += np.bincount(name_of[learn[text] & (values[text] == label)], minlength=size)
    held = {}
    for name, values in labels.items():
        n = [max(int((learn & (values == label)).sum()), 1) for label in (0, 1)]
        share = (seen[name].sum(0) + 1) / (sum(n) + 2)
        z = (seen[name][1] / n[1] - seen[name][0] / n[0]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
        z = np.where(seen[name].sum(0) >= fit.least_docs, z if name in one_sided else np.abs(z), 0.0)
        held[name] = z >= max(fit.least_z, np.sort(z)[-fit.most_features])
    names = {name: np.flatnonzero(some) for name, some in held.items()}
    place = {name: (np.cumsum(some) - 1).astype(np.min_scalar_type(max(len(names[name]) - 1, 0))) for name, some in held.items()}
    parts = {name: [] for name in labels}
    text_of, windows = [], 0
    for start, spans in chunks(texts):
        window, feature = spans.features()
        for name in labels:
            keep = held[name][feature]
            mine, found = window[keep], place[name][feature[keep]]
            # Chunks come in order of their windows, so each is sorted by itself.
            order = np.argsort(mine, kind="stable")
            parts[name].append(((mine[order] + windows).astype(np.int32), found[order]))
        text_of.append(spans.text_of + start)
        windows += len(spans.text_of)
    text_of = np.concatenate([*text_of, np.empty(0, np.int64)]).astype(np.int64)
    out = {}
    for name, values in labels.items():
        mine = parts.pop(name)
        window = np.concatenate([np.empty(0, np.int32), *(w for w, _ in mine)])
        feature = np.concatenate([np.empty(0, place[name].dtype), *(f for _, f in mine)])
        out[name] = Sample(len(texts), values, learn, text_of, window, feature, names[name])
    return out


def fit_judge(sample: Sample, how: str, fit: Fit) -> Judge | None:
    """Fit one regression; None unless both labels occur.

    With pool "max" the positive texts are known to hold one positive window at
    least: after some steps only the best window of each counts as positive.
    """
    labels, text_of, window, count = sample.labels, sample.text_of, sample.window, sample.count
    if len(set(labels.tolist())) < 2:
        return None
    names, feature = sample.names, sample.feature
    target = labels[text_of].astype(float)
    learn = sample.learn[text_of]
    bounds = np.searchsorted(window, np.arange(len(text_of) + 1).astype(window.dtype))
    # Steps work on some windows at a time, so nothing as long as all features is made beside them.
    blocks = [(at, min(at + BLOCK_WINDOWS, len(text_of))) for at in range(0, len(text_of), BLOCK_WINDOWS)]

    def logits(weights: np.ndarray, bias: float) -> np.ndarray:
        out = np.zeros(len(text_of))
        for a, b in blocks:
            values = np.append(weights[feature[bounds[a] : bounds[b]]], 0.0)
            at = bounds[a:b] - bounds[a]
            out[a:b] = np.where(bounds[a:b] == bounds[a + 1 : b + 1], 0.0, np.add.reduceat(values, at))
        return out + bias

    def slopes(gap: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names))
        for a, b in blocks:
            here = slice(bounds[a], bounds[b])
            out += np.bincount(feature[here], gap[window[here]], len(names))
        return out

    weights, bias = np.zeros(len(names)), 0.0
    squares, bias_square = np.full(len(names), 1e-6), 1e-6
    for step in range(fit.steps):
        z = logits(weights, bias)
        used = learn.copy()
        if how == "max" and step >= fit.steps // 4:
            best = pool(z, text_of, count, "max")
            used &= (target == 0) | (z >= best[text_of])
        gap = np.where(used, 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target, 0.0)
        # Every text weighs the same in a mean, and both labels weigh the same.
        share = 1 / np.maximum(np.bincount(text_of, used, count), 1)[text_of] if how == "mean" else np.ones(len(text_of))
        for label in (0.0, 1.0):
            mine = target == label
            gap[mine] *= share[mine] / max((share * used)[mine].sum(), 1e-9)
        slope = slopes(gap) + fit.shrink * weights
        squares += slope**2
        weights -= fit.rate * slope / np.sqrt(squares)
        if how == "max":
            weights = np.maximum(weights, 0.0)
        bias_square += gap.sum() ** 2
        bias -= fit.rate * gap.sum() / np.sqrt(bias_square)
    z = pool(logits(weights, bias), text_of, count, how)
    some = ~sample.learn & (np.bincount(text_of, minlength=count) > 0)
    if len(set(labels[some].tolist())) < 2:
        some = np.bincount(text_of, minlength=count) > 0
    slope, offset = calibrated(z[some], labels[some])
    wide = np.zeros(1 << FEATURE_BITS, np.float32)
    wide[names] = weights
    return Judge(wide, bias, how, slope, offset)


def calibrated(z: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the log odds, by Newton steps on smoothed targets (Platt)."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    scale = max(float(np.abs(z).max()), 1e-9)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.linalg.solve(h, x.T @ (p - target) + 1e-3 * w)
    return float(w[0] / scale), float(w[1])


def fit_judges(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> dict[str, Judge | None]:
    """Judges of quality and toxicity from a bounded sample of the labelled rows; rows with a null label or text are left out."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # At most fit.rows rows, whatever the tables hold.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.rows)
    # Words may be of any length, so the sampled texts are bounded in bytes as well.
    short = (F.octet_length("text") <= 40 * fit.longest) & (F.regexp_count("text", F.lit(tx.WORD_PATTERN)) <= fit.longest)
    rows = docs.select("doc_id", "text").where(short)
    rows = rows.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(fit.rows).toArrow()
    texts = tx.encoded(rows.column("text").combine_chunks()) if rows.num_rows else []
    quality, toxic = (rows.column(c).to_numpy() for c in ("quality", "toxic"))
    del rows
    found = samples(texts, {"good": (quality == 1).astype(np.int64), "toxic": (toxic == 1).astype(np.int64)}, {"toxic"}, fit)
    return {"good": fit_judge(found["good"], "mean", fit), "toxic": fit_judge(found["toxic"], "max", fit)}


@dataclass(frozen=True)
class Rules:
    """Fixed thresholds on the probabilities."""

    least_good: float = 0.5
    most_toxic: float = 0.4


def verdicts(texts: list[bytes | None], judges: dict[str, Judge | None], rules: Rules) -> dict[str, np.ndarray]:
    out = counts(texts)
    out["base_failed"] = base_failed(out)
    kept = ~out["base_failed"]
    spans = windows_of(texts)
    for name, judge in judges.items():
        if judge is None:
            p = np.full(len(texts), np.nan)
        else:
            p = judge.probability(judge.pooled(spans.score(judge.weights) + judge.bias, spans.text_of, len(texts)))
            kept &= p >= rules.least_good if name == "good" else p < rules.most_toxic
        out[f"{name}_probability"] = p
    out["kept"] = kept
    return out


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, good_probability double, toxic_probability double"


def judged(docs: DataFrame, judges: dict[str, Judge | None], rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base counts, ``base_failed``, ``kept`` and both probabilities of every row.

    Null and empty texts have no words, so they fail the base rules. Without a
    judge (no or one-sided labels) its probability is null and only the other
    rules count. Repeated rows are judged alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(judges)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.slices(batches):
            out = verdicts(texts, shared.value, rules)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(out[c], from_pandas=True) for c in names)], names=["doc_id", *names]
            )

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id long, {COLUMNS}")


def kept_documents(docs: DataFrame, judges: dict[str, Judge | None], rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they are.

    Null, empty and blank texts fail the base rules and go; repeated rows and null
    ids are judged like any other; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(judges)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.slices(batches):
            yield part.filter(pa.array(verdicts(texts, shared.value, rules)["kept"]))

    return docs.mapInArrow(rows, docs.schema)


@query
def op8_quality_rules(spark, sf_dir):
    """Counts, base rules and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit_judges(docs, table(spark, sf_dir, "labels")))

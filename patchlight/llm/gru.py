"""A gated recurrent language model in NumPy with a class-factored softmax.

Words are numbers below ``classes * per_class``; a word's class is its number
divided by ``per_class``, so frequent words share classes. The probability of a
word is that of its class times that of the word in its class.

Texts are laid out in parallel streams and read in windows of ``steps`` words.
The state goes on from window to window within a text and starts at zero with
each text (in learning, with each long piece of one); gradients stop at the
border of a window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

END = 0


@dataclass(frozen=True)
class Shape:
    classes: int = 32
    per_class: int = 32
    embed: int = 16
    hidden: int = 24

    @property
    def words(self) -> int:
        return self.classes * self.per_class


Weights = dict[str, np.ndarray]


def start(shape: Shape, counts: np.ndarray, seed: int = 5) -> Weights:
    """Seeded weights whose output without any context is the share of each word."""
    rng = np.random.default_rng(seed)
    normal = lambda *size: (rng.standard_normal(size) / np.sqrt(size[0])).astype(np.float32)
    h, c, s = shape.hidden, shape.classes, shape.per_class
    share = (np.asarray(counts, float) + 0.5).reshape(c, s)
    return {
        "embed": (0.5 * rng.standard_normal((shape.words, shape.embed))).astype(np.float32),
        "inputs": normal(shape.embed, 3 * h),
        "bias": np.zeros(3 * h, np.float32),
        "state": normal(h, 3 * h),
        "class": np.zeros((h, c), np.float32),
        "class_bias": np.log(share.sum(1) / share.sum()).astype(np.float32),
        "word": np.zeros((c, h, s), np.float32),
        "word_bias": np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
    }


@dataclass
class Streams:
    """Words by (place, stream), -1 where a stream has ended; ``text`` tells whose they are, ``first`` where texts begin."""

    words: np.ndarray
    text: np.ndarray
    first: np.ndarray


def streams_of(texts: list[np.ndarray], most: int) -> Streams:
    """Deal texts to streams, longest first to the shortest stream; as many streams as keep the longest text from setting the length.

    Each stream has its texts in the order given, so that learning does not go from long texts to short ones.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.sum():
        none = np.empty((0, 1), np.int32)
        return Streams(none, none, none.astype(bool))
    count = int(max(1, min(most, len(texts), sizes.sum() // sizes.max())))
    heap = [(0, k) for k in range(count)]
    stream = np.zeros(len(texts), np.int64)
    for text in np.argsort(-sizes, kind="stable").tolist():
        at, k = heapq.heappop(heap)
        stream[text] = k
        heapq.heappush(heap, (at + int(sizes[text]), k))
    length = max(at for at, _ in heap)
    ends = [0] * count
    words = np.full((length, count), -1, np.int32)
    owner = np.zeros((length, count), np.int32)
    first = np.zeros((length, count), bool)
    for text, k in enumerate(stream.tolist()):
        at = ends[k]
        ends[k] = stop = at + int(sizes[text])
        words[at:stop, k] = texts[text]
        owner[at:stop, k] = text
        if stop > at:
            first[at, k] = True
    return Streams(words, owner, first)


def windows(streams: Streams, steps: int, leads: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray]]:
    """Each window and the words before its words; END comes before a text, or its lead."""
    before = np.full_like(streams.words, END)
    before[1:] = np.where(streams.words[:-1] >= 0, streams.words[:-1], END)
    before[streams.first] = END if leads is None else leads[streams.text[streams.first]]
    for at in range(0, len(streams.words), steps):
        yield slice(at, at + steps), before[at : at + steps]


def forward(w: Weights, table: np.ndarray, previous: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States after every step, then the gates r, z and n and what the state before adds to them, each gate by itself.

    A sigmoid of x is 0.5 tanh(0.5 x) + 0.5; the halves of x go into the table and the weights.
    """
    (steps, count), size, kind = previous.shape, h.shape[1], h.dtype
    state = w["state"].reshape(size, 3, size).transpose(1, 0, 2).copy()
    state[:2] *= 0.5
    gates = np.empty((3, steps, count, size), kind)
    for gate, column in zip(gates, table.reshape(-1, 3, size).transpose(1, 0, 2), strict=True):
        np.take(np.ascontiguousarray(column), previous, axis=0, out=gate, mode="clip")
    gates[:2] *= 0.5
    added, states, product = np.empty_like(gates), np.empty((steps, count, size), kind), np.empty((count, size), kind)
    begins = first.any(1).tolist()
    for t in range(steps):
        if begins[t]:
            h = h.copy()
            h[first[t]] = 0
        u, rz, n, out = added[:, t], gates[:2, t], gates[2, t], states[t]
        np.matmul(h, state, out=u)
        rz += u[:2]
        np.tanh(rz, out=rz)
        rz *= 0.5
        rz += 0.5
        np.multiply(rz[0], u[2], out=product)
        n += product
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= rz[1]
        out += n
        h = out
    return states, gates, added


def table_of(w: Weights, words: np.ndarray | slice = slice(None)) -> np.ndarray:
    """What every word adds to the gates."""
    return w["embed"][words] @ w["inputs"] + w["bias"]


def by_class(words: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words but -1 in order of their classes, and how many each class has."""
    kind = np.where(words < 0, shape[0], words // shape[2])
    counts = np.bincount(kind, minlength=shape[0])[: shape[0]]
    return np.argsort(kind.astype(np.int16), kind="stable")[: counts.sum()], counts


def spans(counts: np.ndarray) -> list[tuple[int, int, int]]:
    """Each class that occurs with the bounds of its rows."""
    ends = np.cumsum(counts)
    return [(c, int(ends[c] - counts[c]), int(ends[c])) for c in np.flatnonzero(counts).tolist()]


def _class_logits(w: Weights, h: np.ndarray) -> np.ndarray:
    """(class, row)."""
    return w["class"].T @ h.T + w["class_bias"][:, None]


def _word_logits(w: Weights, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(word of the row's class, row) for rows in order of class."""
    logits = np.empty((w["word"].shape[2], len(h)), h.dtype)
    for c, low, high in spans(counts):
        np.matmul(w["word"][c].T, h[low:high].T, out=logits[:, low:high])
    logits += np.repeat(w["word_bias"].T, counts, axis=1)
    return logits


def _exponents(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column, in place, the exponents of its values less the greatest; their sums and the greatest values."""
    most = logits.max(0)
    logits -= most
    np.exp(logits, out=logits)
    return logits.sum(0), most


def score(w: Weights, texts: list[np.ndarray], steps: int = 32, most: int = 256) -> np.ndarray:
    """Natural log probability of every text."""
    streams = streams_of(texts, most)
    out = np.zeros(len(texts))
    table = table_of(w)
    shape = w["word"].shape
    h = np.zeros((streams.words.shape[1], shape[1]), w["state"].dtype)
    for at, previous in windows(streams, steps):
        states = forward(w, table, previous, streams.first[at], h)[0]
        h = states[-1]
        words = streams.words[at].reshape(-1)
        order, counts = by_class(words, shape)
        flat, words = states.reshape(-1, shape[1]).take(order, 0), words.take(order)
        total = np.zeros(len(order))
        for logits, column in ((_class_logits(w, flat), words // shape[2]), (_word_logits(w, flat, counts), words % shape[2])):
            total += logits[column, np.arange(len(order))]
            sums, top = _exponents(logits)
            total -= top + np.log(sums)
        out += np.bincount(streams.text[at].reshape(-1).take(order), total, len(texts))
    return out


class Learner:
    """Truncated backpropagation through time with scaled steps (Adagrad)."""

    def __init__(self, weights: Weights, rate: float = 0.1):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.squares = {k: np.full_like(v, 1e-4) for k, v in weights.items()}
        self.rate = rate
        self.seen = 0

    def learn(self, texts: list[np.ndarray], steps: int = 16, most: int = 64, piece: int = 2048) -> None:
        """Learn every word; a long text goes to the streams in pieces, or few streams would run as long as it does.

        A piece knows the word before it; its state starts at zero.
        """
        pieces = [text[at : at + piece] for text in texts for at in range(0, len(text), piece)]
        leads = np.array([text[at - 1] if at else END for text in texts for at in range(0, len(text), piece)], np.int32)
        streams = streams_of(pieces, most)
        h = np.zeros((streams.words.shape[1], self.w["state"].shape[0]), self.w["state"].dtype)
        for at, previous in windows(streams, steps, leads):
            h = self._window(streams.words[at], previous, streams.first[at], h)

    def _window(self, targets: np.ndarray, previous: np.ndarray, first: np.ndarray, h: np.ndarray) -> np.ndarray:
        w, size = self.w, h.shape[1]
        place = np.zeros(len(w["embed"]), np.int64)
        place[previous] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(len(used))
        inverse = place.take(previous)
        states, gates, added = forward(w, table_of(w, used), inverse, first, h)
        words = targets.reshape(-1)
        order, counts = by_class(words, w["word"].shape)
        grads, gap = self._outputs(words.take(order), states.reshape(-1, size).take(order, 0), counts)
        out_gap = np.zeros_like(states)
        out_gap.reshape(-1, size)[order] = gap
        before = np.concatenate((h[None], states[:-1]))
        before[first] = 0
        given = self._through_time(before, first, gates, added, out_gap, grads)
        inverse = inverse.reshape(-1)
        order = np.argsort(inverse.astype(np.int32), kind="stable")
        counts = np.bincount(inverse, minlength=len(used))
        by_word = np.concatenate([np.add.reduceat(g.take(order, 0), np.cumsum(counts) - counts) for g in given], 1)
        grads["inputs"] = w["embed"][used].T @ by_word
        grads["bias"] = by_word.sum(0)
        grads["embed"] = by_word @ w["inputs"].T
        self._step(grads, used)
        return states[-1]

    def _outputs(self, words: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> tuple[Weights, np.ndarray]:
        """Gradients of the output weights and of the states, from the probabilities less those of the words themselves."""
        w, rows, per_class = self.w, np.arange(len(words)), self.w["word"].shape[2]
        self.seen += len(words)
        scale = flat.dtype.type(1 / max(len(words), 1))

        def gaps(logits: np.ndarray, column: np.ndarray) -> np.ndarray:
            logits *= scale / _exponents(logits)[0]
            logits[column, rows] -= scale
            return logits

        gap = gaps(_class_logits(w, flat), words // per_class)
        grads = {"class": flat.T @ gap.T, "class_bias": gap.sum(1), "word": np.zeros_like(w["word"]), "word_bias": np.zeros_like(w["word_bias"])}
        back, of_words = gap.T @ w["class"].T, np.empty_like(flat)
        gap, held = gaps(_word_logits(w, flat, counts), words % per_class), spans(counts)
        for c, low, high in held:
            some = gap[:, low:high].T
            np.matmul(flat[low:high].T, some, out=grads["word"][c])
            np.matmul(some, w["word"][c].T, out=of_words[low:high])
        if held:
            grads["word_bias"][[c for c, _, _ in held]] = np.add.reduceat(gap, [low for _, low, _ in held], axis=1).T
        back += of_words
        return grads, back

    def _through_time(
        self, before: np.ndarray, first: np.ndarray, gates: np.ndarray, added: np.ndarray, out_gap: np.ndarray, grads: Weights
    ) -> np.ndarray:
        """Gradients of what goes into the gates; adds that of the state's weights to ``grads``."""
        size, (r, z, n) = before.shape[2], gates
        back = self.w["state"].reshape(size, 3, size).transpose(1, 2, 0).copy()
        # What a change of the state changes in n before its tanh, and in what the state adds to r, z and n.
        inner = (1 - z) * (1 - n * n)
        shares = np.empty_like(gates)
        np.multiply(inner, r, out=shares[2])
        np.multiply((before - n) * z, 1 - z, out=shares[1])
        np.multiply(shares[2] * added[2], 1 - r, out=shares[0])
        carried, parts = np.zeros_like(before[0]), np.empty_like(gates[:, 0])
        begins = first.any(1).tolist()
        for t in range(len(before) - 1, -1, -1):
            dh, share = out_gap[t], shares[:, t]
            dh += carried
            share *= dh
            np.matmul(share, back, out=parts)
            np.multiply(dh, z[t], out=carried)
            carried += parts[0]
            carried += parts[1]
            carried += parts[2]
            if begins[t]:
                carried[first[t]] = 0
        flat = shares.reshape(3, -1, size)
        grads["state"] = np.concatenate([before.reshape(-1, size).T @ g for g in flat], 1)
        np.multiply(out_gap, inner, out=shares[2])
        return flat

    def _step(self, grads: Weights, used: np.ndarray) -> None:
        """A clipped step; of the embeddings only the rows in use have gradients."""
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        clip = min(1.0, 1.0 / max(norm, 1e-12))
        for k, g in grads.items():
            g *= g.dtype.type(clip)
            rows = used if k == "embed" else slice(None)
            squares = self.squares[k][rows]
            squares += g * g
            g *= g.dtype.type(self.rate)
            g /= np.sqrt(squares)
            if k == "embed":
                self.squares[k][rows] = squares
            self.w[k][rows] -= g


def packed(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in sorted(w)])


def unpacked(values: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out

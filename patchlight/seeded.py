"""Seeded random numbers from integer arithmetic.

The same draw comes out of NumPy (inside tasks) and of a Spark column, on any
number of partitions, because it depends only on (row, position, seed, stream).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the generator.
MODULUS = 1000003
START = {"row": 7919, "position": 104729, "seed": 15485863, "stream": 32452843, "shift": 13}
ROUND = {"square": 48271, "linear": 69621, "round": 40692, "row": 31, "position": 17}
ROUNDS = 3
ORDER_PLACE = 86028121

# Streams: 1 and 2 make a normal draw, 3 a phase, the others serve one purpose each.
NORMAL_A, NORMAL_B, PHASE, ORDER_HIGH, ORDER_LOW, SIGN, CHI_A, CHI_B, PERMUTE, PICK_LEFT, PICK_RIGHT = range(1, 12)


def first_draw(row, position, seed: int, stream: int):
    shift = seed * START["seed"] + stream * START["stream"] + START["shift"]
    return (row * START["row"] + position * START["position"] + shift) % MODULUS


def next_draw(t, row, position, r):
    square = ((t * t) % MODULUS) * ROUND["square"]
    place = row * ROUND["row"] + position * ROUND["position"]
    return (square + t * ROUND["linear"] + (r + 1) * ROUND["round"] + place) % MODULUS


def mixed(row: np.ndarray, position: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """Integer draws in [0, MODULUS) for int64 arrays."""
    t = first_draw(row, position, seed, stream)
    for r in range(ROUNDS):
        t = next_draw(t, row, position, r)
    return t


def mixed_column(row: Column, position: Column, seed: int, stream: int) -> Column:
    """The same draws as a column.

    The rounds fold over an array, so the expression names its inputs a fixed
    number of times however often a filter or projection copies it.
    """
    row, position = row.cast("bigint"), position.cast("bigint")
    return F.aggregate(
        F.lit(list(range(ROUNDS))),
        first_draw(row, position, seed, stream),
        lambda t, r: next_draw(t, row, position, r.cast("bigint")),
    )


def unit(draw):
    """Map an integer draw to the open interval (0, 1)."""
    return (draw + 0.5) / MODULUS


def remainder(x: np.ndarray) -> np.ndarray:
    """x modulo MODULUS in place, for whole numbers in doubles far below 2^53: exact, and several times faster than on integers."""
    x -= np.floor(x / MODULUS) * MODULUS
    return x


def fast_mixed(row: np.ndarray, position: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """The draws of ``mixed`` as doubles, for rows and positions below 2^32."""
    shift = float(seed * START["seed"] + stream * START["stream"] + START["shift"])
    place = row * float(ROUND["row"]) + position * float(ROUND["position"])
    t = remainder(row * float(START["row"]) + (position * float(START["position"]) + shift))
    for r in range(ROUNDS):
        square = remainder(t * t)
        square *= ROUND["square"]
        t *= ROUND["linear"]
        square += t
        square += place
        square += (r + 1) * ROUND["round"]
        t = remainder(square)
    return t


#: Values that are drawn at a time, so that they stay in cache.
DRAWN_TOGETHER = 1 << 14


def filled(rows: int, columns: int, first: int, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A matrix whose cell (i, j) is ``value`` of row first + i and column j."""
    out = np.empty((rows, columns))
    position = np.arange(columns, dtype=float)[None, :]
    step = max(1, DRAWN_TOGETHER // max(1, columns))
    for start in range(0, rows, step):
        stop = min(start + step, rows)
        out[start:stop] = value(np.arange(first + start, first + stop, dtype=float)[:, None], position)
    return out


def normals(rows: int, columns: int, seed: int, streams: tuple[int, int] = (NORMAL_A, NORMAL_B), first: int = 0) -> np.ndarray:
    """Matrix of standard normal draws: the rows from ``first`` on."""

    def value(f: np.ndarray, px: np.ndarray) -> np.ndarray:
        u, v = (unit(fast_mixed(f, px, seed, stream)) for stream in streams)
        return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * v)

    return filled(rows, columns, first, value)


def cauchys(rows: int, columns: int, seed: int, first: int = 0) -> np.ndarray:
    return filled(rows, columns, first, lambda f, px: np.tan(np.pi * (unit(fast_mixed(f, px, seed, NORMAL_A)) - 0.5)))


def uniforms(rows: int, columns: int, seed: int, first: int = 0) -> np.ndarray:
    return filled(rows, columns, first, lambda f, px: unit(fast_mixed(f, px, seed, NORMAL_A)))


def phases(count: int, seed: int) -> np.ndarray:
    """Offsets uniform on (0, 2 pi)."""
    f = np.arange(count, dtype=np.int64)
    return 2.0 * np.pi * unit(mixed(f, np.int64(0), seed, PHASE))


def signs(count: int, seed: int) -> np.ndarray:
    f = np.arange(count, dtype=np.int64)
    return np.where(mixed(f, np.int64(0), seed, SIGN) % 2 == 0, 1.0, -1.0)


def order_values(key: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """The hash of ``with_order`` for int64 arrays."""
    low, high, sub = key % MODULUS, key // MODULUS % MODULUS, place % MODULUS
    ends = []
    for stream in (ORDER_HIGH, ORDER_LOW):
        t = (first_draw(low, high, seed, stream) + sub * ORDER_PLACE) % MODULUS
        for r in range(ROUNDS):
            t = (next_draw(t, low, high, r) + sub * ORDER_PLACE) % MODULUS
        ends.append(t)
    return ends[0] * MODULUS + ends[1]


def with_order(df: DataFrame, out: str, key: Column, sub: Column | int, seed: int) -> DataFrame:
    """Add a hash in [0, ORDER_RANGE) of (key, sub) that orders rows at random; ties need the key itself.

    The low and the high part of the key and ``sub`` enter each round on their own,
    so no two of them stand for each other. Each round is a one-row ``inline``,
    which compiles to plain code but which the optimiser will not inline into the
    next round or into filters. So a draw is computed once, though the next round
    uses it twice.
    """
    sub = (sub if isinstance(sub, Column) else F.lit(sub)).cast("bigint")
    names, place = df.columns, ("__low", "__high", "__sub")
    low, high, more = F.col("__low"), F.col("__high"), F.col("__sub") * F.lit(ORDER_PLACE)
    wrap = lambda t: F.pmod(t + more, F.lit(MODULUS))

    def step(table: DataFrame, keep: tuple[str, ...], columns: dict[str, Column]) -> DataFrame:
        cell = F.struct(*[column.alias(name) for name, column in columns.items()])
        return table.select(*names, *keep, F.inline(F.array(cell)))

    table = step(df, (), {"__whole": key.cast("bigint"), "__sub": F.pmod(sub, F.lit(MODULUS))})
    whole = F.expr(f"(__whole - pmod(__whole, {MODULUS}L)) div {MODULUS}L")
    table = step(table, ("__sub",), {"__low": F.pmod(F.col("__whole"), F.lit(MODULUS)), "__high": F.pmod(whole, F.lit(MODULUS))})
    draws = {"__a": wrap(first_draw(low, high, seed, ORDER_HIGH)), "__b": wrap(first_draw(low, high, seed, ORDER_LOW))}
    table = step(table, place, draws)
    for r in range(ROUNDS):
        table = step(table, place, {name: wrap(next_draw(F.col(name), low, high, r)) for name in draws})
    hashed = F.col("__a") * F.lit(MODULUS) + F.col("__b")
    return step(table, (), {out: hashed})


ORDER_RANGE = MODULUS * MODULUS

"""Random projections of whole vectors: cosine features, Hadamard and Fastfood."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from patchlight import seeded
from patchlight.functions.batches import BATCH_DOUBLES, VECTOR, carried, from_matrix, map_vectors, shared_matrix, to_matrix

WEIGHTS: dict[str, Callable[..., np.ndarray]] = {
    "gaussian": seeded.normals,
    "cauchy": seeded.cauchys,
    "uniform": seeded.uniforms,
}


def next_power2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


# Largest Hadamard matrix that is multiplied outright.
RADIX = 64


def hadamard_matrix(width: int) -> np.ndarray:
    index = np.arange(width)
    return 1.0 - 2.0 * (np.bitwise_count(index[:, None] & index[None, :]) % 2)


def hadamard_rows(rows: np.ndarray) -> np.ndarray:
    """Unnormalised Walsh-Hadamard transform along the last axis, natural order.

    A transform of width a*b is a transform of the b-long runs followed by one
    across them, so a few small matrix products do all of it.
    """
    width = rows.shape[-1]
    if width & (width - 1) or not width:
        raise ValueError(f"row length {width} is not a power of two")
    out, inner = rows.reshape(-1, width), 1
    while inner < width:
        radix = min(RADIX, width // inner)
        runs = out.reshape(-1, radix, inner)
        out = runs[:, :, 0] @ hadamard_matrix(radix) if inner == 1 else np.matmul(hadamard_matrix(radix), runs)
        inner *= radix
    return out.reshape(rows.shape)


def hadamard(df: DataFrame, column: str = "features", out: str | None = None) -> DataFrame:
    return map_vectors(df, column, lambda: hadamard_rows, out=out)


class FastfoodParts(NamedTuple):
    width: int
    sign: np.ndarray
    gauss: np.ndarray
    scale: np.ndarray
    order: np.ndarray
    permuted: bool

    def between(self, low: int, high: int) -> "FastfoodParts":
        """The blocks that hold outputs low..high-1; ``low`` starts a block."""
        take = slice(low // self.width, -(-high // self.width))
        return self._replace(sign=self.sign[take], gauss=self.gauss[take], scale=self.scale[take], order=self.order[take])


def fastfood_matrices(inputs: int, outputs: int, seed: int, permute: bool = True) -> FastfoodParts:
    """The diagonals and permutations, one row per block of the padded input length.

    The scaling draws a chi-square variate per output from one normal draw
    (cube-root transform), over the norm of all Gaussian entries.
    """
    width = next_power2(inputs)
    blocks = -(-outputs // width)
    total = blocks * width
    gauss = seeded.normals(total, 1, seed)[:, 0]
    z = seeded.normals(total, 1, seed, (seeded.CHI_A, seeded.CHI_B))[:, 0]
    spread = 2.0 / (9.0 * total)
    scale = np.sqrt(total * (1.0 - spread + z * np.sqrt(spread)) ** 3) / np.linalg.norm(gauss)
    order = np.tile(np.arange(width), (blocks, 1))
    if permute:
        f = np.arange(total, dtype=np.int64)
        keys = seeded.mixed(f, np.int64(0), seed, seeded.PERMUTE).reshape(blocks, width)
        order = np.argsort(keys, axis=1, kind="stable")
    shape = (blocks, width)
    return FastfoodParts(width, seeded.signs(total, seed).reshape(shape), gauss.reshape(shape), scale.reshape(shape), order, permute)


def fastfood_rows(rows: np.ndarray, parts: FastfoodParts, outputs: int, sigma: float, root: bool = True) -> np.ndarray:
    """Per block S * H(G * P(H(B * x))) / sigma, also over sqrt(width) if ``root``."""
    padded = np.zeros((len(rows), 1, parts.width))
    padded[:, 0, : rows.shape[1]] = rows
    mixed = hadamard_rows(padded * parts.sign)
    mixed = np.take_along_axis(mixed, parts.order[None], axis=2) if parts.permuted else mixed
    result = hadamard_rows(mixed * parts.gauss) * (parts.scale / (sigma * np.sqrt(parts.width) if root else sigma))
    return result.reshape(len(rows), -1)[:, :outputs]


def fastfood(
    df: DataFrame,
    inputs: int,
    outputs: int,
    seed: int,
    sigma: float = 1.0,
    column: str = "features",
    permute: bool = True,
    root: bool = True,
) -> DataFrame:
    """Fastfood projection; the phase and the cosine are not applied here.

    ``root=False`` leaves out the 1/sqrt(width) of the batch form, and
    ``permute=False`` leaves out the permutation.
    """

    def build():
        parts = fastfood_matrices(inputs, outputs, seed, permute)
        return lambda rows: fastfood_rows(rows, parts, outputs, sigma, root)

    return map_vectors(df, column, build, doubles_per_row=4 * max(outputs, next_power2(inputs)))


def cosine_features(
    df: DataFrame,
    inputs: int,
    outputs: int,
    seed: int,
    gamma: float = 1.0,
    column: str = "features",
    weights: str = "gaussian",
    phase: str = "uniform",
) -> DataFrame:
    """cos(x W^T + b), W = gamma * draws of the named distribution, b = 2 pi * draws.

    Banks of at most BANK_VALUES are drawn once by every task, larger ones filter
    block by filter block for every group of rows; nothing is drawn on the driver.
    """
    draw, draw_phase = WEIGHTS[weights], WEIGHTS[phase]

    def shift() -> np.ndarray:
        return seeded.phases(outputs, seed) if phase == "uniform" else 2.0 * np.pi * draw_phase(outputs, 1, seed + 1)[:, 0]

    def block(low: int, high: int) -> np.ndarray:
        return gamma * draw(high - low, inputs, seed, first=low)

    if outputs * inputs > BANK_VALUES:
        return cosine_blocks(df, column, inputs, outputs, block, shift)

    def build():
        across, phases = np.ascontiguousarray(block(0, outputs).T), shift()
        return lambda rows: np.cos(rows @ across + phases)

    return map_vectors(df, column, build, doubles_per_row=2 * outputs)


#: Values of a bank that a task keeps (64 MB), and of the filters it holds at a time beyond that (8 MB).
BANK_VALUES, BLOCK_VALUES = 1 << 23, 1 << 20


def cosine_blocks(
    df: DataFrame, column: str, inputs: int, outputs: int, block: Callable[[int, int], np.ndarray], shift: Callable[[], np.ndarray],
    group_doubles: int = BATCH_DOUBLES,
) -> DataFrame:
    """cos(x W^T + b) with the rows low..high of W from ``block(low, high)``, asked for once for every group of rows.

    A group has as many rows as fit in one batch of results, so a block serves many
    rows and no task holds more than a block of W.
    """
    keep = [c for c in df.columns if c != column]
    source = df.select(*keep, carried(df, column).alias("__vector"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(column, VECTOR)])
    wide, many = max(1, BLOCK_VALUES // max(1, inputs)), max(1, group_doubles // max(1, outputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phases = shift()
        for batch in batches:
            rows = to_matrix(batch.column(len(keep)))
            for begin in range(0, len(rows), many):
                own = rows[begin : begin + many]
                out = np.empty((len(own), outputs))
                for low in range(0, outputs, wide):
                    high = min(low + wide, outputs)
                    out[:, low:high] = own @ block(low, high).T
                out += phases
                np.cos(out, out=out)
                part = batch.slice(begin, len(own))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], from_matrix(out)], names=schema.names)

    return source.mapInArrow(run, schema)


def cosine_features_given(df: DataFrame, bank: np.ndarray, phase: np.ndarray, column: str = "features") -> DataFrame:
    """cos(x W^T + b) with an explicit W (outputs x inputs) and b, shipped once per executor.

    A bank of any size travels in blocks of filters of at most 64 MB each.
    """
    if len(phase) != len(bank):
        raise ValueError(f"{len(bank)} filters need as many phases, not {len(phase)}")
    outputs, inputs = bank.shape
    if bank.size <= BANK_VALUES:
        kept = shared_matrix(df.sparkSession, bank.size, lambda: bank)

        def build():
            across = np.ascontiguousarray(kept().T)
            return lambda rows: np.cos(rows @ across + phase)

        return map_vectors(df, column, build, doubles_per_row=2 * outputs)
    wide = max(1, BLOCK_VALUES // max(1, inputs))
    held = {low: df.sparkSession.sparkContext.broadcast(bank[low : low + wide]) for low in range(0, outputs, wide)}
    return cosine_blocks(df, column, inputs, outputs, lambda low, high: held[low].value, lambda: phase)


def cosine_node(df: DataFrame, phase: np.ndarray, column: str = "features") -> DataFrame:
    """cos(z + b) on rows that are already projected."""
    return map_vectors(df, column, lambda: lambda rows: np.cos(rows + phase))

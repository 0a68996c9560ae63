"""Row-local vector expressions. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Added to every element before squaring; floor of a patch norm;
# contrast target and the smallest contrast that is divided by.
NORM_OFFSET = 1e-12
NORM_FLOOR = 1e-4
CONTRAST_SCALE = 55.0
CONTRAST_FLOOR = 1e-8
LOG_OFFSET = 1e-12


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v)


def sum_squares(vector: Column, offset: float = 0.0) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + (v + F.lit(offset)) * (v + F.lit(offset)))


def l2_norm(vector: Column, offset: float = NORM_OFFSET) -> Column:
    """Square root of the sum of (x + offset)^2: the offset is inside the square."""
    return F.sqrt(sum_squares(vector, offset))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row, however often inner lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_each(vector: Column, scalar: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(v, scalar) for every v. The scalar is computed once per row, not once per element,
    as it would be if the lambda named it."""
    return F.zip_with(vector, F.array_repeat(scalar, F.size(vector)), f)


def divided(vector: Column, by: Column) -> Column:
    return with_each(vector, by, lambda v, n: v / n)


def l2_normalize(vector: Column, offset: float = NORM_OFFSET, normalize: bool = True) -> tuple[Column, Column]:
    """The vector over its norm, and the norm; ``normalize=False`` gives norm 1."""
    if not normalize:
        return vector, F.lit(1.0)
    norm = l2_norm(vector, offset)
    return divided(vector, norm), norm


def floor_normalize(vector: Column, floor: float = NORM_FLOOR) -> tuple[Column, Column]:
    """Divide by the plain norm, but never by less than ``floor``."""
    norm = F.greatest(F.sqrt(sum_squares(vector)), F.lit(floor))
    return divided(vector, norm), norm


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def contrast_normalize(pixels: Column, scale: float = CONTRAST_SCALE, floor: float = CONTRAST_FLOOR) -> Column:
    """Subtract the image's own mean, then divide by its norm over ``scale``."""
    mean = total(pixels) / F.size(pixels)
    centred = with_each(pixels, mean, lambda v, m: v - m)
    contrast = F.sqrt(sum_squares(centred)) / F.lit(scale)
    return divided(centred, F.when(contrast <= F.lit(floor), F.lit(1.0)).otherwise(contrast))


def scale_bytes(pixels: Column) -> Column:
    """Unsigned byte values to [0, 1]."""
    return F.transform(pixels, lambda v: v.cast("double") / F.lit(255.0))


def pick(vector: Column, positions: Sequence[int]) -> Column:
    """Keep the given positions, in the given order."""
    return let(vector, lambda v: F.transform(F.lit(list(positions)), lambda p: F.get(v, p)))


def block(vector: Column, start: int, width: int) -> Column:
    """Columns start .. start+width-1; the last block of a vector may be short."""
    return F.slice(vector, start + 1, width)


def indicator(label: Column, classes: int, negative: float = -1.0) -> Column:
    """1 at the label's position, ``negative`` (-1 or 0) elsewhere."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda c: F.when(c == label, F.lit(1.0)).otherwise(F.lit(float(negative))),
    )


def per_pixel(pixels: Column, channels: int, f: Callable[[Column], Column]) -> Column:
    """Apply a function of one pixel's channel array to every pixel of an image."""

    def each(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(values), F.lit(channels))
        return F.flatten(F.transform(starts, lambda s: f(F.slice(values, s, channels))))

    return let(pixels, each)


def symmetric_rectify(pixels: Column, channels: int, max_val: float = 0.0, alpha: float = 0.0) -> Column:
    """Twice the channels: max(m, x - alpha), then max(m, -x - alpha)."""

    def both(values: Column) -> Column:
        return F.concat(
            F.transform(values, lambda v: F.greatest(F.lit(max_val), v - F.lit(alpha))),
            F.transform(values, lambda v: F.greatest(F.lit(max_val), -v - F.lit(alpha))),
        )

    return per_pixel(pixels, channels, both)


def reverse_channels(pixels: Column, channels: int) -> Column:
    """BGR to RGB, for any channel count."""
    return per_pixel(pixels, channels, F.reverse)


def flip_image(pixels: Column, channels: int) -> Column:
    """Turn an image (or filter) by 180 degrees: reverse x and y, keep channels."""
    return reverse_channels(F.reverse(pixels), channels)


def subtract_channel_means(pixels: Column, means: Sequence[float]) -> Column:
    """Subtract the mean of each value's channel; also fits patches."""
    values = F.lit([float(m) for m in means])
    return F.transform(pixels, lambda v, i: v - F.get(values, i % len(means)))


def rotate(vector: Column, shift: int, length: int) -> Column:
    """Circular shift to the left."""
    shift = shift % length
    return F.concat(F.slice(vector, shift + 1, length - shift), F.slice(vector, 1, shift)) if shift else vector


def argmax(scores: Column) -> Column:
    """Index of the largest score; the first wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_k(scores: Column, k: int) -> Column:
    """The k classes with the largest scores, best first; lower class first on ties."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r["i"])


def softmax(scores: Column) -> Column:
    powers = with_each(scores, F.array_max(scores), lambda s, top: F.exp(s - top))
    return divided(powers, total(powers))


def cross_entropy(scores: Column, label: Column, offset: float = LOG_OFFSET) -> Column:
    """-log(p[label] + offset) with p the softmax of the scores."""
    return -F.log(F.get(softmax(scores), label) + F.lit(offset))

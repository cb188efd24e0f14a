"""Numeric kernels over array columns, built from higher-order functions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def linspace(low: float, high: float, n: int) -> list[float]:
    """n evenly spaced values, both ends included, stepping as floating-point libraries do."""
    if n == 1:
        return [low]
    step = (high - low) / (n - 1)
    return [low + k * step for k in range(n - 1)] + [high]


def bucket(x: Column, edges: list[float]) -> Column:
    """The number of the last edge at or below x, 0 below them all."""
    literal = F.array(*map(F.lit, edges))
    return F.greatest(F.size(F.filter(literal, lambda e: e <= x)) - 1, F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def bhattacharyya(a: Column, b: Column) -> Column:
    """The distance of two histograms: sqrt(max(0, 1 - sum(sqrt(a b)) / sqrt(sum(a) sum(b))))."""
    overlap = total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))
    scale = F.sqrt(total(a) * total(b))
    share = F.when(scale > 0, overlap / scale).otherwise(F.lit(1.0))
    return F.sqrt(F.greatest(F.lit(0.0), 1 - share))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def var_pop(values: Column) -> Column:
    centre = mean(values)
    return F.greatest(mean(F.transform(values, lambda x: x * x)) - centre * centre, F.lit(0.0))


def argmax(values: Column) -> Column:
    """The position from 0 of the first greatest value."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def peak(values: Column) -> Column:
    """The argmax, shifted a quarter towards the greater neighbour."""
    at = argmax(values)
    inside = (at > 0) & (at < F.size(values) - 1)
    left, right = F.try_element_at(values, at), F.try_element_at(values, at + 2)
    return at + F.when(inside, F.signum(right - left) * 0.25).otherwise(0.0)


def histogram(values: Column, low: float, high: float, bins: int) -> Column:
    """Counts of values in equal bins; the last bin holds its upper edge."""
    width = (high - low) / bins
    place = F.transform(values, lambda x: F.least(F.floor((x - low) / width), F.lit(bins - 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(place, lambda p: p == k)))


def cumulative(values: Column) -> Column:
    ends = F.sequence(F.lit(1), F.size(values))
    return F.transform(ends, lambda k: total(F.slice(values, 1, k)))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Linear interpolation of ys over ascending xs, constant beyond the ends."""
    k = F.size(F.filter(xs, lambda e: e <= x))
    at = lambda column, place: F.try_element_at(column, place)
    left_x, right_x, left_y, right_y = at(xs, k), at(xs, k + 1), at(ys, k), at(ys, k + 1)
    between = left_y + (right_y - left_y) * (x - left_x) / (right_x - left_x)
    return F.when(k == 0, at(ys, F.lit(1))).when(k >= F.size(xs), at(ys, F.size(ys))).otherwise(between)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def power_of_two(x: Column) -> Column:
    """The least exponent whose power of two is not below x."""
    return F.ceil(F.log2(x)).cast("int")


def first_known(*values: Column) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), values)


def channels_of(pixels: Column, many: int) -> Column:
    """Pixels, each an array of channels, with this number of channels: a single one is repeated, and
    what is beyond is left out."""
    repeated = lambda p: F.array_repeat(p[0], many)
    return F.transform(pixels, lambda p: F.when((F.size(p) == 1) & (many > 1), repeated(p)).otherwise(F.slice(p, 1, many)))


def even_sides(rows: Column) -> Column:
    """Rows of pixels without an odd last row and an odd last column."""
    even = lambda a: F.slice(a, 1, F.size(a) - F.size(a) % 2)
    return F.transform(even(rows), even)


YAW_EDGES = linspace(-1.2, 1.2, 128)


def pitch_edges(n: int) -> list[float]:
    return linspace(-math.pi / 2, math.pi / 2, n)

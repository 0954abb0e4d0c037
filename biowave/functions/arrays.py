"""Column expressions over one array of doubles: a segment is measured where it stands, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a lambda's outer expression is otherwise worked out for each element."""
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: u * v))


def power(a: Column) -> Column:
    return total(F.transform(a, lambda v: v * v))


def rms(a: Column) -> Column:
    return F.sqrt(power(a) / F.size(a))


def std(a: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(F.greatest(power(a) / F.size(a) - mean(a) * mean(a), F.lit(0.0)))


def quantile(a: Column, q: float) -> Column:
    """Linear interpolation between the sorted values."""
    at = (F.size(a) - 1) * F.lit(q)
    low = F.floor(at).cast("int")

    def of(ordered: Column) -> Column:
        first, second = F.element_at(ordered, low + 1), F.element_at(ordered, F.least(low + 2, F.size(a)))
        return first + (second - first) * (at - low)

    return let(F.array_sort(a), of)


def median(a: Column) -> Column:
    return quantile(a, 0.5)


def absolute(a: Column) -> Column:
    return F.transform(a, F.abs)


def mad(a: Column) -> Column:
    """Median distance from the median."""
    return let(median(a), lambda m: median(F.transform(a, lambda v: F.abs(v - m))))


def scale(a: Column, method: str, floor: str = "one") -> Column:
    """Scale of a segment: Q99, Q95, RMS, MAD, STD or MAX of it. A scale below 1e-12 becomes 1 or 1e-12 by `floor`."""
    by = {
        "Q99": lambda: quantile(absolute(a), 0.99),
        "Q95": lambda: quantile(absolute(a), 0.95),
        "RMS": lambda: rms(a),
        "MAD": lambda: mad(a) * 1.4826,
        "STD": lambda: std(a),
        "MAX": lambda: F.array_max(absolute(a)),
    }[method]()
    return let(by, lambda s: F.when(s < TINY, F.lit(1.0)).otherwise(s)) if floor == "one" else F.greatest(by, F.lit(TINY))


def clipped(a: Column, by: Column) -> Column:
    return let(by, lambda s: F.transform(a, lambda v: F.greatest(F.least(v / s, F.lit(1.0)), F.lit(-1.0))))


def min_max(a: Column) -> Column:
    ends = F.struct(F.array_min(a).alias("low"), (F.array_max(a) - F.array_min(a)).alias("span"))
    return let(ends, lambda e: F.transform(a, lambda v: (v - e["low"]) / F.when(e["span"] < TINY, F.lit(1.0)).otherwise(e["span"])))


def part(a: Column, start: Column | int, length: Column | int) -> Column:
    """length values from place start, counted from 0."""
    return F.slice(a, start + F.lit(1), length if isinstance(length, Column) else F.lit(length))


def decimated(a: Column, ratio: int) -> Column:
    """Of every `ratio` values the one with the largest magnitude, the first of equals; a short tail is left out."""
    starts = F.sequence(F.lit(0), F.floor(F.size(a) / ratio).cast("int") - 1)

    def pick(block: Column) -> Column:
        return F.element_at(block, F.array_position(absolute(block), F.array_max(absolute(block))).cast("int"))

    return F.transform(starts, lambda k: let(part(a, k * ratio, ratio), pick))


def of_length(a: Column, n: int) -> Column:
    """Cut, or repeated, to n values; zeros where there is nothing to repeat."""
    copies = F.ceil(F.lit(n) / F.greatest(F.size(a), F.lit(1))).cast("int")
    tiled = F.slice(F.flatten(F.array_repeat(a, copies)), 1, n)
    return F.when(F.size(a) == 0, F.array_repeat(F.lit(0.0), n)).otherwise(tiled)


def sign_changes(a: Column) -> Column:
    """Places where the sign differs from the one before; a zero has a sign of its own."""
    n = F.size(a)
    pairs = F.zip_with(F.slice(a, 1, n - 1), F.slice(a, 2, n - 1), lambda u, v: F.when(F.signum(u) != F.signum(v), 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda s, v: s + v)


def moving_average(a: Column, width: int) -> Column:
    """Box average of the full width, centred; beyond the ends counts as zero."""
    left = width // 2
    at = F.sequence(F.lit(0), F.size(a) - 1)

    def one(k: Column) -> Column:
        first = F.greatest(k - left, F.lit(0))
        last = F.least(k - left + width - 1, F.size(a) - 1)
        return total(part(a, first, last - first + 1)) / width

    return F.transform(at, one)


def running(a: Column, half: int, of) -> Column:
    """of(window) over 2 * half + 1 values around each place; the end values are repeated beyond the ends."""
    n = F.size(a)
    around = lambda k: F.transform(F.sequence(k - half, k + half), lambda j: F.element_at(a, F.least(F.greatest(j, F.lit(0)), n - 1) + 1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: of(around(k)))


def soft_threshold(a: Column, by: Column) -> Column:
    return let(by, lambda t: F.transform(a, lambda v: F.signum(v) * F.greatest(F.abs(v) - t, F.lit(0.0))))


def universal_threshold(a: Column) -> Column:
    """sigma * sqrt(2 ln n), sigma the median magnitude over 0.6745."""
    sigma = median(absolute(a)) / 0.6745
    return sigma * F.sqrt(2.0 * F.ln(F.greatest(F.size(a), F.lit(2)).cast("double")))

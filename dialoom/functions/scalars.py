"""Small numeric, map and format expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is not positive or null."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def dbfs(amplitude: Column, floor: float = -120.0) -> Column:
    """Decibels of full scale, not below the floor."""
    return F.when(amplitude > 0, F.greatest(F.lit(floor), 20 * F.log10(amplitude))).otherwise(F.lit(floor))


def amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Length that two intervals share, 0 if none."""
    return F.greatest(F.least(end, other_end) - F.greatest(start, other_start), F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 if the union is empty."""
    width, height = overlap(a[0], a[2], b[0], b[2]), overlap(a[1], a[3], b[1], b[3])
    area = lambda x: F.greatest(x[2] - x[0], F.lit(0.0)) * F.greatest(x[3] - x[1], F.lit(0.0))
    return safe_ratio(width * height, area(a) + area(b) - width * height)


def map_total(scores: Column) -> Column:
    return F.aggregate(F.map_values(scores), F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0)))


def normalized_map(scores: Column) -> Column:
    """Scores that sum to 1; as they are if they sum to 0."""
    total = map_total(scores)
    return F.when(total > 0, F.transform_values(scores, lambda _, v: v / total)).otherwise(scores)


def blended(scores: Column, label: Column, weight: float, labels: tuple[str, ...]) -> Column:
    """weight of all on one label, the rest as in scores; over a fixed list of labels."""
    entries = [
        F.struct(F.lit(n).alias("key"), ((1 - weight) * F.coalesce(F.try_element_at(scores, F.lit(n)), F.lit(0.0)) + F.when(label == n, weight).otherwise(0.0)).alias("value"))
        for n in labels
    ]
    return normalized_map(F.map_from_entries(F.array(*entries)))


def map_argmax(scores: Column, labels: tuple[str, ...]) -> Column:
    """The label with the largest score; of equals the first in the list."""
    entries = F.array(*[F.struct(F.coalesce(F.try_element_at(scores, F.lit(n)), F.lit(0.0)).alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, n in enumerate(labels)])
    return F.array_max(entries).getField("n")


def top_entries(scores: Column, k: int) -> Column:
    """The k largest entries, by value down and then by key."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e.value).alias("down"), e.key.alias("key")))
    return F.slice(F.transform(F.array_sort(entries), lambda e: F.struct(e.key.alias("key"), (-e.down).alias("value"))), 1, k)


def clock(seconds: Column) -> Column:
    """m:ss"""
    whole = F.floor(seconds)
    return F.concat((whole / 60).cast("bigint").cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def atempo_chain(factor: Column) -> Column:
    """Factors in 0.5..2 whose product is the factor: as many equal ones as are needed."""
    count = F.greatest(F.lit(1), F.ceil(F.abs(F.log2(factor)) - 1e-12)).cast("int")
    return F.array_repeat(F.pow(factor, 1 / count), count)

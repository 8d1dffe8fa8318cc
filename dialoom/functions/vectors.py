"""Vector expressions over array<double> columns, and mean vectors as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Length 1; a zero vector stays."""
    size = norm(a)
    return F.zip_with(a, F.array_repeat(F.when(size > 0, size).otherwise(1.0), F.size(a)), lambda x, n: x / n)


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def sums(rows: DataFrame, keys: list[str], vector: str = "embedding", weight: Column | None = None) -> DataFrame:
    """(keys, total array<double>, n, weight): element-wise sums. Rows are cut into elements, so partial sums come before the shuffle."""
    parts = rows.select(*keys, F.posexplode(vector).alias("pos", "x"), (F.lit(1.0) if weight is None else weight).alias("w"))
    added = parts.groupBy(*keys, "pos").agg(F.sum(F.col("w") * F.col("x")).alias("x"), F.count("*").alias("n"), F.sum("w").alias("w"))
    return added.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e.x).alias("total"), F.max("n").alias("n"), F.max("w").alias("weight")
    )


def centroids(rows: DataFrame, keys: list[str], vector: str = "embedding", weight: Column | None = None) -> DataFrame:
    """(keys, centroid, n): unit mean vectors; a group whose weights are all zero counts each row alike."""
    found = sums(rows, keys, vector, weight)
    mean = F.transform(F.col("total"), lambda x: x / F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.col("n")))
    return found.select(*keys, unit(mean).alias("centroid"), "n")

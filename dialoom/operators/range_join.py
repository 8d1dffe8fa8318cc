"""Joins on time: overlaps, points in intervals, nearest intervals, as-of. All are equi-joins on (clip, bin) or window passes.

Time is cut into bins. An interval stands in each bin it touches; two intervals meet in the first bin both touch, so each
pair comes once and no nested loop over a clip is made. The bin width is a matter of speed only: about the length of a
usual interval. A long interval costs a row for each bin it covers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import overlap


def _bin(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(float(width))).cast("long")


def overlap_join(left: DataFrame, right: DataFrame, by: Sequence[str], width: float, prefix: str = "r_", margin: float = 0.0, how: str = "inner") -> DataFrame:
    """Pairs of rows of a clip whose intervals share more than a point: left's columns, right's with a prefix, ``overlap``.

    ``margin`` widens the right intervals on both sides. how: inner or left.
    """
    renamed = right.select(*[F.col(c).alias(c if c in by else f"{prefix}{c}") for c in right.columns])
    low, high = F.col(f"{prefix}start") - margin, F.col(f"{prefix}end") + margin
    # Reversed intervals share nothing; left in, their bins would run backwards.
    a = left.filter(F.col("start") <= F.col("end")).withColumn("_first", _bin(F.col("start"), width)).withColumn("_bin", F.explode(F.sequence("_first", _bin(F.col("end"), width))))
    b = renamed.filter(low <= high).withColumn("_rfirst", _bin(low, width)).withColumn("_bin", F.explode(F.sequence("_rfirst", _bin(high, width))))
    shared = F.col("_bin") == F.greatest("_first", "_rfirst")
    if how == "inner":
        met = a.join(b, [*by, "_bin"]).filter(shared & (F.col("start") < high) & (low < F.col("end")))
        met = met.drop("_bin", "_first", "_rfirst")
    else:
        key = F.xxhash64(*[F.col(c) for c in left.columns])
        pairs = a.join(b, [*by, "_bin"]).filter(shared & (F.col("start") < high) & (low < F.col("end"))).withColumn("_key", key)
        extra = [c for c in renamed.columns if c not in by]
        met = left.withColumn("_key", key).join(pairs.select("_key", *by, *extra).distinct(), ["_key", *by], "left").drop("_key")
    return met.withColumn("overlap", overlap(F.col("start"), F.col("end"), F.col(f"{prefix}start"), F.col(f"{prefix}end")))


def point_join(points: DataFrame, intervals: DataFrame, at: Column, by: Sequence[str], width: float, prefix: str = "r_", margin: float = 0.0, closed: bool = False, keep_bin: bool = False) -> DataFrame:
    """Rows of points with each interval of the clip that holds ``at``: start - margin <= at < end + margin (<= if closed).

    keep_bin: ``_bin`` stays, so that groups within it need no shuffle.
    """
    renamed = intervals.select(*[F.col(c).alias(c if c in by else f"{prefix}{c}") for c in intervals.columns])
    low, high = F.col(f"{prefix}start") - margin, F.col(f"{prefix}end") + margin
    a = points.withColumn("_at", at).withColumn("_bin", _bin(F.col("_at"), width))
    b = renamed.filter(low <= high).withColumn("_bin", F.explode(F.sequence(_bin(low, width), _bin(high, width))))
    inside = (low <= F.col("_at")) & ((F.col("_at") <= high) if closed else (F.col("_at") < high))
    return a.join(b, [*by, "_bin"]).filter(inside).drop("_at", *([] if keep_bin else ["_bin"]))


def dominant_label(windows: DataFrame, segments: DataFrame, by: Sequence[str], keys: Sequence[str], width: float, none: str | None = "NONE") -> DataFrame:
    """(by, keys, label, seconds, coverage): the label with the most overlap; of equals the one that comes first in time."""
    met = overlap_join(windows.select(*by, *keys, "start", "end"), segments.select(*by, "seg_ord", "speaker", "start", "end"), by, width)
    summed = met.groupBy(*by, *keys, "r_speaker").agg(F.sum("overlap").alias("s"), F.min(F.struct("r_start", "r_seg_ord")).alias("first"))
    # The largest sum; of equal sums the label that begins first: struct order with the place turned around.
    best = summed.groupBy(*by, *keys).agg(F.max(F.struct("s", (-F.col("first.r_start")).alias("a"), (-F.col("first.r_seg_ord")).alias("b"), "r_speaker")).alias("m"))
    out = windows.join(best, [*by, *keys], "left")
    return out.select(
        *by, *keys, F.coalesce(F.col("m.r_speaker"), F.lit(none)).alias("label"), F.coalesce("m.s", F.lit(0.0)).alias("seconds"),
        F.when(F.col("end") > F.col("start"), F.coalesce("m.s", F.lit(0.0)) / (F.col("end") - F.col("start"))).otherwise(0.0).alias("coverage"),
    )


def first_label_at(points: DataFrame, segments: DataFrame, at: Column, by: Sequence[str], keys: Sequence[str], width: float) -> DataFrame:
    """points with ``label``: that of the first segment in order that holds the time, else null."""
    met = point_join(points.select(*by, *keys, at.alias("_t")), segments.select(*by, "seg_ord", "speaker", "start", "end"), F.col("_t"), by, width)
    first = met.groupBy(*by, *keys).agg(F.min_by("r_speaker", F.struct("r_start", "r_seg_ord")).alias("label"))
    return points.join(first, [*by, *keys], "left")


def words_to_segments(segments: DataFrame, words: DataFrame, by: Sequence[str], width: float, margin: float = 0.05) -> DataFrame:
    """segments with ``text`` and ``word_count`` of the words whose middle lies within them, margin included; a word may fall in two."""
    middle = (F.col("start") + F.col("end")) / 2
    met = point_join(words, segments.select(*by, "seg_ord", "start", "end"), middle, by, width, margin=margin, closed=True)
    found = met.groupBy(*by, F.col("r_seg_ord").alias("seg_ord")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "word_ord", "word"))), lambda x: x.word), " ").alias("text"),
        F.count("*").alias("word_count"),
    )
    return segments.join(found, [*by, "seg_ord"], "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("word_count", F.coalesce("word_count", F.lit(0)))


def nearest_interval(points: DataFrame, intervals: DataFrame, at: Column, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """points with ``near_ord``, ``near_speaker``, ``distance``: the interval nearest in time, 0 if it holds the time.

    Two running passes in time order over points and intervals together, no pairing within a clip: the largest end so far
    among intervals that began, and the first start to come. Of equal distances the earlier interval wins.
    """
    p = points.select(*by, *keys, at.alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("who"), F.lit(None).cast("double").alias("e"))
    nulls = [F.lit(None).cast(points.schema[k].dataType).alias(k) for k in keys]
    i = intervals.select(*by, *nulls, F.col("start").alias("t"), F.lit(0).alias("kind"), F.col("seg_ord").alias("ord"), F.col("speaker").alias("who"), F.col("end").alias("e"))
    line = p.unionByName(i)
    w = Window.partitionBy(*by).orderBy("t", "kind", F.col("ord"))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Backwards with a growing frame: a shrinking one would be evaluated anew for each row.
    to_come = Window.partitionBy(*by).orderBy(F.desc("t"), F.desc("kind"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("kind") == 0, F.struct("e", (-F.col("t")).alias("s"), (-F.col("ord")).alias("o"), "who"))
    nxt = F.when(F.col("kind") == 0, F.struct("t", "ord", "who"))
    seen = line.withColumn("_past", F.max(own).over(so_far)).withColumn("_next", F.last(nxt, ignorenulls=True).over(to_come)).filter("kind = 1")
    past = F.greatest(F.col("t") - F.col("_past.e"), F.lit(0.0))
    future = F.col("_next.t") - F.col("t")
    first = F.col("_past").isNotNull() & (F.col("_next").isNull() | (past <= future))
    found = seen.select(
        *by, *keys, F.when(first, -F.col("_past.o")).otherwise(F.col("_next.ord")).alias("near_ord"),
        F.when(first, F.col("_past.who")).otherwise(F.col("_next.who")).alias("near_speaker"), F.when(first, past).otherwise(future).alias("distance"),
    )
    return points.join(found, [*by, *keys], "left")


def without_near(rows: DataFrame, others: DataFrame, by: Sequence[str], within: float, at: Column | None = None, equal: str | None = None) -> DataFrame:
    """rows for which no other row of the clip lies within ``within`` seconds (strictly), of the same ``equal`` column if given."""
    t = F.col("start") if at is None else at
    own = rows.withColumn("_t", t).withColumn("_k", F.xxhash64(*[F.col(c) for c in rows.columns]))
    keys = [*by, *([equal] if equal else [])]
    near = others.withColumn("_u", t).select(*keys, "_u").withColumn("_bin", F.explode(F.array(*[_bin(F.col("_u"), within) + d for d in (-1, 0, 1)])))
    hit = own.withColumn("_bin", _bin(F.col("_t"), within)).join(near, [*keys, "_bin"]).filter(F.abs(F.col("_t") - F.col("_u")) < within).select("_k").distinct()
    return own.join(hit, "_k", "left_anti").drop("_t", "_k")


def nearest_duration(rows: DataFrame, caches: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """rows (id, duration) with the cache (cache_id, cache_duration) of nearest duration, within a tolerance; of equally near ones the smallest id.

    Distinct durations alone are met: those of the caches, with their smallest ids, stand in their bin and its neighbours, and two running
    passes over a bin find the last one up to each duration and the first one from it on. No pairs are made.
    """
    b = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    sizes = rows.filter("duration IS NOT NULL AND NOT isnan(duration)").select("duration").distinct()
    least = caches.filter("cache_duration IS NOT NULL AND NOT isnan(cache_duration)").groupBy("cache_duration").agg(F.min("cache_id").alias("cache_id"))
    spread = least.withColumn("_bin", F.explode(F.array(b("cache_duration") - 1, b("cache_duration"), b("cache_duration") + 1)))
    held = F.struct(F.col("cache_duration").alias("d"), "cache_id")
    line = sizes.select(b("duration").alias("_bin"), F.col("duration").alias("_t"), F.lit(None).cast(spread.select(held).schema[0].dataType).alias("_c")).unionByName(
        spread.select("_bin", F.col("cache_duration").alias("_t"), held.alias("_c")))
    # A cache of the very duration comes before it in either pass.
    passes = [F.last("_c", ignorenulls=True).over(Window.partitionBy("_bin").orderBy(t, F.col("_c").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)) for t in (F.asc("_t"), F.desc("_t"))]
    met = line.select("_t", "_c", *[p.alias(n) for p, n in zip(passes, ("_low", "_high"), strict=True)]).filter("_c IS NULL")
    best = F.least(*[F.when(F.abs(F.col("_t") - F.col(n).d) <= tolerance, F.struct(F.abs(F.col("_t") - F.col(n).d).alias("_off"), F.col(n).cache_id.alias("cache_id"))) for n in ("_low", "_high")])
    found = met.select(F.col("_t").alias("duration"), best.alias("_m")).filter("_m IS NOT NULL")
    return rows.join(found, "duration", "left").select(*rows.columns, F.col("_m.cache_id").alias("cache_id"), F.col("_m._off").alias("off"))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """left with the ``values`` of the last row of right at or before its time: one pass over both in time order."""
    pad = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    a = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), *pad)
    b = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *values)
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = a.unionByName(b)
    packed = F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(w)
    return line.withColumn("_v", packed).filter("_side = 1").select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])

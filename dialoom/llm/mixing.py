"""Mixing sources to target weights: a time-varying curriculum, in DataFrame functions.

Each source has a weight and a schedule, the weight's factor at the begin and the end of training with a straight
line between. Integrated over training time t in 0..1 the schedule gives the source's cumulative token demand,
scaled so that the demand at t = 1 is the source's target:

    demand(t) = target * (a * t + (b - a) * t**2 / 2) / ((a + b) / 2)

The documents of a source, in the order of a digest of doc_id, stand one after another on its supply of tokens,
and again in the next pass. A document's occurrence whose middle is at supply position x is trained at the time
t at which demand(t) = x: the inverse of the demand, a square root. Occurrences with x beyond the target are not
trained, so the taken words of a source differ from its target by half a document at most.
Sorted by t (a range sort), the occurrences are the training order.

Targets: all sources share ``percent`` % of all words by weight; none takes more than ``most`` times its own words, and
what it leaves goes to the others by weight. That is the level L with sum(min(most * size, L * weight)) = total,
found in one pass over the sources in the order of most * size / weight.

The words of a text are counted once, into a narrow table (doc_id, source, size) from which targets, supply positions and times
follow; ``training_order``, which carries the texts, counts them once more there.

Supply positions are running sums over (source, slice of the digest) plus the sum of the slices before. A source of n
documents has about sqrt(n) slices of sqrt(n) documents, so that neither a slice nor a source's list of slices is large.

Defined cases: null text has size 0 and is never taken; a null source is a source, last in the order of sources; a null
doc_id has a fixed digest; rows that repeat a doc_id are separate documents in the order of their sizes, equal rows
in either order with the same result; an empty table gives an empty one; a source without words has the target 0. A very long
text is taken whole or not at all. Extra columns pass through; internal columns take names that docs does not use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, n_words, written

#: Weights of the sources in order, repeating, and their schedules' factors at t = 0 and t = 1.
WEIGHTS = (5, 2, 1)
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))
PERCENT = 150
MOST = 2


#: Tables of at most so many rows are broadcast: some hundred KB. Larger ones are joined by a shuffle.
BROADCAST_ROWS = 5_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _cycled(values: Sequence, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(place - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, size) rows -> (source, documents, source_size, weight, target), a row for each source."""
    by_source = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    # From here on a row stands for a source: these windows see as many rows as there are sources.
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    named = by_source.withColumn("place", F.row_number().over(in_order)).withColumn("weight", _cycled(weights, F.col("place")))
    named = named.withColumn("limit", F.lit(most) * F.col("source_size"))
    total = F.lit(percent) * F.sum("source_size").over(Window.partitionBy()) / F.lit(100.0)
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("place"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(onward)
    # The first source, in this order, that the level does not fill sets the level of all from there on.
    found = named.withColumn("level", level).withColumn("open", F.col("limit") >= F.col("level") * F.col("weight"))
    reached = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    found = found.withColumn("reached", reached)
    target = F.when(F.col("reached").isNull() | (F.col("limit") < F.col("reached") * F.col("weight")), F.col("limit").cast("double"))
    return found.select("source", "place", "documents", "source_size", "weight", target.otherwise(F.col("reached") * F.col("weight")).alias("target"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the words of each text, counted once and written."""
    return written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")


def curriculum(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[tuple[float, float]] = SCHEDULES, percent: int = PERCENT,
    most: int = MOST, slice_rows: int | None = None,
) -> DataFrame:
    """docs with ``size``, ``source_size``, ``target``, ``times`` and ``positions`` (array of training times, one for each time).

    These names are taken over if docs has them. docs without ``text`` has its ``size`` already. Text only passes through; it takes
    no part in a shuffle but one by source slice.
    """
    sized = docs.withColumn("size", n_words(F.col("text"))) if "text" in docs.columns else docs
    counted = sizes(docs) if "text" in docs.columns else sized.select("doc_id", "source", "size")
    per = written(targets(counted.select("source", "size"), weights, percent, most), "targets")
    cuts = F.ceil(F.col("documents") / F.lit(slice_rows)) if slice_rows else F.ceil(F.sqrt("documents"))
    sources, slices = per.agg(F.count("*"), F.sum(cuts)).first()
    digest, slice_, base, own, ahead = (free_name(sized, f"_{x}") for x in ("digest", "slice", "base", "own", "ahead"))
    per = per.select(
        F.col("source").alias(own), "source_size", "target", cuts.alias(slice_),
        _cycled([a for a, _ in schedules], F.col("place")).alias(base), _cycled([b for _, b in schedules], F.col("place")).alias(ahead),
    )

    def dealt(rows: DataFrame) -> DataFrame:
        """rows with their source's figures and slice."""
        named = rows.withColumn(digest, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        named = named.join(_small(per, sources), named.source.eqNullSafe(per[own])).drop(own)
        return named.withColumn(slice_, F.floor(drawn * F.col(slice_) / F.lit(1 << 32)))

    named = dealt(sized)
    sums = dealt(counted).groupBy("source", slice_).agg(F.sum("size").alias(own))
    before = Window.partitionBy("source").orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col(slice_).alias("_k"), F.coalesce(F.sum(own).over(before), F.lit(0)).alias(own))
    placed = named.join(_small(sums, slices or 0), named.source.eqNullSafe(sums["_s"]) & (named[slice_] == sums["_k"])).drop("_s", "_k")
    within = Window.partitionBy("source", slice_).orderBy(digest, "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col(own) + F.sum("size").over(within) - F.col("size") / F.lit(2.0)
    placed = placed.withColumn(own, middle)
    a, b, target = F.col(base), F.col(ahead), F.col("target")

    def time_of(x: Column) -> Column:
        """The t with demand(t) = x."""
        part = x / target * (a + b) / 2
        return F.when(a == b, x / target).otherwise((F.sqrt(a * a + 2 * (b - a) * part) - a) / (b - a))

    passes = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.col(own) + k * F.col("source_size"))
    trained = F.when(F.col("size") > 0, F.filter(passes, lambda x: x <= target)).otherwise(F.array().cast("array<double>"))
    placed = placed.withColumn(own, trained)
    return placed.withColumn("positions", F.transform(F.col(own), time_of)).withColumn("times", F.size(own).cast("long")).drop(
        digest, slice_, base, ahead, own
    )


def ordered(docs: DataFrame, **parameters) -> DataFrame:
    """curriculum of (doc_id, source, text) without the text, range-sorted by first training position; rows never trained come last."""
    first = F.try_element_at("positions", F.lit(1))
    return curriculum(sizes(docs), **parameters).orderBy(first.asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, **parameters) -> DataFrame:
    """docs, each row as often as the mix takes it, range-sorted by training position; the columns of docs."""
    names, position, rest = docs.columns, free_name(docs, "_position"), free_name(docs, "_rest")
    own = [c for c in names if c not in ("doc_id", "text", "source")]
    packed = docs.select("doc_id", "text", "source", F.struct(*own, F.lit(0).alias(position)).alias(rest))
    mixed = curriculum(packed, **parameters).select("doc_id", "text", "source", rest, F.explode("positions").alias(position))
    back = [F.col(f"{rest}.{c}").alias(c) if c in own else F.col(c) for c in names]
    return mixed.orderBy(position, "doc_id").select(*back)

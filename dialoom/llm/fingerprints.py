"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

The sketch of a text is the sorted array of the ``K`` smallest distinct hashes of its word shingles (A-Z lower-cased;
``SHINGLE`` words each; a text with fewer words is one shingle, one without words has an empty sketch). It is a uniform
sample of the shingle set, so from two sketches follow resemblance, containment and the number of distinct shingles,
and the sketch of the union is the bottom k of the two sketches: sketches of parts merge to that of the whole (parts
overlapping by ``SHINGLE - 1`` words), two at a time (``merge``) or all rows of a group (``merge_rows``).

Defined cases: null text counts as empty; two empty sketches have the likeness 1, an empty and another 0; equal texts
have equal sketches. Rows that repeat a doc_id follow each other in the order of a hash of their texts, a null doc_id
comes last in the descending order. An empty table gives an empty table. Very long texts are one row's work, linear in their words. Tied hashes are one hash; ties
of doc_id are ordered by text hash. ``with_next`` lets extra columns pass and uses free names; ``fingerprint_documents`` returns
its own columns only, so no name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, words_of

K = 128
SHINGLE = 5
#: Ranges of doc_id that neighbours are looked up in, and their sorted windows.
ROWS_A_RANGE = 4_000
MOST_RANGES = 10_000


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Bottom-k sketch of a text: array<long>, ascending."""
    # Upper-case letters beyond A-Z stay as they are: translate() names the 26 letters.
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return bottom(_shingles(F.transform(words_of(lowered), lambda w: F.xxhash64(w)), shingle), k)


def _shingles(hashed: Column, shingle: int) -> Column:
    """Hashes of the windows over word hashes; the name is bound once, so the words are hashed once."""
    return F.flatten(F.transform(F.array(hashed), lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(h) - (shingle - 1), F.lit(1))),
            lambda i: F.xxhash64(F.slice(h, i, shingle)),
        )
    )))


def bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return bottom(F.concat(a, b), k)


def merge_rows(rows: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """(keys, sketch): the sketch of the union of each group's parts. Rows of hashes, not of arrays: each task keeps the k smallest of a
    group before the last shuffle, so a group of any size comes to one task as k hashes from each other task at most."""
    hashes = rows.select(*keys, F.explode(sketch).alias("_hash")).distinct()
    order = Window.partitionBy(*keys).orderBy("_hash")
    least = hashes.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
    found = least.groupBy(*keys).agg(F.array_sort(F.collect_list("_hash")).alias(sketch))
    named = found.withColumnsRenamed({c: f"_{c}" for c in keys})
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    every = rows.select(*keys).distinct().join(named, same, "left")
    return every.select(*keys, F.coalesce(sketch, F.array().cast("array<bigint>")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's bottom k that both have, 0 to 1; 1 for two empty sketches."""
    union = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, 1.0).otherwise(common / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, then (k - 1) over the share of the hash range covered."""
    last = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: of a's hashes below what both sketches cover, those in b."""
    reach = F.least(
        F.when(F.size(a) < k, F.lit(2**63 - 1)).otherwise(F.element_at(a, -1)),
        F.when(F.size(b) < k, F.lit(2**63 - 1)).otherwise(F.element_at(b, -1)),
    )
    seen = F.filter(a, lambda h: h <= reach)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(seen, b)), F.size(seen)), F.lit(0.0)))


def as_text(a: Column) -> Column:
    """16 hex digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, carried: list[str], order: str = "doc_id", computed: dict[str, Column] | None = None) -> DataFrame:
    """docs with ``next_<column>`` of the row that follows in descending order; after the last comes the first.

    computed: further columns, added once the rows of the neighbouring ranges are found, so that finding them does not compute them.

    A range of ids is sorted in one task, and each range also gets the first row of the range that follows it. So rows
    move once and no task sees more than about ``ROWS_A_RANGE`` rows, whatever the number of rows, up to
    MOST_RANGES ranges, which then grow.
    """
    bucket, ghost, tie = (free_name(docs, f"_{x}") for x in ("bucket", "ghost", "tie"))
    count, = docs.agg(F.count("*")).first()
    ranges = max(1, min(MOST_RANGES, -(-count // ROWS_A_RANGE)))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = sorted({c for c in docs.agg(F.percentile_approx(order, steps, 10 * ranges)).first()[0] or []}) if steps else []
    # Ranges are numbered in descending order; a null comes after all numbers.
    number = F.lit(len(cuts)) - _cuts_below(F.col(order), cuts)
    placed = docs.withColumn(bucket, F.when(F.col(order).isNull(), len(cuts) + 1).otherwise(number)).withColumn(tie, F.xxhash64("text"))
    heads = placed.select(bucket, order, tie).groupBy(bucket).agg(
        F.max(F.struct(F.col(order).isNotNull().alias("known"), order, tie)).alias("head")
    )
    rows = sorted(heads.collect(), key=lambda r: r[bucket])  # one for each range: at most MOST_RANGES + 2
    spark = docs.sparkSession
    follows = [(rows[i - 1][bucket], r.head[order], r.head[tie]) for i, r in enumerate(rows)]
    target = spark.createDataFrame(follows, "to int, head_id long, head_tie long")
    ghosts = placed.join(F.broadcast(target), placed[order].eqNullSafe(target.head_id) & (placed[tie] == target.head_tie))
    ghosts = ghosts.withColumn(bucket, F.col("to")).drop("to", "head_id", "head_tie").dropDuplicates([bucket])
    both = placed.withColumn(ghost, F.lit(False)).unionByName(ghosts.withColumn(ghost, F.lit(True)))
    both = both.withColumns(computed or {})
    down = Window.partitionBy(bucket).orderBy(F.col(ghost), F.col(order).desc_nulls_last(), F.col(tie).desc())
    for name in carried:
        both = both.withColumn(f"next_{name}", F.lead(name).over(down))
    return both.filter(~F.col(ghost)).drop(bucket, ghost, tie)


def _cuts_below(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the value: first the group of about sqrt(n) cuts, then the place in it."""
    if not cuts:
        return F.lit(0)
    width = round(len(cuts) ** 0.5) or 1
    groups = F.array(*[F.array(*[F.lit(c) for c in cuts[i : i + width]]) for i in range(0, len(cuts), width)])
    group = F.size(F.filter(groups, lambda g: F.get(g, F.lit(0)) <= value))
    place = F.size(F.filter(F.get(groups, group - 1), lambda c: c <= value))
    return F.when(group == 0, 0).otherwise((group - 1) * width + place)


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the text (rounded down) replaced by the first as many code points of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> sketches of each text and its edited text, and the likeness of neighbours."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(own, ["text", "sketch"], computed={"sketch": sketch(F.col("text"), k, shingle)})
    own = own.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    own = own.withColumn("edited_sketch", sketch(F.col("edited"), k, shingle))
    return own.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "sketch", "edited_sketch", resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles_estimate"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("edited_contained"),
    )



"""Source divergence audit: how the term use of each (language, source) differs from that of the language's other sources.

Terms are runs of letters (all code points from 128 on count as letters), A-Z lower-cased. A language keeps the terms that at least
``min_docs`` of its documents hold. A group, a (language, source) pair or a whole language, gives each kept term the smoothed share
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the group's occurrences of kept terms and V the number of kept terms; two shares
differ by floor((p - q)^2 / (p + q)).

1. Tasks count terms of each (language, source) before anything is shuffled; a table has a row for each group and term.
2. Kept terms are dealt by hash to blocks of about ``block_terms`` a language, and numbered within their block.
3. A group has one array of (term number, count), sorted by number, for each block of its language: no array outgrows a block.
4. The arrays of two sources are co-grouped for each unordered pair and block. A galloping intersection finds the terms that both
   hold; these, those that one side holds and those that neither holds are priced apart. A pair's value is the sum over blocks, and
   both sources list it, since the difference has no direction.
5. A group's overused terms come from a join of its counts with its language's and a ranking that keeps ``top`` in each task first.

A source makes as many pairs as its language has other sources: that is the result asked for, so pairs grow with its square.
All arithmetic is on whole numbers: decimals in Spark, long division by thousands in the tasks.

Defined cases: null text, lang and source are ''; a group without terms, or a language that keeps none, has its pairs, in the latter
case with value 0, and no terms; a very long text is counted whole; repeated rows count as often as they stand there; ties are broken
by item in UTF-8 order; an empty table gives no rows; other columns of docs are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import written

MIN_DOCS = 10
TOP = 10
BLOCK_TERMS = 16_384
SCALE = 1_000_000_000
#: Languages and groups are joined by broadcast up to so many rows (counted), else by shuffles.
BROADCAST_ROWS = 5_000
#: A task hands on its counts when it holds so many.
HELD_TERMS = 400_000

#: Maps A-Z to a-z and every ASCII byte but letters to a blank, so that splitting gives the terms.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text bytes) -> counts of terms; a row with an empty term stands for each group."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}  # occurrences * 2^32 + documents

    def counts() -> Iterator[pa.RecordBatch]:
        for (lang, source), both in held.items():
            packed = np.fromiter(both.values(), np.int64, len(both))
            group = [pa.repeat(pa.scalar(x, pa.string()), len(both)) for x in (lang, source)]
            yield pa.record_batch([*group, pa.array(both, pa.binary()), pa.array(packed >> 32), pa.array(packed & 0xFFFFFFFF)], schema=_COUNTS)

    terms = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            both = held.setdefault((lang.as_py(), source.as_py()), {b"": 0})
            get, before = both.get, len(both)
            for term, n in Counter(text.as_py().translate(_LETTERS).split()).items():
                both[term] = get(term, 0) + (n << 32) + 1
            terms += len(both) - before
            if terms > HELD_TERMS:
                yield from counts()
                held, terms = {}, 0
    yield from counts()


def shares(counts: np.ndarray, out_of: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / out_of) by long division in thousands: exact below 2^63 / 1000 occurrences."""
    digits, rest = np.divmod(counts + 2, out_of)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, out_of)
        digits = digits * 1000 + digit
    return digits + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def gallop(few: np.ndarray, many: np.ndarray, stretch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Positions in few and in many of the numbers that both sorted arrays hold.

    few is gone through by stretches; from where the last one ended, steps of doubling length in many find a range that reaches
    beyond the stretch, and only that range is searched.
    """
    at, found = 0, np.empty(len(few), np.int64)
    for i in range(0, len(few), stretch):
        part = few[i : i + stretch]
        step = stretch
        while at + step < len(many) and many[at + step] < part[-1]:
            step *= 2
        places = at + np.searchsorted(many[at : at + step + 1], part)
        found[i : i + stretch] = places
        at = int(places[-1])
    inside = found < len(many)
    inside[inside] = many[found[inside]] == few[inside]
    return np.flatnonzero(inside), found[inside]


def price(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], terms: int) -> int:
    """Sum of differences over a block of so many terms of two groups, each (sorted term numbers, counts, N + 2 V)."""
    (small, few, small_of), (large, many, large_of) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    i, j = gallop(small, large)
    p, q = shares(few, small_of), shares(many, large_of)
    p0, q0 = (shares(np.zeros(1, np.int64), n) for n in (small_of, large_of))
    one, other = np.ones(len(p), bool), np.ones(len(q), bool)
    one[i], other[j] = False, False
    neither = terms - len(p) - len(q) + len(i)
    return int(difference(p[i], q[j]).sum() + difference(p[one], q0).sum() + difference(p0, q[other]).sum() + neither * difference(p0, q0)[0])


_PRICED = pa.schema([("lang", pa.string()), ("lower", pa.string()), ("upper", pa.string()), ("value", pa.int64())])


def _price_pair(lower: pa.Table, upper: pa.Table) -> pa.Table:
    """One block of one pair: a row from each side."""
    sides = [(t["ids"].chunk(0).flatten().to_numpy(), t["counts"].chunk(0).flatten().to_numpy(), t["out_of"][0].as_py()) for t in (lower, upper)]
    return pa.table([lower["lang"], lower["lower"], lower["upper"], [price(*sides, lower["terms"][0].as_py())]], schema=_PRICED)


def _share(count: str, out_of: str) -> Column:
    """The same share of two columns as a Spark expression, exact by decimals."""
    return F.expr(f"1 + ({SCALE}BD * cast({count} + 2 as decimal(19,0))) div cast({out_of} as decimal(19,0))")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and an empty term for each group."""
    ship(docs.sparkSession)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    texts = docs.select(*named, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counted = texts.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source)."""
    counts = term_counts(docs)
    terms = counts.filter(F.length("term") > 0)
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = written(kept.select("lang", "term", "all_n"), "kept-terms")
    langs = written(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n")), "kept-languages")
    langs = _small(langs, langs.count())

    in_block = Window.partitionBy("lang", "block").orderBy("term")
    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / F.lit(block_terms))).cast("int")
    numbered = kept.join(langs, "lang").withColumn("block", block).withColumn("id", F.row_number().over(in_block))
    numbered = numbered.withColumn("lang_of", F.col("lang_n") + 2 * F.col("v")).select("lang", "term", "block", "id", "all_n", "lang_of")
    cells = written(terms.join(numbered, ["lang", "term"]).select("lang", "source", "term", "block", "id", "n", "all_n", "lang_of"), "kept-counts")

    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    every = counts.filter(F.length("term") == 0).select("lang", "source")
    groups = every.join(totals, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    out_of = F.coalesce(F.col("group_n"), F.lit(0)) + 2 * F.coalesce(F.col("v"), F.lit(0))
    groups = written(groups.select("lang", "source", out_of.alias("out_of")), "groups")
    groups = _small(groups, groups.count())

    priced = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "out_of").alias("p"), _share("all_n", "lang_of").alias("q")
    )
    over = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    overused = _ranked(over).filter(F.col("rank") <= top).withColumn("item", F.col("item").cast("string"))
    return _ranked(_pairs(cells, groups)).unionByName(overused)


def _ranked(values: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return values.withColumn("rank", F.row_number().over(order))


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, part, item, value): each pair of a language's sources, from either side."""
    blocks = cells.groupBy("lang", "block").agg(F.countDistinct("id").alias("terms"))
    held = F.array_sort(F.collect_list(F.struct("id", "n")))
    arrays = cells.groupBy("lang", "source", "block").agg(held.alias("held"))
    # Each group has a row for each block of its language, so that a block of which it holds nothing is priced as well.
    sides = groups.join(blocks, "lang").join(arrays, ["lang", "source", "block"], "left").select(
        "lang", "source", "block", "terms", "out_of", *[F.coalesce(F.col(f"held.{x}"), F.array().cast(f"array<{kind}>")).alias(name) for x, name, kind in (("id", "ids", "int"), ("n", "counts", "bigint"))]
    )
    others = groups.select("lang", F.col("source").alias("other"))
    paired = sides.join(others, "lang")
    key = ["lang", "block", "lower", "upper"]
    lower = paired.filter("source < other").withColumnsRenamed({"source": "lower", "other": "upper"})
    upper = paired.filter("source > other").withColumnsRenamed({"source": "upper", "other": "lower"})
    upper = upper.toDF(*upper.columns)  # columns of its own, or the two sides of the co-group can't be told apart
    by_block = lower.groupBy(*key).cogroup(upper.groupBy(*key)).applyInArrow(_price_pair, "lang string, lower string, upper string, value long")
    sums = by_block.groupBy("lang", "lower", "upper").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", F.col("source").alias("lower")).join(groups.select("lang", F.col("source").alias("upper")), "lang").filter("lower < upper")
    pairs = written(pairs.join(sums, ["lang", "lower", "upper"], "left").select("lang", "lower", "upper", F.coalesce("value", F.lit(0).cast("long")).alias("value")), "pairs")
    part = F.lit("pair").alias("part")
    return pairs.select("lang", F.col("lower").alias("source"), part, F.col("upper").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("upper").alias("source"), part, F.col("lower").alias("item"), "value")
    )

"""Approximate nearest neighbours by collision counting: single projections, query-centred windows, virtual rehashing.

Nearness is the inner product. Vectors are scaled by the largest norm M and get one more component, which makes all norms 1; queries
are scaled to 1 and get 0 there. The largest inner products of a query are then the smallest distances.

1. Equal vectors are one class with the ``most + 1`` smallest ids of its rows: no further row of it can be among the nearest of any
   query. Queries are classes as well, searched once each.
2. Classes are dealt to blocks of about ``block_rows``. The index has a row for each class: its vector, and its ranks among the block's
   projections on each of ``projections`` random orthonormal directions, which give the sorted arrays. Every class is in it.
3. A query's windows are centred on its own projections. Step by step the radius R grows, and with it each window to the query's
   projection +- ``WIDTH`` R. What the windows gain on either side is read on in the sorted arrays (virtual rehashing) and counted for
   the vectors there. A vector that ``needed`` windows hold is verified: its inner product is computed.
4. A query ends in a block as soon as R reaches the distance of its nearest ``most`` verified so far, in this block or before, or all
   vectors of the block are verified. ``needed`` is the largest number that a vector at distance R reaches with probability ``SURE``
   (binomial): all nearer ones reach it more often, so a true neighbour is lost with a probability of at most 1 - ``SURE``.
5. Each query meets one block first; its nearest there bound the radius in all others. What the blocks find is merged by rank.
   A block is sent once for each span of up to ``SPAN`` chunks of queries, which a task takes one chunk at a time.

Each query meets every block, so the work is that of queries times rows at worst; what a block costs a query falls with the windows
it needs. Scores are sums in double precision over the original components in their order. Nothing is sampled, and no candidate is
left out for being one too many.

Defined cases: vectors that are null or zero, that hold a null or non-finite component or whose squares overflow take no part, as
queries or as candidates; nor do null ids and vectors of another length than most have (the longest if as many have it); repeated
rows, even with one id, are candidates and queries each; a query has fewer neighbours if there are fewer rows; ties go to the smaller
id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import written

MOST = 20
#: 255 at most.
PROJECTIONS = 64
BLOCK_ROWS = 16_384
#: Queries that meet a block together.
QUERY_ROWS = 512
#: Chunks of queries for which a block is sent once, but at least so many tasks are made where there are chunks enough.
SPAN = 32
TASKS = 48
SURE = 0.93
#: Half a window's width at R = 1; a direction shows a distance of 1 with standard deviation 1.
WIDTH = 1.0
#: R begins there, or at this share of the distance that bounds it, and grows by this factor; distances are 2 at most.
FIRST_RADIUS = 0.25
FIRST_SHARE = 0.7
STEP = 1.5
#: Windows that gain less than this part of all places are read on, others are counted anew.
FEW_GAINED = 8
SEED = 20


def needed(projections: int, width: float, sure: float) -> int:
    """The most windows of which a vector at distance R is in so many with probability ``sure``."""
    inside = math.erf(width / math.sqrt(2))
    below = 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * inside**k * (1 - inside) ** (projections - k)
        if below > 1 - sure:
            return k
    return projections


def directions(dimensions: int, projections: int, seed: int = SEED) -> np.ndarray:
    """(projections, dimensions): random orthonormal directions, of as many bases as are needed, scaled so that a direction shows
    a distance of 1 with standard deviation 1."""
    draw, bases = np.random.default_rng(seed), []
    while sum(map(len, bases)) < projections:
        q, r = np.linalg.qr(draw.standard_normal((dimensions, dimensions)))
        bases.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(bases)[:projections] * math.sqrt(dimensions)


def extended(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors scaled by the largest norm, with the component that makes them of length 1."""
    scaled = vectors / norm
    return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))])


def search(
    vectors: np.ndarray, values: np.ndarray, order: np.ndarray, queries: np.ndarray, shown: np.ndarray, limits: np.ndarray,
    norm: float, most: int, least: int,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the verified vectors that may be among its ``most`` nearest, and their inner products.

    values and order: a row for each direction, the sorted projections and whose they are. limits: the inner product of the last of
    the nearest found before, or -inf.
    """
    n, (asked, width) = len(vectors), shown.shape
    scales = np.linalg.norm(queries, axis=1) * norm
    counts, waiting = np.zeros((asked, n), np.uint8), np.ones((asked, n), bool)
    ranks = np.empty((width, n), np.uint16 if n < 1 << 16 else np.uint32)  # places in the sorted arrays, by vector
    np.put_along_axis(ranks, order, np.arange(n, dtype=ranks.dtype)[None, :], 1)
    past, within = np.empty(n, ranks.dtype), np.empty(n, bool)
    hits = within.view(np.uint8)
    low = np.stack([np.searchsorted(values[i], shown[:, i]) for i in range(width)], axis=1)
    high = low.copy()
    found = [(np.empty(0, np.int64), np.empty(0)) for _ in range(asked)]
    bound = np.sqrt(np.maximum(0, 2 - 2 * limits / scales))
    radius = np.where(np.isfinite(bound), np.maximum(FIRST_RADIUS, FIRST_SHARE * bound), FIRST_RADIUS)
    going = np.arange(asked)
    while len(going):
        reach, before_low, before_high = WIDTH * radius[going], low[going], high[going]
        for i in range(width):
            low[going, i] = np.minimum(before_low[:, i], np.searchsorted(values[i], shown[going, i] - reach))
            high[going, i] = np.maximum(before_high[:, i], np.searchsorted(values[i], shown[going, i] + reach, "right"))
        still = []
        for k, q in enumerate(going.tolist()):
            own, sides = counts[q], (low[q], before_low[k], before_high[k], high[q])
            if FEW_GAINED * ((sides[1] - sides[0]).sum() + (sides[3] - sides[2]).sum()) < width * n:
                gained = []
                for wider_low, low_, high_, wider_high, whose in zip(*(x.tolist() for x in sides), order, strict=True):
                    gained += [whose[wider_low:low_], whose[high_:wider_high]]
                own += np.bincount(np.concatenate(gained), minlength=n).astype(np.uint8)
            else:  # where windows gain much, it is less work to look at each vector's places: unsigned, so that lower ones are beyond
                own[:] = 0
                for begin, held, at in zip(low[q].tolist(), (high[q] - low[q]).tolist(), ranks, strict=True):
                    np.subtract(at, at.dtype.type(begin), out=past)
                    np.less(past, held, out=within)
                    np.add(own, hits, out=own)
            reached = np.flatnonzero(waiting[q] & (counts[q] >= least))
            if len(reached):
                waiting[q, reached] = False
                found[q] = tuple(np.concatenate(x) for x in zip(found[q], (reached, vectors[reached] @ queries[q]), strict=True))
            scores = found[q][1]
            nearest = max(limits[q], np.partition(scores, -most)[-most]) if len(scores) >= most else limits[q]
            distance = math.sqrt(max(0.0, 2 - 2 * nearest / scales[q]))
            if distance > radius[q] and len(scores) < n:
                radius[q] = min(radius[q] * STEP, distance)
                still.append(q)
        going = np.array(still, np.int64)
    return [_best(vectors, queries[q], *found[q], most) for q in range(asked)]


def _best(vectors: np.ndarray, query: np.ndarray, places: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of places that reach the last of the nearest but for rounding, with their sums in the order of the components."""
    if len(scores) > most:
        last = np.partition(scores, -most)[-most]
        places = places[scores >= last - 1e-9 * max(abs(last), np.abs(scores).max())]
    exact = np.zeros(len(places))
    for x, column in zip(query, vectors[places].T, strict=True):
        exact += column * x
    return places, exact


_INDEX = "block int, ids array<bigint>, vector array<double>, ranks array<int>"
_FOUND = "class bigint, score double, ids array<bigint>"


def _stacked(lists: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(lists), -1)


def _usable(rows: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, float, int]:
    """(vec_id, vector) of the rows that take part, the largest norm and the number of dimensions."""
    vector = F.col(embedding).cast("array<double>")
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)  # null or not finite if a component is
    fit = rows.select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias("vector"), square.alias("square"))
    fit = fit.filter("vec_id IS NOT NULL AND square > 0 AND square < double('Infinity')")
    lengths = fit.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"), F.max("square").alias("square"))
    top = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    if top is None:
        return fit.select("vec_id", "vector").limit(0), 1.0, 0
    return fit.filter(F.size("vector") == top.n).select("vec_id", "vector"), math.sqrt(top.square), top.n


def nearest(
    rows: DataFrame, every: int = 20, most: int = MOST, vec_id: str = "vec_id", embedding: str = "embedding",
    projections: int = PROJECTIONS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``most`` nearest of each row whose id is divisible by ``every``, among all other rows."""
    spark = rows.sparkSession
    ship(spark)
    fit, norm, dimensions = _usable(rows, vec_id, embedding)
    asks = F.col("vec_id") % every == 0
    if not dimensions:
        return fit.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    first = Window.partitionBy("vector").orderBy("vec_id")
    ids = fit.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = ids.join(fit.groupBy("vector").agg(F.max(asks).alias("asks")), "vector")
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    n, asked = classes.agg(F.count("*"), F.count_if("asks")).first()
    blocks, chunks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(asked / query_rows))
    axes, k, least = directions(dimensions + 1, projections), most + 1, needed(projections, WIDTH, SURE)

    def indexed(table: pa.Table) -> pa.Table:
        shown = extended(_stacked(table["vector"]), norm) @ axes.T
        ranks = np.empty(shown.shape, np.int32)
        np.put_along_axis(ranks, np.argsort(shown, axis=0, kind="stable"), np.arange(len(shown), dtype=np.int32)[:, None], 0)
        listed = pa.ListArray.from_arrays(np.arange(len(shown) + 1, dtype=np.int32) * projections, ranks.ravel())
        return table.select(["block", "ids", "vector"]).append_column("ranks", listed)

    def dealt(name: str, parts: int):
        return F.pmod(F.hash("class"), F.lit(parts)).alias(name)

    index = written(classes.select(dealt("block", blocks), "ids", "vector").groupBy("block").applyInArrow(indexed, _INDEX), "projection-index")
    queries = classes.filter("asks").select(dealt("chunk", chunks), "class", "vector")

    def searched(index: pa.Table, asked: pa.Table) -> pa.Table:
        """A block of the index and the queries of a chunk with what bounds them."""
        if not len(index) or not len(asked):
            return pa.table({"class": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        vectors, names = _stacked(index["vector"]), index["ids"].combine_chunks()
        ranks = _stacked(index["ranks"], np.int32).T
        places = np.empty(ranks.shape, np.intp)
        np.put_along_axis(places, ranks, np.arange(len(vectors))[None, :], 1)
        values = np.take_along_axis((extended(vectors, norm) @ axes.T).T, places, 1)
        every = _stacked(asked["vector"])
        names_of, bounds, out = asked["class"].to_numpy(), asked["bound"].to_numpy(), []
        for begin in range(0, len(every), query_rows):
            own = every[begin : begin + query_rows]
            shown = extended(own / np.linalg.norm(own, axis=1, keepdims=True), 1.0)
            answers = search(vectors, values, places, own, shown @ axes.T, bounds[begin : begin + query_rows], norm, k, least)
            which = np.repeat(names_of[begin : begin + query_rows], [len(p) for p, _ in answers])
            held = names.take(pa.array(np.concatenate([p for p, _ in answers])))
            out.append(pa.table({"class": which, "score": np.concatenate([s for _, s in answers]), "ids": held}))
        return pa.concat_tables(out)

    def met(index: DataFrame, asked: DataFrame) -> DataFrame:
        return index.groupBy("block", "span").cogroup(asked.groupBy("block", "span")).applyInArrow(searched, _FOUND)

    # First each chunk of queries meets one block, then the spans of chunks the others.
    home, spans = F.pmod("chunk", F.lit(blocks)).cast("int"), min(chunks, max(math.ceil(chunks / SPAN), math.ceil(TASKS / blocks)))
    guests = F.explode(F.sequence("block", F.lit(chunks - 1), F.lit(blocks))).alias("span")
    at_home = queries.select("*", home.alias("block"), F.col("chunk").alias("span"), F.lit(-math.inf).alias("bound"))
    found = written(met(index.filter(F.col("block") < chunks).select("*", guests), at_home), "first-neighbours")
    if blocks > 1:
        ranked = _first(found, k)
        bounds = ranked.filter(F.col("rank") == k).select(F.col("class").alias("_class"), F.col("score").alias("bound"))
        bounded = queries.join(bounds, F.col("class") == F.col("_class"), "left").withColumn("bound", F.coalesce("bound", F.lit(-math.inf))).drop("_class")
        span, every_span = F.pmod("chunk", F.lit(spans)).cast("int").alias("span"), F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span")
        others = bounded.select("*", span, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).filter(home != F.col("block"))
        more = met(index.select("*", every_span), others)
        found = _first(found.union(written(more, "other-neighbours")), k)
    # A class's neighbours as rows: its nearest classes first, then their rows one by one.
    each = _first(found, k).select("class", "score", F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    listed = written(each.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near")), "neighbours")
    asking = fit.filter(asks).join(classes.filter("asks").select("vector", "class"), "vector").select(F.col("vec_id").alias("query_id"), "class")
    # The query's own row goes, once; what follows moves up.
    at = F.expr("coalesce(nullif(array_position(transform(near, x -> x.vec_id), query_id), 0), size(near) + 1)")
    rest = F.filter("near", lambda x: x.rank != F.col("at"))
    answered = asking.join(listed, "class").withColumn("at", at).select("query_id", F.posexplode(F.slice(rest, 1, most)).alias("place", "x"))
    return answered.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each class, with their rank."""
    order = Window.partitionBy("class").orderBy(F.desc("score"), F.get("ids", 0))
    return found.select("class", "score", "ids").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

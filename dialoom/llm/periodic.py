"""Periodic run detection: maximal stretches of words that repeat with a period, and texts with each run cut down to one period.

A run is a stretch of consecutive words of smallest period q (words q apart are equal), of at least ``least`` words and ``REPEATS``
periods, that no neighbouring word extends. They are found by string synchronising sets over the word numbers of a text:

1. Periods below ``SMALL_PERIODS`` are found by comparing the text with itself shifted by the period.
2. For tau = 4, 8, 16 ... every substring of tau words has a name, equal exactly where the words are: the pair of names of its halves.
   Only pairs that occur twice go on to the next length.
3. The synchronising set of tau holds place i if the least hash of the names at i to i + tau stands at i or at i + tau. Where tau words
   have a period of at most tau / 3 there is no place to choose: these highly periodic regions lie in runs found for smaller tau, are
   known from there, and take no part in the minima. Membership depends on the 2 tau words from i alone.
4. So a run of period q, 2 tau <= q < 4 tau, has two places of the set q apart with the same 2 tau words. Places with equal contexts are
   more than tau / 3 apart, or the region would be highly periodic: each has fewer than 12 partners within 4 tau, and all are tried.
   Their distances are the proposed periods.
5. A proposal is extended both ways by comparing words. A stretch of q whose smallest period is shorter has been found before.

Several texts are searched at once, with a number between them that occurs nowhere else; word numbers are a text's own. Work is
n log n in the words of a batch, memory a few numbers a word.

Defined cases: null, empty and blank texts have no words, no runs and '' for their collapsed text; a very long text is a batch of its
own and searched whole; runs may overlap or lie within each other, each is listed; repeated rows get equal results; an empty table
gives an empty table; columns ``runs`` and ``collapsed`` of docs are taken over, others pass through, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import free_name, words_of

LEAST_WORDS = 24
REPEATS = 3
#: Shorter periods are found by direct comparison; also twice the smallest tau.
SMALL_PERIODS = 8
#: Texts are searched together until they have so many words.
BATCH_WORDS = 200_000

_NONE = np.uint64(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 63 bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def _named(keys: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of n places and whether a name occurs twice; places without a key, and keys that occur once, get a name of their own."""
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    names, twice = n + np.arange(n), np.zeros(n, bool)
    names[places[again]], twice[places[again]] = inverse[again], True
    return names, twice


def _doubled(names: np.ndarray, twice: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of substrings of twice the length."""
    n = len(names)
    places = np.flatnonzero(twice[: n - length] & twice[length:]) if length < n else np.empty(0, np.int64)
    return _named(names[places] * (2 * n) + names[places + length], places, n)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size < width:
        step = min(size, width - size)
        values = np.minimum(values[:-step], values[step:])
        size += step
    return values


def synchronising_set(names: np.ndarray, tau: int, periodic: np.ndarray) -> np.ndarray:
    """The places of the set among all n - tau; names are those of tau words, periodic marks places outside the minima."""
    values = np.where(periodic, _NONE, _mixed(names))
    if len(values) <= tau:
        return np.empty(0, np.int64)
    least = _window_minima(values, tau + 1)
    return np.flatnonzero((least != _NONE) & ((least == values[:-tau]) | (least == values[tau:])))


def _proposals(places: np.ndarray, contexts: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Sorted (period, place) of places with equal contexts 2 tau to 4 tau apart."""
    order = np.argsort(contexts, kind="stable")
    places, contexts = places[order], contexts[order]
    found = []
    for lag in range(1, len(places)):
        apart = places[lag:] - places[:-lag]
        near = (contexts[lag:] == contexts[:-lag]) & (apart < 4 * tau)
        if not near.any():
            break
        far = near & (apart >= 2 * tau)
        found += zip(apart[far].tolist(), places[:-lag][far].tolist(), strict=True)
    return sorted(found)


def _equal_onward(ids: np.ndarray, at: int, q: int) -> int:
    """The first place from at on whose number differs from that q further."""
    size, end = 64, len(ids) - q
    while at < end:
        stop = min(at + size, end)
        differ = ids[at:stop] != ids[at + q : stop + q]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, size = stop, 2 * size
    return end


def _equal_back(ids: np.ndarray, at: int, q: int) -> int:
    """The smallest place from which all places before at have a number equal to that q further."""
    size = 64
    while at > 0:
        begin = max(at - size, 0)
        differ = (ids[begin:at] != ids[begin + q : at + q])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return at - first
        at, size = begin, 2 * size
    return 0


def _by_comparison(ids: np.ndarray, q: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of stretches equal to those q further, of REPEATS - 1 periods at least."""
    if len(ids) <= q:
        return
    edges = np.flatnonzero(np.diff(np.concatenate(([False], ids[q:] == ids[:-q], [False]))))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= (REPEATS - 1) * q
    yield from zip(begins[long].tolist(), ends[long].tolist(), strict=True)


def all_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of REPEATS periods at least, by start, then period, in an array of numbers."""
    n, found = len(ids), {}
    for q in range(1, SMALL_PERIODS):
        for begin, end in _by_comparison(ids, q):
            found.setdefault((begin, end - begin + q), q)  # a stretch known already has a smaller period
    names, twice = _named(ids, np.arange(n), n)
    length = 1
    while 2 * length < SMALL_PERIODS:
        names, twice = _doubled(names, twice, length)
        length *= 2
    while twice.any():
        tau = length
        periodic = np.zeros(n, bool)
        for (start, size), period in found.items():
            if 3 * period <= tau <= size:
                periodic[start : start + size - tau + 1] = True
        longer, repeated = _doubled(names, twice, tau)
        places = synchronising_set(names, tau, periodic)
        places = places[repeated[places]]
        last, until = 0, -1
        for q, place in _proposals(places, longer[places], tau):
            if q == last and place < until:
                continue
            last, until = q, _equal_onward(ids, place + 2 * tau, q)
            begin = _equal_back(ids, place, q)
            if until - begin >= (REPEATS - 1) * q:
                found.setdefault((begin, until - begin + q), q)
        names, twice, length = longer, repeated, 2 * tau
    return sorted((start, size, q) for (start, size), q in found.items())


def _searched(batch: list[list[bytes]], least: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and collapsed text of each list of words."""
    ids, starts, next_id = [], [], count()
    for words in batch:
        starts.append(len(ids))
        numbers = defaultdict(next_id.__next__)
        ids += map(numbers.__getitem__, words)
        ids.append(next(next_id))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    found = [r for r in all_runs(np.array(ids, np.int64)) if r[1] >= least]
    for (start, length, period), i in zip(found, np.searchsorted(starts, [r[0] for r in found], "right") - 1, strict=True):
        runs[i].append((start - starts[i], length, period))
    for words, own in zip(batch, runs, strict=True):
        if own:
            keep = np.ones(len(words), bool)
            for start, length, period in own:
                keep[start + period : start + length] = False
            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        yield own, b" ".join(words)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """docs with ``runs`` (start, length, period in words, from 0) and ``collapsed``, the words outside runs and of each run's first period.

    A word goes if any run holds it after that run's first period.
    """
    ship(docs.sparkSession)
    docs = docs.drop("runs", "collapsed")
    copy = free_name(docs, "_text")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            answers, batch, size = [], [], 0
            for t in rows.column(copy):
                words = (t.as_py() or b"").split()
                if batch and size + len(words) > BATCH_WORDS:
                    answers += _searched(batch, least)
                    batch, size = [], 0
                batch.append(words)
                size += len(words)
            answers += _searched(batch, least)
            runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own, _ in answers], _RUNS)
            rest = rows.drop_columns([copy])
            yield pa.RecordBatch.from_arrays([*rest.columns, runs, pa.array([c for _, c in answers], pa.binary())], [*rest.schema.names, "runs", copy])

    run = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    schema = T.StructType([*docs.schema.fields, T.StructField("runs", T.ArrayType(run)), T.StructField(copy, T.BinaryType())])
    found = docs.withColumn(copy, F.col(text).cast("binary")).mapInArrow(searched, schema)
    return found.withColumn("collapsed", F.col(copy).cast("string")).drop(copy)


def planted(doc_id: Column, text: Column) -> Column:
    """text, of which a tenth of the ids has a tail that repeats with a period (fixed rule of the test cases)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, at(i))), " "))

    repeated = F.get(F.transform(F.array(words_of(text)), tail), 0)
    return F.when(h % 10 == 0, F.coalesce(repeated, text)).otherwise(text)

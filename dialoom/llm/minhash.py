"""MinHash near-dedup with HyperMinHash sketches.

A document is the set of its distinct word shingles (words of the text with A-Z lower-cased; a text with fewer
words than a shingle is one shingle). Two documents are linked if 100 * |common| >= threshold * |union|.

1. Sketch: one 64-bit hash a shingle. Its first 7 bits choose one of 128 registers, of the rest each register
   keeps the minimum, stored as leading-zero count (6 bits) and the next 10 mantissa bits: two bytes.
2. Documents with the same set (same 128-bit digest of the sorted set) become one class, its smallest id stands
   for it. So exact copies, however many, cost one candidate.
3. Banding: empty registers borrow from filled ones by a fixed table (so that the keys of short texts too hang on several
   shingles); four neighbouring registers make a key, 32 bands. A pair at similarity 0.85 meets in no band with a
   probability of 5e-11, at 0.8 of 5e-8. Sets so small that only equal sets can be linked are not banded.
4. Hubs: each document meets one other, the smallest id over its bands. Confirmed links give first components, in which
   most copies of one text are together after one comparison each. A band whose members are all in one component is done.
5. What is open then: within each open band registers are compared, and documents whose estimate allows a link are connected to
   a pool (a forest of at most as many rows as the band has members; bands of over ``BAND_MEMBERS`` connect all of theirs). So
   chance meetings of unlike documents make no large pools. A pool is cut into blocks of about ``BLOCK`` documents and
   ``BLOCK_SHINGLES`` shingles, by whether they are in its largest component, by size class (linked sets differ by one class at
   most) and by hash; small pools share blocks. Blocks meet blocks, all sets of a block with all of the other at a time in numpy, but not those within
   the largest component; a task has two blocks, and gives the links that connect components, no lists of pairs. So
   thousands of near copies just below the threshold cost blocks squared, not rows squared.
6. In either step the estimate comes first: equal registers over registers filled in either, less the collisions expected
   from the stored bits. A pair whose corrected estimate is over five standard errors below the threshold goes; the others
   are verified on their full sets; links found in blocks, where sets are of hashes, again on the texts' words.
7. Components of confirmed links; the smallest id of each stays.

Defined cases: a null or wordless text has an empty set, links with nothing and stays. Rows that repeat an id
are one document, with the text that sorts first; its decision holds for each of the rows, and each row gets one. Rows with a null
id are kept, unlinked, with the size of their set. Of documents with equal claims the smallest id counts. A very long text is one
row's work; a block has few of them. Extra columns pass through ``dedup``, whatever their names; ``near_duplicates`` has columns of
its own only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import free_name, written
from .components import components

REGISTER_BITS = 7
REGISTERS = 1 << REGISTER_BITS
MANTISSA_BITS = 10
BAND = 4
BANDS = REGISTERS // BAND
#: Documents in a block. A matter of work, not of results.
BLOCK = 256
#: Shingles in a block, and members of a band that are compared one by one. Neither changes results.
BLOCK_SHINGLES = 2_000_000
BAND_MEMBERS = 512
#: Rows of one key in a join are spread over so many tasks.
SALTS = 16
#: Which registers an empty one borrows from, in turn.
_LENDERS = np.random.default_rng(20240101).integers(0, REGISTERS, (REGISTERS, 96))


def words(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z lower-cased; bytes.split() splits at exactly the ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    one = np.array([digest(w) for w in found], np.uint64)
    width = min(size, len(one))
    mixed = np.full(len(one) - width + 1, width, np.uint64)
    for k in range(width):
        mixed ^= one[k : len(one) - width + 1 + k]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: 0 if empty, else (leading zeros + 1) << mantissa bits | mantissa."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(hashes):
        return out
    number = (hashes >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))  # sorted: the first is the minimum
    rest = hashes[first] << np.uint64(REGISTER_BITS)
    lead = np.zeros(len(rest), np.int64)
    left = rest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = left < np.uint64(1 << (64 - step))
        lead += np.where(high, step, 0)
        left = np.where(high, left << np.uint64(step), left)
    lead = np.minimum(lead, 62)
    mantissa = ((rest << (lead + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)).astype(np.uint16)
    out[number[first]] = ((lead + 1) << MANTISSA_BITS).astype(np.uint16) | mantissa
    return out


def band_keys(regs: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band, over registers with the empty ones filled from others."""
    lent = _LENDERS[np.arange(REGISTERS), (regs[_LENDERS] > 0).argmax(axis=1)]
    lent = np.where(regs[lent] > 0, lent, np.flatnonzero(regs)[0])
    source = np.where(regs > 0, np.arange(REGISTERS), lent).astype(np.uint16)
    rows = np.stack([source, regs[source]], axis=1).reshape(BANDS, -1)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(rows)]


def smallest_linkable(percent: int) -> int:
    """The least set size at which an unequal set can be linked: n / (n + 1) >= threshold."""
    return -(-percent // (100 - percent))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and their standard errors' share (registers filled).

    Two unequal minima share leading zeros and mantissa by chance with about 2**-MANTISSA_BITS / 3 a register,
    the more exactly equal the set sizes the nearer to that.
    """
    filled = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    ratio = np.minimum(n_a, n_b) / np.maximum(np.maximum(n_a, n_b), 1)
    chance = 2.0**-MANTISSA_BITS * (2 / 3) * ratio
    share = equal / np.maximum(filled, 1)
    return np.clip((share - chance) / (1 - chance), 0, 1), filled


_SKETCH = "id long, n long, low long, high long, regs binary, bands array<long>"


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, text) -> (id, n, low, high, regs, bands): set size, digest of the set, registers, a key for each band (none for small sets)."""
    least = smallest_linkable(percent)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for number, body in zip(batch.id, batch.text):
                hashes = shingle_hashes(body, size)
                regs = registers(hashes)
                digest = xxhash.xxh3_128_digest(hashes.tobytes())
                low, high = np.frombuffer(digest, np.int64).tolist()
                bands = band_keys(regs) if len(hashes) >= least else []
                rows.append((number, len(hashes), low, high, regs.tobytes(), bands))
            yield pd.DataFrame(rows, columns=["id", "n", "low", "high", "regs", "bands"])

    return docs.select("id", "text").mapInPandas(sketch, _SKETCH)


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those linked: by estimate, then on full sets."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[x]), np.uint16).reshape(-1, REGISTERS) for x in ("regs_a", "regs_b"))
                yield batch.loc[_likely(a, b, batch.n_a.to_numpy(), batch.n_b.to_numpy(), percent), ["a", "b"]]

    return _confirmed(close.mapInPandas(likely, "a long, b long"), texts, size, percent)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full shingle sets are similar enough."""

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[int | None, set] = (None, set())  # neighbouring pairs mostly share the first document
        for batch in batches:
            keep = []
            for a, b, text_a, text_b in zip(batch.a, batch.b, batch.text_a, batch.text_b):
                if last[0] != a:
                    last = a, shingle_set(text_a, size)
                one, two = last[1], shingle_set(text_b, size)
                common = len(one & two)
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.loc[keep, ["a", "b"]]

    body = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(body("a"), "a").join(body("b"), "b").mapInPandas(linked, "a long, b long")


def shingle_set(text: str | None, size: int) -> set:
    """The full set, for verification and tests."""
    found = words(text)
    width = min(size, len(found))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)} if found else set()


def _hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each document with the smallest id it shares a band with."""
    # Written, so that a band held by very many documents only meets its minimum in a join, which Spark can split.
    low = written(members.groupBy("key").agg(F.min("id").alias("hub")), "band-minima")
    met = members.join(low, "key").filter("hub != id").groupBy("id").agg(F.min("hub").alias("hub"))
    return met.select(F.col("hub").alias("a"), F.col("id").alias("b"))


def _salted(table: DataFrame) -> DataFrame:
    """Each row of a table with a row for each key, once for each salt."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_salt(docs: DataFrame) -> DataFrame:
    return docs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))


def possible_links(ids: np.ndarray, component: np.ndarray, n: np.ndarray, regs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest over the members of a band: those whose estimate allows a link, each first with the one that has most."""
    group = np.arange(len(ids))
    out = []
    for i in range(1, len(ids)):
        left = np.flatnonzero((component[:i] != component[i]) & (100 * np.minimum(n[:i], n[i]) >= percent * np.maximum(n[:i], n[i])))
        width = 8
        while len(left):
            # One link with a tree is enough, so what is connected by now is not compared again.
            part, left = left[:width], left[width:]
            width *= 2
            likely = part[_likely(regs[part], np.broadcast_to(regs[i], (len(part), REGISTERS)), n[part], np.full(len(part), n[i]), percent)]
            for tree, at in zip(*np.unique(group[likely], return_index=True)):
                if tree != group[i]:
                    group[group == tree] = group[i]
                    out.append((int(ids[i]), int(ids[likely[at]])))
            left = left[group[left] != group[i]]
    return out


def _open_documents(members: DataFrame, labels: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(id, component, pool): documents in bands that still hold several components; pool: those that possible links connect."""
    own = members.join(labels, members.id == labels.node, "left").select("id", "key", F.coalesce("component", "id").alias("component"))
    own = written(own, "labelled-members")
    several = own.groupBy("key").agg(
        F.min("component").alias("l"), F.max("component").alias("h"), F.min("id").alias("first"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("set")
    ).filter("l != h")
    # Copies share many bands: of bands with the same members one is enough.
    several = written(several.groupBy("first", "members", "set").agg(F.min("key").alias("key")).select("key", "first", "members"), "open-bands")
    held = written(own.join(several, "key").select("key", "id", "component", "first", "members"), "open-members")

    def connect(band: pd.DataFrame) -> pd.DataFrame:
        band = band.sort_values("id")
        regs = np.frombuffer(b"".join(band.regs), np.uint16).reshape(-1, REGISTERS)
        found = possible_links(band.id.to_numpy(), band.component.to_numpy(), band.n.to_numpy(), regs, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    small = held.filter(F.col("members") <= BAND_MEMBERS).join(reps.select("id", "n", "regs"), "id").select("key", "id", "component", "n", "regs")
    edges = small.groupBy("key").applyInPandas(connect, "a long, b long")
    edges = edges.union(held.filter(F.col("members") > BAND_MEMBERS).select(F.col("first").alias("a"), F.col("id").alias("b")))
    pools = components(edges).select(F.col("node").alias("id"), F.col("component").alias("pool"))
    return held.select("id", "component").distinct().join(pools, "id")


def _blocks(open_docs: DataFrame, percent: int) -> DataFrame:
    """(id, component, n, block) and, exploded by it, (meeting): the pairs of blocks each document takes part in."""
    parts = open_docs.groupBy("pool", "component").agg(F.count("*").alias("part"))
    pools = parts.groupBy("pool").agg(F.sum("part").alias("all"), F.max(F.struct("part", "component")).alias("main"))
    sized = _with_salt(open_docs).join(_salted(pools), ["pool", "salt"])
    small = F.col("all") <= BLOCK // 4
    few = open_docs.count() // BLOCK + 1
    # Small pools share cells; their documents meet each other there and nobody else.
    cell = F.struct(
        F.when(small, F.pmod(F.xxhash64("pool"), F.lit(few))).otherwise(F.col("pool")).alias("pool"), small.alias("shared"),
        (~small & (F.col("component") == F.col("main.component")) & (F.col("main.part") > 1)).alias("main"),
        F.when(small, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))).cast("int").alias("size_class"),
    )
    placed = written(sized.withColumn("cell", cell).select("id", "component", "n", "salt", "cell"), "open-cells")
    size = F.greatest(F.count("*") / F.lit(float(BLOCK)), F.sum("n") / F.lit(float(BLOCK_SHINGLES)))
    counts = written(placed.groupBy("cell").agg(F.ceil(size).cast("int").alias("cuts")), "cell-cuts")
    placed = placed.join(_salted(counts), ["cell", "salt"]).select("id", "component", "cell", F.pmod(F.xxhash64("id"), "cuts").cast("int").alias("cut"))
    blocks = counts.select("cell", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    a, b = (blocks.select(F.col("cell.pool").alias("pool"), F.col("cell.shared").alias("shared"), F.struct("cell", "cut").alias(x)) for x in "ab")
    meet = a.join(b, ["pool", "shared"]).filter(
        "a <= b AND abs(a.cell.size_class - b.cell.size_class) <= 1 AND NOT (a.cell.main AND b.cell.main)"
    ).select("a", "b", F.xxhash64("a", "b").alias("meeting"))
    sides = meet.select("meeting", F.col("a").alias("block")).union(meet.select("meeting", F.col("b").alias("block"))).distinct()
    return placed.withColumn("block", F.struct("cell", "cut")).join(sides, "block").select("meeting", "id", "component")


def _likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of registers have an estimate at most five standard errors below the threshold."""
    guess, filled = estimate(a, b, n_a, n_b)
    want = percent / 100
    return guess >= want - 5 * np.sqrt(want * (1 - want) / np.maximum(filled, 1))


def block_links(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], regs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the sets of some hundred documents that connect different components: a forest of them."""
    count = np.array([len(x) for x in sets])
    small, large = np.minimum.outer(count, count), np.maximum.outer(count, count)
    ask = (component[:, None] != component[None, :]) & (100 * small >= percent * large) & np.tri(len(ids), k=-1, dtype=bool)
    rows, cols = np.nonzero(ask)
    keep = []
    for at in range(0, len(rows), 1 << 16):
        i, j = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
        keep.append(_likely(regs[i], regs[j], count[i], count[j], percent))
    likely = np.concatenate(keep) if keep else np.zeros(0, bool)
    rows, cols = rows[likely], cols[likely]
    if not len(rows):
        return []
    used = np.unique(np.concatenate((rows, cols)))
    place = np.full(len(ids), -1)
    place[used] = np.arange(len(used))
    hashes = np.concatenate([sets[k] for k in used])
    owner = np.repeat(np.arange(len(used)), count[used])
    word, times = np.unique(hashes, return_inverse=True, return_counts=True)[1:]
    shared = times[word] > 1  # a shingle of one document alone is in no intersection
    number = np.cumsum(times > 1) - 1
    word, owner = number[word[shared]], owner[shared]
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    common = np.zeros((len(used), len(used)), np.float32)
    for low in range(0, int(word[-1]) + 1 if len(word) else 0, 8192):
        a, b = np.searchsorted(word, (low, low + 8192))
        has = np.zeros((len(used), 8192), np.float32)
        has[owner[a:b], word[a:b] - low] = 1
        common += has @ has.T
    both = common[place[rows], place[cols]].astype(np.int64)
    linked = 100 * both >= percent * (count[rows] + count[cols] - both)
    group = {int(c): int(c) for c in np.unique(component)}

    def top(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    out = []
    for i, j in zip(rows[linked], cols[linked]):
        x, y = top(int(component[i])), top(int(component[j]))
        if x != y:
            group[max(x, y)] = min(x, y)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _block_edges(open_docs: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links between the documents that are still apart, block by block."""
    meetings = _blocks(open_docs.join(reps.select("id", "n"), "id"), percent)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch.id, "set": [shingle_hashes(t, size).tobytes() for t in batch.text]})

    sets = texts.join(open_docs.select("id"), "id").select("id", "text").mapInPandas(cut, "id long, set binary")
    rows = meetings.join(sets, "id").join(reps.select("id", "regs"), "id")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id").drop_duplicates("id")
        regs = np.frombuffer(b"".join(block.regs), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(x, np.uint64) for x in block.set]
        return pd.DataFrame(block_links(block.id.to_numpy(), block.component.to_numpy(), sets, regs, percent), columns=["a", "b"], dtype="int64")

    return _confirmed(rows.groupBy("meeting").applyInPandas(compare, "a long, b long").distinct(), texts, size, percent)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component): a row for each row of docs; without id there is no component."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    numbered = rows.filter("id IS NOT NULL")
    repeated = not numbered.groupBy("id").count().filter("count > 1").isEmpty()
    if repeated:
        numbered = numbered.groupBy("id").agg(F.min("text").alias("text"))
    every = written(sketches(numbered, size, percent), "sketches")
    classes = every.filter("n > 0").groupBy("low", "high").agg(F.min(F.struct("id", "n", "regs", "bands")).alias("rep"))
    reps = written(classes.select("rep.*", "low", "high"), "classes")
    spread = reps.select("id", F.explode("bands").alias("key"))
    met = spread.groupBy("key").agg(F.min("id").alias("low_id"), F.max("id").alias("high_id")).filter("low_id != high_id").select("key")
    met = written(met, "shared-bands")
    members = written(spread.join(met, "key", "left_semi"), "band-members")
    # Verification reads the texts of documents that share a band, no others.
    texts = written(numbered.join(members.select("id").distinct(), "id", "left_semi"), "candidate-texts")
    hubs = written(_verified(_hub_pairs(members), reps, texts, size, percent), "hub-links")
    labels = written(components(hubs), "labels")
    open_docs = written(_open_documents(members, labels, reps, percent), "open-documents")
    if not open_docs.isEmpty():
        rest = written(_block_edges(open_docs, reps, texts, size, percent), "block-links")
        labels = written(components(hubs.union(rest)), "labels")
    joined = every.join(reps.select("low", "high", F.col("id").alias("rep")), ["low", "high"], "left")
    final = joined.join(labels, joined.rep == labels.node, "left")
    final = final.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component"))
    unnumbered = sketches(rows.filter("id IS NULL"), size, percent).select("id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"))
    return (rows.filter("id IS NOT NULL").select("id").join(final, "id") if repeated else final).union(unnumbered)


def dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the rows of the smallest doc_id stay, all columns as they are."""
    mark = free_name(docs, "_gone")
    gone = near_duplicates(docs, size, percent).filter("id != component").select(F.col("id").alias(mark)).distinct()
    return docs.join(gone, docs.doc_id == gone[mark], "left_anti")

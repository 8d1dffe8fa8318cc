import random

import numpy as np

from dialoom.llm import minhash
from dialoom.llm.components import components

DOCS = "doc_id long, text string"


def brute(rows, size, percent):
    sets = {d: minhash.shingle_set(t, size) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            one, two = sets[a], sets[b]
            if one and two and 100 * len(one & two) >= percent * len(one | two):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    """Bases with chains of copies below and above the threshold, a common passage, exact copies, tiny texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(5))
    passage = [word() for _ in range(12)]
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(draw.choice((6, 20, 60, 150)))]
        for _ in range(draw.randint(1, 14)):
            copy = list(base)
            for _ in range(draw.choice((0, 0, 1, 2, 4))):
                copy[draw.randrange(len(copy))] = word()
            if draw.random() < 0.3:
                base = copy
            rows.append((n, " ".join(passage + copy if draw.random() < 0.5 else copy)))
            n += 1
    return rows + [(n + i, t) for i, t in enumerate(["a", "A", "a b", "", None, "x y z", "x\ty\nz"])]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)  # so that pools are cut into several blocks
    for seed, size, percent, members in ((1, 3, 85, 512), (2, 5, 80, 3)):
        monkeypatch.setattr(minhash, "BAND_MEMBERS", members)  # and that bands are beyond what is compared one by one
        rows = corpus(seed)
        found = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), size, percent).collect()
        assert {r.id: (r.n_shingles, r.component) for r in found} == brute(rows, size, percent)


def test_dense_group_below_and_above_the_threshold(spark):
    """Hundreds of copies of one text with edits, of which most pairs are just below the threshold."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(draw.choice((1, 2, 5, 6, 7))):
            copy[draw.randrange(120)] = f"e{draw.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).collect()
    assert {r.id: (r.n_shingles, r.component) for r in found} == brute(rows, 3, 85)


def test_edges(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(1, text, 1), (1, text, 2), (2, text.upper(), 3), (3, None, 4), (None, text, 5), (4, "", 6), (5, "one two", 7), (5, "three four five six seven", 8), (6, "p q r " * 60_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component int")
    kept = sorted((r.doc_id is None, r.doc_id, r.component) for r in minhash.dedup(docs).collect() if r.doc_id is not None)
    assert [(d, c) for _, d, c in kept] == [(1, 1), (1, 2), (3, 4), (4, 6), (5, 7), (5, 8), (6, 9)]
    assert minhash.dedup(docs).filter("doc_id IS NULL").count() == 1
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    every = sorted(((r.id is None, r.id, r.n_shingles, r.component) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert every == sorted(
        [(False, 1, 36, 1)] * 2 + [(False, 2, 36, 1), (False, 3, 0, 3), (True, None, 36, None), (False, 4, 0, 4)] + [(False, 5, 1, 5)] * 2 + [(False, 6, 3, 6)], key=str
    )  # a row for each row


def test_possible_links_are_a_forest_that_holds_every_possible_pair():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: 400 - cut], draw.integers(0, 2**63, cut).astype(np.uint64)))) for cut in draw.integers(0, 300, 40)]
    regs, n = np.stack([minhash.registers(x) for x in sets]), np.array([len(x) for x in sets])
    ids, component = np.arange(40), np.arange(40) // 2
    found = minhash.possible_links(ids, component, n, regs, 85)
    top = {i: {i} for i in range(40)}
    for a, b in found:
        assert component[a] != component[b] and top[a] is not top[b]
        for x in (both := top[a] | top[b]):
            top[x] = both
    for i in range(40):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (n[i] + n[j] - common) and component[i] != component[j]:
                assert top[i] is top[j]


def test_estimate_and_registers():
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:2400]), np.unique(pool[400:2800])
    regs = [minhash.registers(x)[None, :] for x in (a, b)]
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    guess, filled = minhash.estimate(*regs, np.array([len(a)]), np.array([len(b)]))
    assert abs(guess[0] - true) < 0.15 and filled[0] == minhash.REGISTERS
    one = minhash.registers(np.array([1 << 50], np.uint64))
    assert (one > 0).sum() == 1 and (one[0] >> 10) == 64 - 7 - 51 + 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (102, 101), (101, 100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

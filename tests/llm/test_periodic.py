import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dialoom.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute_runs(ids, repeats=3):
    """Every maximal stretch by its smallest period, from the definition."""
    n, found = len(ids), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j - i >= (repeats - 1) * q:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, size, q) for (a, size), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120))
def test_equals_brute_force_on_few_words(ids):
    assert periodic.all_runs(np.array(ids, np.int64)) == brute_runs(ids)


@pytest.mark.parametrize("seed", range(60))
def test_equals_brute_force_on_nested_repeats(seed):
    """Repeats of repeats, with a changed word here and there: periodic units whose parts are highly periodic."""
    r = random.Random(seed)
    ids = [r.randrange(4) for _ in range(r.randrange(1, 6))]
    for _ in range(r.randrange(2, 5)):
        ids = ids * r.randrange(1, 6) + [r.randrange(6) for _ in range(r.randrange(4))]
        if r.random() < 0.5:
            ids += [9] * r.randrange(1, 60)
        ids = ids[:1500]
    ids = ids * 4
    if r.random() < 0.5:
        ids[r.randrange(len(ids))] = 77
    assert periodic.all_runs(np.array(ids, np.int64)) == brute_runs(ids)


def test_fibonacci_and_single_letters():
    a, b = [0], [0, 1]
    for _ in range(11):
        a, b = b, b + a
    assert periodic.all_runs(np.array(b, np.int64)) == brute_runs(b)
    assert periodic.all_runs(np.zeros(5000, np.int64)) == [(0, 5000, 1)]
    assert periodic.all_runs(np.arange(5000)) == [] and periodic.all_runs(np.empty(0, np.int64)) == []


def expected(doc_id, text):
    """The query's row, word by word."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = [x for x in brute_runs(words) if x[1] >= 24]
    keep = [not any(s + q <= i < s + size for s, size, q in runs) for i in range(n)]
    best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(" ".join(w for w, k in zip(words, keep) if k)))


def test_query_equals_brute_force(spark):
    got = queries.op13_periodic_runs(spark, SF).collect()
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in texts if len((r.text or "").split()) < 1500}
    assert len(got) == len(texts) and len(short) > 150
    assert sorted(tuple(r) for r in got if r.doc_id in short) == sorted(expected(*x) for x in short.items())


def test_batches_of_texts_do_not_touch(spark, monkeypatch):
    texts = ["a b c " * 9, None, "", " \n ", "a b c " * 9, "x " * 30 + "y " * 24 + "z", "word " * 200_000, "é b\x0bc\x1cd " * 12]
    docs = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, runs string").coalesce(1)
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(docs).collect()}
    assert got[0] == got[4] == ([(0, 27, 3)], "a b c")
    assert got[1] == got[2] == got[3] == ([], "")
    assert got[5] == ([(0, 30, 1), (30, 24, 1)], "x y z")
    assert got[6] == ([(0, 200_000, 1)], "word")
    assert got[7] == ([(0, 36, 3)], "é b c\x1cd")
    assert periodic.find_runs(docs.limit(0)).collect() == []

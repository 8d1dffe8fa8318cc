"""Word assignment against a word-by-word model over the whole table."""

import os

import pytest

from dialoom.operators import words
from dialoom.plans import interval_queries, views

SF = "/root/testdata/sf0.001"


def by_hand(spoken, chunks, switch=0.4, pause=0.8):
    """(speaker, chunk) of each (word_ord, start, end), sorted by start, by trying all predecessors; chunks (ord, speaker, start, end) in order."""
    over = lambda a, b, c: max(0.0, min(b, c[3]) - max(a, c[2]))
    far = lambda t, c: c[2] - t if t < c[2] else max(0.0, t - c[3])
    names = sorted({c[1] for c in chunks})
    gain = []
    for _, a, b in spoken:
        g = {n: sum(over(a, b, c) for c in chunks if c[1] == n) / max(b - a, 1e-6) for n in names}
        if not any(g.values()):
            g[min(chunks, key=lambda c: far((a + b) / 2, c))[1]] = 1.0
        gain.append(g)
    best, back = [dict(gain[0])], []
    for i in range(1, len(spoken)):
        cost = 0.0 if spoken[i][1] - spoken[i - 1][2] > pause else switch
        came = {n: max(names, key=lambda p: (best[-1][p] - (cost if p != n else 0.0), p == n)) for n in names}
        back.append(came)
        best.append({n: best[-1][came[n]] - (cost if came[n] != n else 0.0) + gain[i][n] for n in names})
    path = [max(names, key=lambda n: best[-1][n])]
    for came in reversed(back):
        path.append(came[path[-1]])
    out = []
    for (o, a, b), n in zip(spoken, reversed(path)):
        own = [c for c in chunks if c[1] == n]
        top = max(own, key=lambda c: over(a, b, c))
        out.append((o, n, (top if over(a, b, top) > 0 else min(own, key=lambda c: far((a + b) / 2, c)))[0]))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_query_equals_the_model_over_the_whole_table(spark):
    got = interval_queries.word_paths(spark, SF).collect()
    rows = views.on_one_clock(spark, SF).collect()
    want = []
    for clip in {r.clip_id for r in rows}:
        own = sorted((r for r in rows if r.clip_id == clip), key=lambda r: (r.start, r.seg_ord))
        chunks = [(r.seg_ord, r.speaker, r.start, r.end) for r in own]
        want += [(clip, *x) for x in by_hand([(r.seg_ord, r.start + 20, r.start + 35) for r in own], chunks)]
    assert all(r.chunk_ord is not None for r in got)
    assert sorted((r.clip_id, r.word_ord, r.speaker, r.chunk_ord) for r in got) == sorted(want)


def test_words_in_gaps_and_beyond(spark):
    chunks = spark.createDataFrame([(0, 0, "A", 0.0, 2.0), (0, 1, "B", 10.0, 12.0), (1, 0, "A", 0.0, 1.0)], "clip_id long, chunk_ord long, speaker string, start double, end double")
    spoken = spark.createDataFrame(
        [(0, 0, 0.5, 1.0), (0, 1, 4.0, 4.4), (0, 2, 8.0, 8.4), (0, 3, 11.0, 11.2), (0, 4, 50.0, 50.5), (1, 0, 7.0, 7.2), (2, 0, 0.0, 1.0)],
        "clip_id long, word_ord long, start double, end double",
    )
    got = {(r.clip_id, r.word_ord): (r.speaker, r.chunk_ord) for r in words.assign_words(spoken, chunks, ["clip_id"]).collect()}
    assert got == {(0, 0): ("A", 0), (0, 1): ("A", 0), (0, 2): ("B", 1), (0, 3): ("B", 1), (0, 4): ("B", 1), (1, 0): ("A", 0), (2, 0): (None, None)}

import math

import numpy as np
import pytest

from dialoom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label string"


def brute(rows, every, most):
    """(query_id, rank, vec_id) by comparing each query with each other row."""
    fit = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows]
    out = []
    for at, (q, x) in enumerate(fit):
        if q % every == 0:
            others = sorted((-sum(float(a) * float(b) for a, b in zip(x, y)), i) for k, (i, y) in enumerate(fit) if k != at)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(others[:most], 1)]
    return sorted(out)


def recall(got, want):
    return len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in want}) / len(want)


@pytest.mark.parametrize("kind", ["even", "clustered", "lengths"])
def test_recall_over_many_blocks(spark, kind):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((1500, 24))
    if kind == "clustered":
        x = x * 0.2 + draw.standard_normal((12, 24))[draw.integers(0, 12, 1500)]
    if kind == "lengths":
        x *= draw.lognormal(0, 1, (1500, 1))
    rows = [(i, [float(v) for v in row], "s") for i, row in enumerate(x.astype(np.float32))]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), block_rows=200, query_rows=16).collect()
    want = brute(rows, 20, 20)
    assert len(got) == len(want) == 75 * 20 and recall(got, want) >= 0.95
    scores = {(q, i): s for q, _, i, s in brute(rows, 20, 1499)}
    assert all(abs(r.score - scores[r.query_id, r.vec_id]) < 1e-12 for r in got)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(x == sorted(x) for x in by.values())


def test_copies_ties_and_small_tables(spark):
    """Half of the rows are one vector: their ids are the neighbours, smallest first, without the query's own."""
    rows = [(i, [1.0, 0.5], "s") for i in range(300)] + [(300 + i, [math.cos(i), math.sin(i)], "s") for i in range(300)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), every=10, most=7, block_rows=64, query_rows=8).collect()
    want = brute(rows, 10, 7)
    assert len(got) == len(want) and recall(got, want) >= 0.95
    copies = lambda found: sorted(x[:3] for x in map(tuple, found) if x[0] < 300)
    assert copies(got) == copies(want)
    few = spark.createDataFrame([(0, [1.0, 0.0], "s"), (20, [0.0, 2.0], "s"), (3, [3.0, 1.0], "s")], SCHEMA)
    assert sorted(tuple(r) for r in neighbours.nearest(few).collect()) == [(0, 1, 3, 3.0), (0, 2, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.0)]


def test_vectors_that_take_no_part(spark):
    odd = [
        (0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "twice"), (20, None, "b"), (40, [0.0, 0.0], "c"), (60, [1.0, None], "d"), (80, [float("nan"), 1.0], "e"),
        (100, [float("inf"), 1.0], "f"), (None, [1.0, 1.0], "g"), (5, [2.0, 5.0], "h"), (120, [1.0, 2.0, 3.0], "i"), (140, [], "j"), (6, [-1.0, 0.0], "k"),
    ]
    df = spark.createDataFrame(odd, SCHEMA)
    got = sorted(tuple(r) for r in neighbours.nearest(df).collect())
    one = [(0, 1, 5, 2.0), (0, 2, 0, 1.0), (0, 3, 6, -1.0)]
    assert got == sorted(one * 2)
    assert neighbours.nearest(df.limit(0)).collect() == [] and neighbours.nearest(df.filter("vec_id = 40")).collect() == []


def test_needed_is_a_binomial_quantile():
    inside = math.erf(1 / math.sqrt(2))
    draw = np.random.default_rng(1).binomial(64, inside, 200_000)
    assert (draw >= neighbours.needed(64, 1.0, 0.97)).mean() >= 0.97 > (draw >= neighbours.needed(64, 1.0, 0.97) + 1).mean()


def test_index_has_small_rows_and_spans_of_any_size_agree(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.standard_normal((300, 6)))], "vec_id long, embedding array<double>")
    kept, sizes = neighbours.written, {}

    def watched(df, name):
        out = kept(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(neighbours, "written", watched)
    answers = []
    for span, tasks in ((1, 1), (3, 1), (32, 48)):
        monkeypatch.setattr(neighbours, "SPAN", span)
        monkeypatch.setattr(neighbours, "TASKS", tasks)
        answers.append(sorted(map(tuple, neighbours.nearest(rows, every=5, most=4, block_rows=64, query_rows=8).collect())))
        assert sizes["projection-index"] == 300  # a row for each vector, not one for each block
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 60 * 4

from pyspark.sql import functions as F

from dialoom.llm import mixing

DOCS = "doc_id long, text string, source string"


def rows(n):
    sources = ["a", "b", "c", "d", None]
    return [(i, " ".join(["w"] * (i % 17)) or None, sources[0 if i % 3 == 0 else i % 5]) for i in range(n)]


def waterfill(sizes, weights, total, most):
    """Targets by the contract's own rounds: share by weight, stop at the limit, share the excess again."""
    target, open_, left = {}, dict(weights), total
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if most * sizes[s] < level * open_[s]]
        if not full:
            return target | {s: level * w for s, w in open_.items()}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_targets_taken_and_order(spark):
    docs = spark.createDataFrame(rows(600), DOCS)
    for slice_rows in (50, None):
        out = mixing.curriculum(docs, slice_rows=slice_rows).collect()
        sizes = {}
        for r in out:
            sizes[r.source] = sizes.get(r.source, 0) + r.size
        want = waterfill(sizes, dict(zip(["a", "b", "c", "d", None], (5, 2, 1, 5, 2))), 1.5 * sum(sizes.values()), 2)
        for s in sizes:
            taken = sum(r.size * r.times for r in out if r.source == s)
            target = next(r.target for r in out if r.source == s)
            assert abs(target - want[s]) < 1e-6 and abs(taken - target) <= 17
        assert all(r.times <= 2 and len(r.positions) == r.times and all(0 <= p <= 1 for p in r.positions) for r in out)
        mine = sorted((r.doc_id, r.times, tuple(round(p, 9) for p in r.positions)) for r in out)
        assert slice_rows == 50 or mine == first
        first = mine


def test_schedule_is_followed(spark):
    """A source whose weight falls from 1.5 to 0.5 has trained (1.5 t - t^2 / 2) of its target by t."""
    docs = spark.createDataFrame([(i, "w w w w", "a") for i in range(4000)], DOCS)
    out = mixing.curriculum(docs, schedules=((1.5, 0.5),)).select(F.explode("positions").alias("p"))
    total = out.count()
    for t in (0.25, 0.5, 0.75):
        assert abs(out.filter(F.col("p") <= t).count() / total - (1.5 * t - t * t / 2)) < 0.01


def test_training_order_and_edges(spark):
    extra = [(1, "a b", "s", 5, "q"), (1, "a b", "s", 6, "q"), (2, None, "s", 7, "q"), (None, "c d e", None, 8, "q"), (3, "", "t", 9, "q")]
    docs = spark.createDataFrame(extra, DOCS + ", size int, times string")
    out = mixing.training_order(docs)
    assert out.columns == docs.columns
    got = sorted(r["size"] for r in out.collect())
    assert set(got) <= {5, 6, 8} and got
    assert mixing.training_order(docs.limit(0)).count() == 0
    assert mixing.curriculum(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None, "s")], DOCS)
    assert mixing.curriculum(nothing).first().times == 0


def test_query_rows_are_range_sorted(spark):
    docs = spark.createDataFrame(rows(600), DOCS)
    out = [r.positions for r in mixing.ordered(docs).collect()]
    firsts = [p[0] for p in out if p]
    assert firsts == sorted(firsts) and all(not p for p in out[len(firsts):]) and all(p == sorted(p) for p in out)


def test_very_long_and_equal_rows(spark):
    docs = spark.createDataFrame([(1, "w " * 500_000, "a", 1), (2, "w", "b", 2), (2, "w", "b", 2)], DOCS + ", _slice int")
    out = mixing.curriculum(docs).collect()
    assert sorted(r["size"] for r in out) == [1, 1, 500_000] and all(r.size * r.times <= 2 * r.size for r in out)

"""Hand-worked cases and sequential models of the interval operators."""

import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from dialoom.operators import frames, range_join, segments

SEG = "clip_id long, seg_ord long, speaker string, start double, end double"


def seg(spark, items):
    return spark.createDataFrame([(0, i, s, float(a), float(b)) for i, (s, a, b) in enumerate(items)], SEG)


E01 = [("A", 0, 1), ("A", 1.4, 2), ("B", 2.1, 3), ("A", 3.1, 4), ("A", 4.5, 5)]


def test_merge_with_inclusive_gap(spark):
    out = segments.merge_chunks(seg(spark, E01), 0.5).orderBy("chunk_ord").collect()
    assert [(r.chunk_id, r.speaker, r.start, r.end, r.source_segment_count) for r in out] == [
        ("chunk_0001", "A", 0, 2, 2), ("chunk_0002", "B", 2.1, 3, 1), ("chunk_0003", "A", 3.1, 5, 2)]


def test_merge_takes_the_running_end(spark):
    out = segments.merge_chunks(seg(spark, [("A", 0, 5), ("A", 1, 2), ("A", 5.3, 6)]), 0.5).collect()
    assert [(r.start, r.end, r.source_segment_count) for r in out] == [(0, 6, 3)]
    out = segments.merge_chunks(seg(spark, [("A", 0, 5), ("A", 1, 2), ("A", 5.3, 6)]), 0.5, last_end=True).collect()
    assert len(out) == 2


def test_length_cap(spark):
    assert segments.merge_chunks_capped(seg(spark, E01), 0.5, 1.5).count() == 5
    assert segments.merge_chunks_capped(seg(spark, E01), 0.5, 100.0).count() == 3


def test_sandwich(spark):
    rows = seg(spark, [("A", 0, 1), ("B", 1.1, 1.3), ("A", 1.4, 2)])
    assert [r.speaker for r in segments.sandwich(rows).collect()] == ["A"] * 3
    assert "B" in [r.speaker for r in segments.sandwich(rows, 0.05).collect()]


def test_entropy(spark):
    out = segments.structure_profile(seg(spark, [("A", 0, 1), ("B", 1, 2)])).first()
    assert (out.entropy, out.entropy_share, out.n_switches) == (1.0, 1.0, 1)


def test_stabilise_equals_a_sequential_model(spark):
    draw = random.Random(1)
    items, t = [], 0.0
    for i in range(300):
        t += draw.choice((0.0, 0.1, 0.5))
        end = t + draw.choice((0.2, 0.3, 0.8, 2.0))
        items.append((draw.choice("ABC"), t, end))
        t = end
    got = segments.stabilise(seg(spark, items)).orderBy("start").collect()
    want = segments.stabilised([[i, s, a, b] for i, (s, a, b) in enumerate(items)], 0.4, 0.3, 1.0, 0.3, 0.3, 4)
    assert [(r.speaker, r.start, r.end) for r in got] == [(s, a, b) for _, s, a, b in want]
    assert len(want) < 300


def test_lenient_reading_drops_bad_rows(spark):
    rows = spark.createDataFrame([("1", "2"), ("x", "3"), ("4", "4"), ("NaN", "5"), ("Infinity", "6"), (None, "1"), ("0.1234567", "0.5")], "start string, end string")
    assert [(r.start, r.end) for r in segments.lenient(rows).collect()] == [(1.0, 2.0), (0.123457, 0.5)]


def test_error_rates_by_hand(spark):
    ref, pred = seg(spark, [("A", 0, 1), ("B", 1, 2)]), seg(spark, [("x", 0, 1.5), ("y", 1.5, 2)])
    out = frames.error_report(ref, pred, ["clip_id"], step=0.5, collar=0.0).first()
    assert (out.confusion, out.correct, out.der, out.accuracy, out.count_error) == (0.5, 1.5, 0.25, 0.75, 0)


def best_total(counts):
    """The largest total of a one-to-one mapping, by trying all."""
    rows, cols = sorted({a for a, _, _ in counts}), sorted({b for _, b, _ in counts})
    value = {(a, b): v for a, b, v in counts}
    few, many, turned = (rows, cols, False) if len(rows) <= len(cols) else (cols, rows, True)
    return max(sum(value.get((y, x) if turned else (x, y), 0.0) for x, y in zip(few, chosen)) for chosen in permutations(many, len(few)))


@pytest.mark.parametrize("seed", range(40))
def test_best_mapping_equals_all_permutations(seed):
    draw = random.Random(seed)
    rows, cols = draw.randint(1, 6), draw.randint(1, 6)
    counts = [(f"p{i}", f"r{j}", float(draw.choice((draw.randint(0, 5), draw.random())))) for i in range(rows) for j in range(cols) if draw.random() < 0.8] or [("p", "r", 1.0)]
    found = frames.best_mapping(counts)
    value = {(a, b): v for a, b, v in counts}
    assert len(set(found.values())) == len(found) and all(value[x] > 0 for x in found.items())
    assert abs(sum(value[x] for x in found.items()) - best_total(counts)) < 1e-9


def test_best_mapping_where_the_largest_first_is_wrong():
    """12 labels in a ring: taking the largest count first gets 10 of each pair of neighbours, the best mapping 9 + 9."""
    counts = [(f"p{i:02d}", f"r{i:02d}", 9.0) for i in range(12)] + [(f"p{i:02d}", f"r{i + 1:02d}", 10.0) for i in range(0, 12, 2)]
    assert frames.best_mapping(counts) == {f"p{i:02d}": f"r{i:02d}" for i in range(12)}
    assert frames.best_mapping([("a", "x", 2.0), ("a", "y", 3.0), ("b", "y", 4.0)]) == {"a": "x", "b": "y"}


def brute_fuse(a, b, fps):
    """Two models' (speaker, start, end) lists fused frame by frame."""
    n = int(max(x[2] for x in a + b) * fps) + 1
    at = []
    for rows in (a, b):
        line = [None] * n
        for s, x, y in rows:
            for f in range(int(x * fps), min(n, int(y * fps) + 1)):
                line[f] = s
        at.append(line)
    pairs = Counter((x, y) for x, y in zip(*at) if x and y)
    to = {}
    for (x, y), _ in sorted(pairs.items(), key=lambda p: -p[1]):
        to.setdefault(y, x)
    for s, x, y in b:
        if s not in to:
            to[s] = at[0][min((f for f in range(n) if at[0][f]), key=lambda f: abs(f - int((x + y) / 2 * fps)))]
    line = [x or to.get(y, y) for x, y in zip(*at)]
    runs = []
    for f, s in enumerate(line):
        if s and f and line[f - 1] == s:
            runs[-1][2] = round((f + 1) / fps, 3)
        elif s:
            runs.append([s, round(f / fps, 3), round((f + 1) / fps, 3)])
    size = Counter()
    for s, x, y in runs:
        size[s] += int((y - x) * fps)
    minor = {s for s in size if size[s] < 30 or size[s] / (sum(size.values()) or 1) < 0.03}
    if minor:
        major = [r for r in map(list, runs) if r[0] not in minor]
        for r in runs:
            if r[0] in minor and major:
                r[0] = min(major, key=lambda m: abs((m[1] + m[2]) / 2 - (r[1] + r[2]) / 2))[0]
        merged = []
        for r in runs:
            if merged and merged[-1][0] == r[0]:
                merged[-1][2] = r[2]
            else:
                merged.append(r)
        runs = merged
    names = {s: f"SPEAKER_{i:02d}" for i, s in enumerate(sorted({r[0] for r in runs}))}
    out = []
    for s, x, y in runs:
        if out and y - x < 0.3:
            out[-1][2] = y
        else:
            out.append([names[s], x, y])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("seed", range(4))
def test_fusion_equals_frame_by_frame(spark, seed):
    draw = random.Random(seed)

    def model(labels, n):
        rows, t = [], draw.random() * 3
        for _ in range(n):
            length = draw.choice((0.04, 0.1, 0.2, 0.6, 2.0, 5.0))
            rows.append((draw.choice(labels), round(t, 3), round(t + length, 3)))
            t += length + draw.choice((0.0, 0.0, 0.1, 1.0, 4.0, -0.3))
        return sorted(rows, key=lambda r: r[1])

    a, b = model("AAABBC", 30), model("xxyz", 40) + [("w", 400.0, 400.1)]
    want = brute_fuse(a, b, 25.0)
    got = frames.fuse(seg(spark, a), seg(spark, b), ["clip_id"]).orderBy("seg_ord").collect()
    assert [(r.speaker, r.start, r.end) for r in got] == want
    alone = frames.fuse(seg(spark, a), seg(spark, []), ["clip_id"]).orderBy("seg_ord").collect()
    assert [(r.speaker, r.start, r.end) for r in alone] == a


@pytest.mark.parametrize("width", [0.7, 3.0, 50.0])
def test_overlap_join_equals_brute_force(spark, width):
    draw = random.Random(2)
    make = lambda n: [("S", a := draw.uniform(0, 40), a + draw.uniform(0.01, 9)) for _ in range(n)]
    left, right = make(60), make(60)
    met = range_join.overlap_join(seg(spark, left), seg(spark, right), ["clip_id"], width).select("seg_ord", "r_seg_ord").collect()
    want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[1] < y[2] and y[1] < x[2]}
    assert len(met) == len(want) and {(r.seg_ord, r.r_seg_ord) for r in met} == want
    kept = range_join.overlap_join(seg(spark, left), seg(spark, [("S", 100, 101)]), ["clip_id"], width, how="left").collect()
    assert len(kept) == 60 and all(r.r_speaker is None for r in kept)


def test_empty_tables(spark):
    none = seg(spark, [("A", 0, 1)]).limit(0)
    for f in (segments.merge_chunks, segments.structure_profile, segments.sandwich, segments.stabilise, segments.boundaries):
        assert f(none).count() == 0
    assert segments.gaps(none, 1.0, total=F.lit(3.0)).count() == 0


def test_union_interpolation_and_cuts(spark):
    rows = seg(spark, [("A", 0, 2), ("B", 1, 3), ("A", 5, 6)])
    assert sorted((r.start, r.end) for r in segments.union_of(rows, 0.5, 0.5).collect()) == [(0.0, 3.5), (4.5, 6.5)]
    line = spark.createDataFrame([(0, f, v) for f, v in enumerate([None, 1.0, None, None, 4.0, None])], "clip_id int, frame int, x double")
    assert [r.x for r in segments.interpolated(line, "x").orderBy("frame").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    runs = spark.createDataFrame([(0, 0, 1, 0.0, 0.9), (0, 0, 2, 1.0, 1.1), (0, 0, 1, 1.1, 1.9), (0, 2, 1, 5.0, 5.4), (0, 2, 2, 5.4, 6.0)], "clip_id long, seg_ord long, face int, start double, end double")
    got = sorted((r.seg_ord, r.start, r.end) for r in segments.run_cuts(runs, rows, least=0.3).collect())
    assert got == [(0, 0.0, 2.0), (1, 1.0, 3.0), (2, 5.0, 5.4), (2, 5.4, 6.0)]
    stats = segments.raw_statistics(seg(spark, [("SPEAKER_01", 0, 1), ("SPEAKER_90", 1, 2), ("SPEAKER_BG1", 2, 4)])).first()
    assert (stats.main_count, stats.outlier_count, stats.background_count, stats.total_seconds) == (1, 1, 1, 4.0)

import random

import numpy as np

from dialoom.llm import quality

DOCS = "doc_id long, text string, lang string, source string"


def test_counts_by_hand():
    text = "a b c\n\nx $% é|\na b c\n \na b"
    n, chars, symbols, dup, repeated, *_ = quality.statistics(text)
    assert (n, chars, symbols, dup) == (11, 13, 3, 1)
    assert repeated == brute_repeated(text.split())
    assert quality.statistics(None)[:5] == quality.statistics("")[:5] == (0, 0, 0, 0, 0)
    assert quality.statistics("a b c")[0] == 1  # only ASCII white space parts words


def brute_repeated(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_repeated_words_match_brute_force():
    draw = random.Random(1)
    for _ in range(200):
        words = [draw.choice("abcd") for _ in range(draw.randint(0, 25))]
        assert quality.statistics(" ".join(words))[4] == brute_repeated(words)


def test_minimum_determinant_ignores_outliers():
    draw = np.random.default_rng(2)
    clean = draw.normal(size=(800, quality.SIZE))
    mean, cov, _ = quality.minimum_determinant(np.concatenate((clean, 20 + draw.normal(size=(160, quality.SIZE)))))
    assert np.abs(mean).max() < 0.3 and np.linalg.eigvalsh(cov).max() < 3
    assert abs(quality.chi_square_quantile(1.6449, 7) - 14.067) < 0.05  # the 95 % quantile at 7 degrees


def make(draw, junk):
    words = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(60, 300))]
    return " ".join(w + "%$#" for w in words) if junk else ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9))


def test_junk_goes_and_clean_stays(spark, monkeypatch):
    monkeypatch.setattr(quality, "PART_ROWS", 150)  # so that groups have several parts
    draw = random.Random(3)
    rows = [(i, make(draw, i % 20 == 0), "en", "s" if i % 3 else "t") for i in range(900)]
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (1002, "too few words", "xx", None), (1003, make(draw, False), "yy", None), (1003, make(draw, False), "yy", None)]
    out = quality.assess(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    assert not any(r.kept for r in out if r.doc_id < 900 and r.doc_id % 20 == 0)
    clean = [r for r in out if r.doc_id < 900 and r.doc_id % 20]
    assert sum(r.kept for r in clean) == len(clean)
    assert all(r.base_failed and not r.kept for r in out if r.doc_id in (1000, 1001, 1002))
    assert all(r.kept for r in out if r.doc_id == 1003)


def test_empty_and_small(spark):
    assert quality.assess(spark.createDataFrame([], DOCS)).count() == 0
    few = quality.assess(spark.createDataFrame([(1, "w " * 40 + "x y z " * 3 + "a b c d e f g h i j k", "en", "s")], DOCS + "")).first()
    assert few.distance is None and few.kept != few.base_failed
    one = quality.assess(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "en", "s")], DOCS)).first()
    assert one.distance < 1e-9 and one.kept  # a single regular row is its own mean


def test_every_group_has_its_own_shrunk_estimate(spark):
    """Against a brute-force version: 35 rows of one group, all subsets' determinants in one task, shrinking by hand."""
    draw = np.random.default_rng(4)
    x = {"s": draw.normal(size=(35, quality.SIZE)), "t": draw.normal(2, 0.5, size=(300, quality.SIZE)), None: draw.normal(size=(3, quality.SIZE))}
    rows = [("en", k, int(draw.integers(1 << 40)), v.tolist()) for k, part in x.items() for v in part]
    docs = spark.createDataFrame(rows, "lang string, source string, hash long, stats array<double>")
    found = {(r.level, r.lang, r.source): r for r in quality.robust_estimates(docs).collect()}
    assert len(found) == 5 and found[2, "en", "s"].n == 35 and found[1, "en", None].n == 338
    every = np.concatenate(list(x.values()))
    own, n = {k: quality.minimum_determinant(v, starts=50, steps=50) for k, v in [*x.items(), ("all", every)]}, len(every)
    weight = n / (n + quality.PRIOR_ROWS)
    cov = weight * own["all"][1] + (1 - weight) * quality.PRIOR_VARIANCE * np.eye(quality.SIZE)
    mean = own["all"][0]
    cov = weight * own["all"][1] + (1 - weight) * cov  # the language is the corpus here
    for k, v in x.items():
        w = len(v) / (len(v) + quality.PRIOR_ROWS)
        got = found[2, "en", k]
        assert np.allclose(got.mean, w * own[k][0] + (1 - w) * mean, atol=0.1)
        want = w * own[k][1] + (1 - w) * cov
        assert abs(np.linalg.slogdet(np.reshape(got["cov"], want.shape))[1] - np.linalg.slogdet(want)[1]) < 0.5
    assert found[2, "en", "s"].limit != found[1, "en", None].limit


def test_ties_long_texts_and_other_columns(spark):
    text = " ".join(f"w{i % 997} and x{i % 89}" for i in range(100_000))
    plain = " ".join(f"w{i} is" for i in range(60))
    docs = spark.createDataFrame([(i, plain, "en", "s", "q") for i in range(20)] + [(99, text, "en", "s", "q")], DOCS + ", distance string")
    out = {r.doc_id: r for r in quality.assess(docs).collect()}
    assert len({(out[i].distance, out[i].kept) for i in range(20)}) == 1 and out[3].kept and out[99].n_words == 300_000

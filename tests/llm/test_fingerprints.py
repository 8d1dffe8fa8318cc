import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from dialoom.llm import fingerprints as fp

DOCS = "doc_id long, text string"
M = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def shingles(text, size=5):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    hashed = [signed(xxhash.xxh64_intdigest(w, 42)) for w in words]
    out = set()
    for i in range(max(len(hashed) - size + 1, min(len(hashed), 1))):
        seed = 42
        for h in hashed[i : i + size]:
            seed = xxhash.xxh64_intdigest((h & M).to_bytes(8, "little"), seed)
        out.add(signed(seed))
    return out


def texts(n, seed):
    draw = random.Random(seed)
    return [" ".join(draw.choice(["Alpha", "beta", "gamma", "dÉlta", "eps", "zeta\n", "eta"]) + str(draw.randrange(30)) for _ in range(draw.randint(0, 300))) for _ in range(n)]


def test_matches_brute_force(spark):
    rows = list(enumerate(texts(60, 1)))
    out = {r.doc_id: r for r in fp.fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect()}
    down = sorted(rows, reverse=True)
    for k, (d, text) in enumerate(down):
        after = down[(k + 1) % len(down)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert out[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[d].n_chars == len(text)
        a, b = (sorted(shingles(t))[: fp.K] for t in (text, edited))
        assert list(out[d].sketch) == a and list(out[d].edited_sketch) == b
        union = sorted({*a, *b})[: fp.K]
        want = len({*union} & {*a} & {*b}) / len(union) if union else 1.0
        assert abs(out[d].near_edited - want) < 1e-12


def test_estimates(spark):
    a, b = texts(1, 2)[0] * 9, None
    a = " ".join(f"w{i}" for i in range(3000))
    b = " ".join(f"w{i}" for i in range(1000, 4000))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fp.sketch(F.col("a"), 512).alias("a"), fp.sketch(F.col("b"), 512).alias("b"))
    got = row.select(fp.resemblance(F.col("a"), F.col("b"), 512), fp.containment(F.col("a"), F.col("b"), 512), fp.distinct_shingles(F.col("a"), 512)).first()
    assert abs(got[0] - 1996 / 3996) < 0.1 and abs(got[1] - 1996 / 2996) < 0.1 and abs(got[2] / 2996 - 1) < 0.15


def test_sketches_merge(spark):
    words = [f"w{i % 700}" for i in range(900)]
    parts = [" ".join(words[i : i + 104]) for i in range(0, 900, 100)]
    whole = spark.createDataFrame([(" ".join(words),)], "t string").select(fp.sketch(F.col("t")).alias("s")).first().s
    rows = spark.createDataFrame([("x", p) for p in parts] + [(None, parts[0]), ("empty", None)], "g string, t string").select("g", fp.sketch(F.col("t")).alias("sketch"))
    merged = fp.merge_rows(rows, ["g"])
    got = {r.g: list(r.sketch) for r in merged.collect()}
    assert got["x"] == list(whole) and got["empty"] == [] and set(got) == {"x", None, "empty"}
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # each task keeps k of a group before the shuffle
    assert fp.merge_rows(rows.limit(0), ["g"]).collect() == []


def test_neighbours_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_A_RANGE", 7)
    rows = [(i * i, f"t{i}") for i in range(100)]
    out = {r.doc_id: r.next_text for r in fp.with_next(spark.createDataFrame(rows, DOCS), ["text"]).collect()}
    assert out == {i * i: f"t{i - 1 if i else 99}" for i in range(100)}


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "one", "x"), (3, "one", "x"), (3, "two", "x"), (None, "Zero nothing", "x"), (4, "ONE", "x")]
    out = fp.fingerprint_documents(spark.createDataFrame(rows, DOCS + ", sketch string")).collect()
    assert len(out) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    one = {tuple(r.sketch) for r in out if r.doc_id in (4,) or (r.doc_id == 3 and r.n_chars == 3)}
    assert len(one) == 2  # "one" in either case, and "two"
    assert fp.fingerprint_documents(spark.createDataFrame([], DOCS)).count() == 0
    alone = fp.fingerprint_documents(spark.createDataFrame([(9, "abcd")], DOCS)).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_no_python_in_the_plan(spark):
    plan = fp.fingerprint_documents(spark.createDataFrame([(1, "a")], DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan

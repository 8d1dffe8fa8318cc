import random
import time

from pyspark.sql import functions as F

from dialoom.llm import line_dedup

DOCS = "doc_id long, text string"


def brute(docs, least):
    """Removed line numbers by comparing every run with everything before it."""
    units = []
    for d, text in sorted(docs, key=lambda x: x[0]):
        own = [(i, x.strip(" \t\n\r\x0b\x0c"), len(x.split())) for i, x in enumerate((text or "").split("\n")) if x.split()]
        units.append((d, own))
    flat = [(d, own, k) for d, own in units for k in range(len(own))]
    gone = {d: set() for d, _ in docs}
    for n, (d, own, k) in enumerate(flat):
        for e, other, j in flat[:n]:
            size = words = 0
            while k + size < len(own) and j + size < len(other) and own[k + size][1] == other[j + size][1]:
                words += own[k + size][2]
                size += 1
            if words >= least:
                gone[d] |= {own[k + m][0] for m in range(size)}
    return {d: sorted(x) for d, x in gone.items()}


def test_matches_brute_force(spark):
    draw = random.Random(3)
    pool = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 6))) for _ in range(12)]
    docs = [(d, "\n".join(draw.choice(pool + ["", "  "]) for _ in range(draw.randint(1, 14)))) for d in range(25)]
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS), min_words=8).collect()
    want = brute(docs, 8)
    assert any(want.values())
    assert {r.doc_id: list(r.removed) for r in found} == want
    for r in found:
        lines = dict(docs)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in want[r.doc_id])
        assert (r.n_lines, r.n_removed) == (len(lines), len(want[r.doc_id]))


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (2, None, "b"), (3, "", "c"), (None, long, "d"), (4, f"new\n{long}\nend", "e"), (4, f"new\n{long}\nend", "f"), (5, "short line", "g"), (6, "short line", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    out = line_dedup.dedup_lines(docs).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].text == long  # a null id comes first, so its copy is the one that stays
    assert by[1][0].text == "" and list(by[1][0].removed) == [0]
    assert by[2][0].text is None and by[3][0].text == ""
    assert [r.text for r in by[4]] == ["new\nend"] * 2  # both rows of the repeated document
    assert by[5][0].text == by[6][0].text == "short line"
    empty = line_dedup.dedup_lines(spark.createDataFrame([], DOCS))
    assert empty.count() == 0


def test_no_python_in_the_plan(spark):
    plan = line_dedup.dedup_lines(spark.createDataFrame([(1, "a")], DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_common_lines_in_many_contexts(spark):
    """Fingerprints whose first place stands in another context: the match is found at their other places."""
    draw = random.Random(5)
    common = [f"c{i} c" for i in range(3)]
    lines = [draw.choice(common) if draw.random() < 0.6 else f"own{draw.randint(0, 6)} x" for _ in range(160)]
    docs = [(d, "\n".join(lines[draw.randint(0, 140) :][: draw.randint(4, 18)])) for d in range(30)]
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS), min_words=7).collect()
    want = brute(docs, 7)
    assert sum(map(len, want.values())) > 20 and {r.doc_id: list(r.removed) for r in found} == want


def test_very_long_documents(spark):
    long = "\n".join(f"line {i} has some words here" for i in range(30_000))
    docs = spark.createDataFrame([(1, long), (2, f"first\n{long}\n\nlast"), (3, "\n".join(["again and again"] * 20_000))], DOCS)
    start = time.time()
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - start < 120
    assert out[1].text == long and out[2].text == "first\n\nlast" and out[2].n_removed == 30_000
    assert out[3].n_lines == 20_000 and out[3].text == "again and again"  # occurrences may overlap

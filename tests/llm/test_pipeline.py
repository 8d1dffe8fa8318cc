"""The corpus pipeline: each stage's output against a brute-force version of that stage on its own input."""

import os
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from dialoom.llm import mixing, queries, sentencepiece_codec
from dialoom.llm.common import written

from .test_language_id import SYLLABLES
from .test_line_dedup import brute as brute_lines
from .test_minhash import brute as brute_near
from .test_mixing import waterfill

SF = "/root/testdata/sf0.001"


def corpus():
    draw = random.Random(11)

    def sentence(lang, n):
        return " ".join("".join(draw.choice(SYLLABLES[lang].split()) for _ in range(draw.randint(2, 4))) for _ in range(n))

    rows, passages = [], {lang: "\n".join(sentence(lang, 20) for _ in range(3)) for lang in SYLLABLES}
    for i in range(240):
        lang = draw.choice(list(SYLLABLES))
        text = "\n".join(sentence(lang, draw.randint(5, 40)) for _ in range(draw.randint(2, 5)))
        if i % 6 == 0:
            text = f"{text}\n{passages[lang]}"
        if i % 10 > 7:
            old = rows[-draw.randint(1, 8)]
            lang, text = old[2], old[1].replace(" ", "  ", i % 2)
        rows.append((i, text, lang, f"s{i % 4}" if i % 7 else None, len(text)))
    return rows + [(1000, "ржавый ключ открывает дверь медленно и громко", None, "s0", 44), (1001, None, "aa", "s1", 0), (1002, "", "bb", "s1", 0)]


def test_stages_against_brute_force(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").cache()
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "line_dedup", "near_dedup", "mix", "encode"]

    def run(name, rows):
        out = stage[name](spark, rows, "").cache()
        assert name == "encode" or out.columns == docs.columns
        return out, [r for r in out.collect()]

    known, rows = run("language_id", docs)
    assert {r.doc_id for r in rows} == {r[0] for r in corpus() if r[0] < 1000}  # clean documents stay, the foreign and empty ones go
    short, after = run("line_dedup", known)
    gone = brute_lines([(r.doc_id, r.text) for r in rows], 50)
    texts = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id]) for r in rows}
    texts = {d: t for d, t in texts.items() if t.split() or not gone[d]}
    assert any(gone.values()) and len(texts) < len(rows) and {r.doc_id: r.text for r in after} == texts and all(r.n_chars == len(r.text) for r in after)
    single, rows = run("near_dedup", short)
    groups = brute_near([(r.doc_id, r.text) for r in after], 5, 80)
    assert {r.doc_id for r in rows} == {d for d, (_, c) in groups.items() if d == c} and len(rows) < len(after)
    mixed, taken = run("mix", single)
    size = {r.doc_id: len(r.text.split()) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size[r.doc_id]
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = waterfill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    for s in names:
        assert abs(sum(size[r.doc_id] for r in taken if r.source == s) - want[s]) <= max(size.values())
    assert max(Counter(r.doc_id for r in taken).values()) <= 2
    codec = sentencepiece_codec.load()
    _, encoded = run("encode", mixed)
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in encoded) == Counter((r.doc_id, tuple(codec.encode([r.text])[0].tolist())) for r in taken)
    assert all(r.same and r.n_tokens == len(r.token_ids) for r in encoded)
    # Written and reread, as between stages: the places give the training order, in whatever order the rows are read.
    again, _ = run("encode", written(mixed, "mixed"))
    assert [r.doc_id for r in again.orderBy("place").collect()] == [r.doc_id for r in mixing.training_order(single).collect()]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_run_on_the_smallest_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "same", "place"] and out.filter("NOT same OR place IS NULL").isEmpty() and out.count() > 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_one_row_for_each_input_row(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    got = queries.QUERIES[name](spark, SF)
    table, key = ("pages", "page_id") if "page_id" in got.columns else ("documents", "doc_id")
    rows = got.collect()
    assert sorted(r[key] for r in rows) == [r[0] for r in con.sql(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]
    if name in queries.ORACLE_SQL:
        want = con.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(repr, ([r[c] for c in columns] for r in rows))) == sorted(map(repr, map(list, want.fetchall())))

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.functions import scalars, text
from dialoom.operators import evaluate, gates, runs, speakers, timeline, visual, words


def test_gate_by_hand(spark):
    """Total silence: a voiced ratio of exactly 0 raises nothing."""
    row = spark.sql("SELECT 'hi hi hi hi' AS t, 4.0D AS d, named_struct('voiced_ratio', 0.0D, 'silence_ratio', 1.0D, 'clipping_ratio', 0.0D) AS f")
    got = row.select(gates.asr_gate(F.col("t"), F.col("d"), F.col("f")).alias("g"), text.spoken_characters(F.col("t")).alias("c"), text.repetition_ratio(F.col("t")).alias("r")).first()
    assert (got.c, got.r, got.g.score, got.g.accepted) == (8, 0.75, 0.9, True)
    assert list(got.g.warnings) == ["repetitive_transcript", "mostly_silent_chunk"]


def test_budget_by_hand(spark):
    row = spark.sql("SELECT 2.0D AS d, 'I see' AS t, 3 AS p").select(text.duration_budget(F.col("d"), F.col("t"), F.lit("Korean"), F.col("p")).alias("b")).first().b
    assert (row.source_units, row.min_units, row.target_units, row.max_units) == (4, 7, 8, 11)


def test_emotion_by_hand(spark):
    row = spark.sql("SELECT map('happy', 0.8D, 'neutral', 0.2D) AS s, 'neutral' AS e")
    got = row.select(gates.emotion_fused(F.col("s"), F.col("e"), F.lit(""), 0.7, ("happy", "sad", "neutral")).alias("x")).first().x
    assert got.label == "neutral" and abs(got.scores["happy"] - 0.24) < 1e-12 and abs(got.scores["neutral"] - 0.76) < 1e-12
    lexicon = row.select(gates.emotion_fused(F.col("s"), F.lit(None).cast("string"), F.lit("I HATE it"), 0.9, ("happy", "neutral")).label.alias("l")).first().l
    assert lexicon == "neutral"


def test_similarity_and_register(spark):
    rows = spark.createDataFrame([("abcd", "bcde"), ("", "x"), ("same", "same")], "a string, b string")
    assert [r[0] for r in rows.select(text.similarity("a", "b")).collect()] == [0.75, 0.0, 1.0]
    lines = spark.createDataFrame([("안녕하세요.",), ("뭐야!",), ("hello",), (None,)], "t string")
    assert [r[0] for r in lines.select(text.register(F.col("t"))).collect()] == ["polite", "casual", "unknown", "unknown"]


def test_scalars(spark):
    row = spark.sql("SELECT 3.0D AS f, 0.0D AS z, array(0D,0D,2D,2D) AS a, array(1D,1D,3D,3D) AS b, 125.4D AS s").select(
        scalars.atempo_chain(F.col("f")).alias("chain"), scalars.dbfs(F.col("z")).alias("db"), scalars.box_iou(F.col("a"), F.col("b")).alias("iou"), scalars.clock(F.col("s")).alias("clock")).first()
    assert len(row.chain) == 2 and abs(row.chain[0] * row.chain[1] - 3) < 1e-12 and row.db == -120 and abs(row.iou - 1 / 7) < 1e-12 and row.clock == "2:05"


def test_consensus_by_hand(spark):
    nodes = spark.createDataFrame([(0, i) for i in (1, 2, 3)], "clip_id int, node long")
    labels = {1: "axp", 2: "axp", 3: "bx-"}
    votes = [(0, n, v, None if x == "-" else x) for n, s in labels.items() for v, x in enumerate(s)]
    got = speakers.consensus(nodes, spark.createDataFrame(votes, "clip_id int, node long, voter int, label string"), ["node"], 3, 0.67)
    assert {r.node: r.component for r in got.collect()} == {1: 1, 2: 1, 3: 3}


def test_kernels():
    draw = np.random.default_rng(1)
    x = speakers._units(np.concatenate((np.eye(8)[[0] * 10], np.eye(8)[[1] * 6])) + 0.05 * draw.normal(size=(16, 8)))
    truth = [0] * 10 + [1] * 6
    for own in (speakers.linkage(x, 0.5, "average"), speakers.linkage(x, 0.5, "complete"), speakers.greedy(x, 0.5), speakers.two_means(x)):
        assert len({(a, b) for a, b in zip(truth, own.tolist())}) == 2
    assert speakers.silhouette(x, np.array(truth)) > 0.8
    assert speakers.named(np.array([5, 5, 2, 5]), "R") == ["R0", "R0", "R1", "R0"]


def test_unknown_modules_fail_before_anything_runs(spark):
    with pytest.raises(ValueError):
        speakers.repair(spark.range(1), [("nothing", {})])


def test_word_path_prefers_staying():
    gain = np.array([[1, 0], [0.4, 0.6], [1, 0], [0, 1], [0, 1]], float)
    t = np.arange(5.0)
    assert words.best_path(gain, t, t + 1, 0.4, 0.8).tolist() == [0, 0, 0, 1, 1]
    assert words.best_path(gain, t * 3, t * 3 + 1, 0.4, 0.8).tolist() == [0, 1, 0, 1, 1]  # changes are free after pauses


def test_word_path_equals_brute_force():
    from itertools import product

    draw = random.Random(3)
    for _ in range(40):
        gain = np.array([[draw.random() for _ in range(3)] for _ in range(6)])
        t = np.cumsum([draw.choice((0.5, 3.0)) for _ in range(6)])
        cost = lambda p: sum(gain[i, k] for i, k in enumerate(p)) - sum(0.4 for i in range(1, 6) if p[i] != p[i - 1] and t[i] - t[i - 1] - 0.4 <= 0.8)
        best = max(product(range(3), repeat=6), key=cost)
        assert abs(cost(words.best_path(gain, t, t + 0.4, 0.4, 0.8).tolist()) - cost(best)) < 1e-9


def test_ordered_sequences(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "c"], ["b", "c"]), (["a", "b"], ["b", "a"]), (["a", "b", "c"], ["a", None, "c"]), ([], ["a"])], "l array<string>, w array<string>")
    got = rows.select(evaluate.sequence_found(F.col("l"), F.col("w")), evaluate.sequence_places(F.col("l"), F.col("w"))).collect()
    assert [(r[0], None if r[1] is None else list(r[1])) for r in got] == [(True, [2, 4]), (False, None), (True, [1, 2, 3]), (False, None)]


def test_rank_falls_back_to_the_proxy(spark):
    rows = spark.createDataFrame([(1, 0.5, None), (2, None, 0.4), (3, None, None)], "trial int, metric double, proxy double")
    assert [r.trial for r in runs.ranked_trials(rows, "metric", "proxy", "trial", 3).collect()] == [2, 1, 3]


def test_parameters(spark):
    rows = spark.sql("SELECT map('g', '1') AS p")
    assert rows.select(runs.canonical_parameters(F.col("p"), {"g": "gap"}, ["gap"])).first()[0] == {"gap": "1"}
    with pytest.raises(Exception, match="unknown parameters"):
        rows.select(runs.canonical_parameters(F.col("p"), {"g": "gap"}, ["other"])).collect()


def test_steps(spark):
    rows = spark.sql("SELECT array(named_struct('name','a','state','running'), named_struct('name','b','state','pending')) AS s")
    got = rows.select(runs.set_step(F.col("s"), "b", state=F.lit("done")).alias("s")).first().s
    assert [x.state for x in got] == ["running", "done"]
    with pytest.raises(ValueError):
        runs.steps_between(rows, 3, 1)


def test_last_duplicate_wins_and_nothing_multiplies(spark):
    chunks = spark.createDataFrame([("c", "1"), ("c", "2")], "clip_id string, chunk_id string")
    side = spark.createDataFrame([("c", "1", "old", 1), ("c", "1", None, 2)], "clip_id string, chunk_id string, v string, ord int")
    out = timeline.assemble(chunks, {"s": side}).withColumn("x", timeline.present_else(F.col("s"), "v", F.lit("none"))).orderBy("chunk_id").collect()
    assert [r.x for r in out] == [None, "none"]


def test_tracks(spark):
    boxes = [(0, (0, 0, 2, 2)), (1, (0, 0, 2, 2.2)), (1, (9, 9, 11, 11)), (20, (0, 0, 2, 2))]
    assert visual.chain_boxes(boxes, 0.5, 10) == [0, 0, 1, 2]
    rows = spark.createDataFrame([(0, f, [float(v) for v in b]) for f, b in boxes], "shot_id int, frame long, bbox array<double>")
    assert visual.track_boxes(rows, least_frames=2).count() == 2
    ragged = spark.createDataFrame([(0, 1, [1, 2, 3], [0.1, 0.2, 0.3], [0.5, 0.6])], "clip_id int, track_id int, frames array<int>, ts array<double>, scores array<double>")
    assert visual.track_frames(ragged).count() == 2


def test_small_timeline_rules(spark):
    rows = spark.createDataFrame([("c", "1", 1, "a", "2"), ("c", "2", 2, "b", "1"), ("c", "3", 3, "a", None), ("c", "4", 4, "a", "9"), ("c", "5", 5, "a", "3")], "clip_id string, chunk_id string, chunk_ord int, speaker string, reference string")
    state = {r.chunk_id: r.reference_state for r in timeline.scoped_reference(rows).collect()}
    assert state == {"1": "other_speaker", "2": "other_speaker", "3": "none", "4": "missing", "5": "ok"}
    assert timeline.mark_stale(rows, rows.filter("chunk_ord < 3")).filter("stale").count() == 2
    assert timeline.keep_columns(rows, ["speaker", "nothing", "clip_id"]).columns == ["speaker", "clip_id"]
    labels = spark.createDataFrame([("c", "1", "x/Happiness", 0.4), ("c", "1", "happy", 0.6), ("c", "1", "sad", 0.5)], "clip_id string, chunk_id string, label string, score double")
    got = timeline.label_scores(labels).first()
    assert got.label == "happy" and got.scores == {"happy": 0.6, "sad": 0.5}
    with pytest.raises(Exception, match="unknown reference mode"):
        spark.sql("SELECT 'odd' AS m").select(timeline.reference_mode(F.col("m"))).collect()


def test_replies(spark):
    rows = spark.createDataFrame([(1, '```json\n{"items":[{"chunk_id":"a","value":"x"},{"chunk_id":"","value":"y"}]}\n```'), (2, "no json"), (3, None)], "n int, reply string")
    assert [(r.n, r.chunk_id, r.value) for r in timeline.reply_rows(rows).collect()] == [(1, "a", "x")]
    texts = spark.createDataFrame([('{"choices":[{"message":{"content":" hi "}}]}',), ('{"output_text":"yo"}',), ("{}",)], "r string")
    assert [r[0] for r in texts.select(timeline.reply_text(F.col("r"))).collect()] == ["hi", "yo", None]


def test_parts_move_to_the_better_voice(spark):
    e = {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    items = [("a", 0, "a"), ("a", 1, "a"), ("b", 2, "b"), ("b", 3, "b"), ("a", 50, "b"), ("a", 51, "b")]
    rows = spark.createDataFrame([(0, i, s, float(t), t + 0.9, e[v]) for i, (s, t, v) in enumerate(items)], "clip_id int, chunk_ord int, speaker string, start double, end double, embedding array<double>")
    got = {r.chunk_ord: r.speaker for r in speakers.part_reassign(rows, 5.0, 0.2).collect()}
    assert got == {0: "a", 1: "a", 2: "b", 3: "b", 4: "b", 5: "b"}
    split = {r.chunk_ord: r.speaker for r in speakers.sub_split(rows, ["chunk_ord"], 0.5, least=2).collect()}
    assert split == {0: "a", 1: "a", 2: "b", 3: "b", 4: "a_b", 5: "a_b"}
    faces = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 4, 2)], "clip_id int, chunk_ord int, face int")
    assert {r.chunk_ord: r.speaker for r in speakers.mint_by_faces(rows, faces).collect()}[4] == "a_m1"

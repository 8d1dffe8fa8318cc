import json

from pyspark.sql import functions as F

from dialoom.plans.registry import Registry, run_stages, stages
from dialoom.schemas import SEGMENT
from dialoom.sources import tables
from dialoom.streaming import progress


def put(folder, name, content):
    path = folder / name
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return f"file://{path}"


def test_rttm(spark, tmp_path):
    path = put(tmp_path, "clip.rttm", "# note\nSPEAKER f 1 1.5 0.5 <NA> <NA> B <NA> <NA>\nSPEAKER f 1 0 1 <NA> <NA> A <NA> <NA>\nLEXEME f 1 0 1 x x A\nSPEAKER f 1 x 1 <NA> <NA> A <NA> <NA>\nSPEAKER f 1 3\nSPEAKER f 1 5 0.1 <NA> <NA> C <NA> <NA>\n")
    rows = tables.read_rttm(spark, path, least=0.3)
    assert [(r.clip_id, r.seg_ord, r.speaker, r.start, r.end) for r in rows.orderBy("seg_ord").collect()] == [("clip", 0, "A", 0.0, 1.0), ("clip", 1, "B", 1.5, 2.0)]
    out = f"file://{tmp_path}/out.rttm"
    tables.write_rttm(rows, out, F.lit("f"))
    assert [r.value for r in spark.read.text(out).collect()][0] == "SPEAKER f 1 0.000 1.000 <NA> <NA> A <NA> <NA>"


def test_segments_from_all_shapes(spark, tmp_path):
    one = {"speaker": "A", "start": 0, "end": 1}
    shapes = {"list.json": [one, {"speaker": "A", "start": 2, "end": 1}], "object.json": {"segments": [one]}, "groups.json": {"groups": [{"speaker": "A", "group_start": 0, "group_end": 1}]}, "bom.json": "﻿" + json.dumps([one])}
    for name, content in shapes.items():
        rows = tables.read_segments(spark, put(tmp_path, name, content)).collect()
        assert [(r.clip_id, r.speaker, r.start, r.end) for r in rows] == [(name[:-5], "A", 0.0, 1.0)], name


def test_words(spark, tmp_path):
    path = put(tmp_path, "w.json", {"words": [{"word": " b ", "start": 2, "end": 3}, {"text": "a", "start": 0, "end": 1}, {"word": "", "start": 0, "end": 1}, {"word": "x", "start": "q", "end": 1}]})
    assert [(r.word_ord, r.word) for r in tables.read_words(spark, path).orderBy("word_ord").collect()] == [(1, "a"), (2, "b")]


def test_lenient_json(spark, tmp_path):
    path = put(tmp_path, "s.jsonl", '{"clip_id":"c","seg_ord":1,"speaker":"A","start":0,"end":1}\n\nnot json\n[1]\n{"speaker":"B"}\n')
    assert sorted(r.speaker for r in tables.read_json(spark, path, SEGMENT, lines=True).collect()) == ["A", "B"]
    assert tables.read_json_or_empty(spark, f"file://{tmp_path}/none.json", SEGMENT).count() == 0


def test_activity_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for i in range(2):
        tables.write_activity(spark.createDataFrame([(f"r{i}", "m" * 500, None)], "run_id string, message string, actor string"), path)
    raw = [r.value for r in spark.read.text(path).collect()]
    assert len(raw) == 2 and "actor" not in raw[0] and len(json.loads(raw[0])["message"]) == 240


def test_small_readers(spark, tmp_path):
    assert tables.read_environment("# c\nexport A=1\nB='x y'\nbad\n") == {"A": "1", "B": "x y"}
    path = put(tmp_path, "run.log", "\n".join(f"line {i}" for i in range(50)))
    assert [r.value for r in tables.log_tail(spark, path, 3).collect()] == ["line 47", "line 48", "line 49"]
    assert tables.artifacts(spark, path, ["log"]).first().length > 0 and tables.artifacts(spark, path, ["wav"]).count() == 0
    files = spark.createDataFrame([("c", "/x/v190.json"), ("c", "/x/v190b.json"), ("d", "/x/raw.json")], "clip_id string, path string")
    assert {r.clip_id: r.path for r in tables.preferred_files(files, ["v190b", "v190", ""]).collect()} == {"c": "/x/v190b.json", "d": "/x/raw.json"}
    tables.write_summary_csv(spark.sql("SELECT 1 AS trial, map('a', 2) AS parameters"), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").first().parameters == '{"a":2}'


LINES = [
    "12:00 Starting step: a", "text", "12:02 Completed step: a", "Completed step: b", "Starting step: c", "Step failed: c | out of memory", "Starting step: a",
]


def log(spark):
    return spark.createDataFrame([("r", float(i), i, v) for i, v in enumerate(LINES)], "run_id string, ts double, event_id long, value string")


def test_progress_batch(spark):
    out = progress.durations(progress.parse(log(spark))).orderBy("event_id").collect()
    assert [r.type for r in out] == ["step_start", "log", "step_done", "step_done", "step_start", "step_error", "step_start"]
    assert [r.duration_ms for r in out] == [None, None, 2000, 0, None, 1000, None]
    assert out[5].message == "out of memory" and out[1].step is None
    state = {r.step: r.state for r in progress.client_state(progress.durations(progress.parse(log(spark)))).collect()}
    assert state == {"a": "running", "b": "done", "c": "failed"}


def test_progress_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    events = progress.parse(log(spark))
    for i in range(len(LINES)):  # a file for each line: a micro-batch each
        events.filter(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(f"file://{source}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
    seen = []
    query = progress.push(progress.stream_durations(stream), lambda df, _: seen.extend((r.event_id, r.duration_ms) for r in df.collect()), f"file://{tmp_path}/check", once=True)
    query.awaitTermination(120)
    batch = [(r.event_id, r.duration_ms) for r in progress.durations(events).filter("step IS NOT NULL").collect()]
    assert sorted(seen, key=str) == sorted(batch, key=str)


def test_registry(spark):
    own = Registry("thing")
    own.add("a", len)
    assert own.names() == ["a"] and own.get("a") is len
    stages.add("double", lambda d: d.withColumn("id", F.col("id") * 2))
    stages.add("plus", lambda d: d.withColumn("id", F.col("id") + 1))
    assert [r.id for r in run_stages(spark.range(2), ["double", "plus"]).collect()] == [1, 3]
    assert [r.id for r in run_stages(spark.range(2), ["double", "plus"], skip=["plus"]).collect()] == [0, 2]

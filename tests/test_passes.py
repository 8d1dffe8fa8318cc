"""Repair passes, edits, signatures and SQL functions on small hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from dialoom.functions import sql
from dialoom.operators import edits, passes, timeline, visual
from dialoom.sources import tables

SEG = "clip_id long, seg_ord long, speaker string, start double, end double, text string"
VOICES = {"A": [1.0, 0.0], "B": [0.0, 1.0]}


def embed_by(heard):
    """A voice model that hears the voice of whoever speaks at the middle of a stretch: heard (voice, start, end)."""

    def embed(rows):
        middle = (F.col("start") + F.col("end")) / 2
        value = F.lit(None).cast("array<double>")
        for voice, a, b in heard:
            value = F.when((middle >= a) & (middle < b), F.array(*map(F.lit, VOICES[voice]))).otherwise(value)
        return rows.withColumn("embedding", value)

    return embed


def test_visual_split_in_three_and_speech_in_a_gap(spark):
    rows = spark.createDataFrame([(0, 0, "A", 1.0, 2.0, "one"), (0, 1, "B", 3.0, 4.0, "two"), (0, 2, "A", 5.0, 15.0, "a b c d e f g h i j")], SEG)
    runs = spark.createDataFrame([(0, 7, 8.0, 10.0), (0, 8, 16.0, 17.0), (0, 9, 12.0, 12.3)], "clip_id long, track_id long, start double, end double")
    voice = embed_by([("A", 0, 2.5), ("B", 2.5, 4.5), ("A", 4.5, 15.5), ("B", 8.5, 9.5), ("B", 15.5, 20)])
    total = spark.createDataFrame([(0, 20.0)], "clip_id long, seconds double")
    got = [tuple(r)[1:] for r in passes.visual_split(rows, runs, voice, total=total).orderBy("seg_ord").collect()]
    # The middle of the third segment is heard as A's, so A's voice stays A; the face's two seconds in it are B's.
    assert [g[1:4] for g in got] == [("A", 1.0, 2.0), ("B", 3.0, 4.0), ("A", 5.0, 8.0), ("B", 8.0, 10.0), ("A", 10.0, 15.0), ("B", 16.0, 17.0)]
    assert [g[4] for g in got] == ["one", "two", "a b c", "d e", "f g h i j", ""] and [g[5] for g in got] == ["kept", "kept", "cut", "visual", "cut", "gap"]
    assert passes.visual_split(rows.limit(0), runs, voice).collect() == []


def test_face_relabel_precedence(spark):
    """A row for each precedence: split before spread before match; background left alone."""
    rows = spark.createDataFrame(
        [(0, 0, "A", 0.0, 4.0, ""), (0, 1, "A", 10.0, 14.0, ""), (0, 2, "A", 20.0, 24.0, ""), (0, 3, "A", 30.0, 34.0, ""), (0, 4, "A", 40.0, 44.0, ""),
         (0, 5, "B", 50.0, 54.0, ""), (0, 6, "B", 60.0, 64.0, ""), (0, 7, "C", 70.0, 74.0, ""), (0, 8, "SPEAKER_BG", 0.0, 4.0, ""), (0, 9, "A", 80.0, 84.0, "")], SEG)
    shown = [(0, 1), (10, 1), (20, 1), (30, 2), (40, 2), (50, 2), (60, 2), (70, 1)]  # second, face
    frames = [(0, f"t{face}", s * 10 + k, 0.9) for s, face in shown for k in range(40)] + [(0, f"t{1 + (k >= 20)}", 800 + k, 0.9) for k in range(40)]
    frames = spark.createDataFrame(frames, "clip_id long, track_id string, frame long, score double")
    clusters = spark.createDataFrame([(0, "t1", 1), (0, "t2", 2)], "clip_id long, track_id string, cluster long")
    got = {(r.seg_ord, r.part): (r.speaker, r.start, r.end, r.origin) for r in passes.face_relabel(rows, frames, clusters, fps=10.0).collect()}
    assert got[0, 0] == ("A", 0.0, 4.0, "kept") and got[8, 0] == ("SPEAKER_BG", 0.0, 4.0, "kept")
    assert got[3, 0] == ("A_v2", 30.0, 34.0, "spread") and got[4, 0][0] == "A_v2" and got[5, 0] == ("B", 50.0, 54.0, "kept")
    assert got[7, 0] == ("A", 70.0, 74.0, "match")  # C's only face is mostly A's
    assert got[9, 0] == ("A", 80.0, 82.0, "split") and got[9, 1] == ("B", 82.0, 84.0, "split")


def test_retry_decision(spark):
    rows = spark.createDataFrame([(0, 0, "A", 0.0, 1.0, ""), (0, 1, "B", 2.0, 3.0, ""), (0, 2, "SPEAKER_91", 4.0, 5.0, ""), (1, 0, "SPEAKER_BG", 0.0, 1.0, "")], SEG)
    got = {r.clip_id: r for r in passes.retry_decision(rows, embed_by([("A", 0, 1.5), ("B", 1.5, 9)])).collect()}
    assert (got[0].n_main, got[0].n_outlier, got[0].distinct_pairs, got[0].action, got[0].threshold) == (2, 1, 2, "retry_higher", 0.5)
    assert abs(got[0].voice_diversity - 0.667) < 1e-9 and (got[1].n_main, got[1].n_segments, got[1].action) == (0, 1, "retry_higher")


def test_edits_of_speakers(spark):
    rows = spark.createDataFrame([(0, "c1", "A", "x"), (0, "c2", "B", "x"), (0, "c3", "C", "x")], "clip_id long, chunk_id string, speaker string, dub_error string")
    wanted = spark.createDataFrame([(0, "c1", "N", None, None), (0, "c2", "B", "auto", ""), (0, "c9", "N", None, None)], "clip_id long, chunk_id string, speaker string, reference_mode string, reference_chunk_id string")
    once = edits.edit_speakers(rows, wanted)
    got = {r.chunk_id: (r.speaker, r.speaker_original, r.dub_stale, r.dub_error) for r in once.collect()}
    assert got == {"c1": ("N", "A", True, None), "c2": ("B", None, None, "x"), "c3": ("C", None, None, "x")}
    again = edits.edit_speakers(once, wanted.withColumn("speaker", F.lit("M")))
    assert {r.chunk_id: r.speaker_original for r in again.collect()} == {"c1": "A", "c2": "B", "c3": None}
    with pytest.raises(Exception, match="speaker must not be blank"):
        edits.edit_speakers(rows, wanted.withColumn("speaker", F.lit(" "))).collect()
    with pytest.raises(Exception, match="unknown reference mode"):
        edits.edit_speakers(rows, wanted.withColumn("reference_mode", F.lit("odd"))).collect()


def test_a_file_written_again_makes_its_row_stale(spark, tmp_path):
    for name in ("a", "b", "gone"):
        (tmp_path / f"{name}.wav").write_text("same length")
    rows = spark.createDataFrame([(0, n, f"{n}.wav") for n in ("a", "b", "gone", "never")], "clip_id long, chunk_id string, wav string")

    def signed():
        listed = tables.artifacts(spark, f"file://{tmp_path}", ["wav"]).withColumn("path", F.element_at(F.split("path", "/"), -1))
        return spark.createDataFrame(timeline.file_signature(rows, listed, "wav", ["chunk_id"]).collect())

    before = signed().withColumn("output", F.lit("x"))
    import os

    (tmp_path / "b.wav").write_text("size equal.")
    os.utime(tmp_path / "b.wav", (1, 1))
    os.remove(tmp_path / "gone.wav")
    state = {r.chunk_id: r.state for r in timeline.staleness(signed(), before).collect()}
    assert state == {"a": "fresh", "b": "stale", "gone": "stale", "never": "fresh"}


def test_tracks_have_a_box_for_each_frame(spark):
    rows = spark.createDataFrame([(1, 0, 0, [0.0, 0.0, 10.0, 10.0]), (1, 0, 4, [4.0, 0.0, 14.0, 12.0]), (1, 1, 0, [0.0, 0.0, 1.0, 0.5])], "shot_id long, track int, frame long, bbox array<double>")
    got = [(r.frame, list(r.bbox)) for r in visual.interpolated(rows, least_face=1.0).orderBy("frame").collect()]
    assert got == [(i, [float(i), 0.0, 10.0 + i, 10.0 + i / 2]) for i in range(5)]


def test_functions_in_sql(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "A", 0.0, 1.0), (1, "A", 2.0, 3.0), (1, "B", 2.5, 9.0), (2, "A", 0.0, 1.0)], "clip_id long, speaker string, start double, end double").createOrReplaceTempView("spoken")
    turns = spark.sql("SELECT * FROM speaker_turns(TABLE(spoken) PARTITION BY clip_id ORDER BY start)").collect()
    assert sorted(tuple(r) for r in turns) == [(1, 1, "A", 0.0, 3.0, 2), (1, 2, "B", 2.5, 9.0, 1), (2, 1, "A", 0.0, 1.0, 1)]
    pauses = spark.sql("SELECT clip_id, longest_pause(start, end) AS p FROM spoken GROUP BY clip_id").collect()
    assert {r.clip_id: r.p for r in pauses} == {1: 1.0, 2: 0.0}

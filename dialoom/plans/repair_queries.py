"""Queries of sweeps, of repair passes over face and voice evidence, and of what the engine asks runs; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..operators import edits, evaluate, passes, speakers, sweep, timeline, visual
from ..session import table_path, written
from ..sources import tables
from . import data_sql, interval_queries, registry, views
from .oracle_views import CHUNKS, CLOCK

CLIP = ["clip_id"]

TRIALS = [*sweep.grid_trials({"gap": [0.0, 8.0, 30.0], "least": [2.0, 30.0]}), {"gap": -1.0, "least": 2.0}]
REPORT = "chunks long, speech double, short_share double"


def sweep_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clips under seven trials, of which the last fails: stopped after the first wave, then resumed."""
    rows = views.on_one_clock(spark, sf_dir).select("clip_id", "seg_ord", "speaker", "start", "end")
    path = table_path(spark, "sweep")
    sweep.run_sweep(rows, "clip_id", TRIALS, sweep.merged_speech, REPORT, path, trials_per_wave=3, waves=1)
    out = sweep.run_sweep(rows, "clip_id", TRIALS, sweep.merged_speech, REPORT, path, resume=True, trials_per_wave=3)
    return out.select(F.col("item").alias("clip_id"), "trial", "attempt", "status", "error", "chunks", "speech", F.round("short_share", 9).alias("short_share"))


def _embed(spark: SparkSession, sf_dir: str):
    """Stands for a voice model: each stretch of a clip has one of the table's vectors.

    The table grows, so it is not broadcast, though its file is small: the driver would hold it once for each call. Its floats are cast
    by who computes with them.
    """
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_vec"), "embedding").hint("merge")
    n = e.count()
    tick = lambda c: F.floor(F.col(c) * 8).cast("long")
    return lambda rows: rows.withColumn("_vec", F.pmod(tick("start") + 31 * tick("end") + 7 * F.col("clip_id"), F.lit(n))).join(e, "_vec", "left").drop("_vec")


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.on_one_clock(spark, sf_dir)
    return rows.select("clip_id", "seg_ord", "speaker", "start", "end", F.concat(F.col("seg_ord").cast("string"), F.lit(" one  two three four five six")).alias("text"))


def visual_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A face track for each segment, speaking from 6 s after its start for half its length."""
    rows = _spoken(spark, sf_dir)
    runs = rows.select("clip_id", F.col("seg_ord").alias("track_id"), (F.col("start") + 6.25).alias("start"), (F.col("start") + 6.25 + (F.col("end") - F.col("start")) / 2).alias("end"))
    total = rows.select("clip_id", F.lit(30_100.0).alias("seconds")).distinct()
    return passes.visual_split(rows, runs, _embed(spark, sf_dir), total=total, least_sim=0.15, margin=0.1, width=40.0)


def focused_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second model hears each segment as stretches of 2 to 5 s with two labels, and one stretch after its end; a pitch each second."""
    rows = _spoken(spark, sf_dir)
    step = 2.0 + F.col("seg_ord") % 7 / 2.0
    cuts = rows.select("clip_id", "seg_ord", "start", "end", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    parts = cuts.select("clip_id", "seg_ord", F.concat(F.lit("x"), (F.col("k") * (F.col("seg_ord") % 3 + 1) % 4 / 2).cast("int").cast("string")).alias("label"),
        (F.col("start") + F.col("k") * F.col("step") - 0.5).alias("start"), (F.col("start") + (F.col("k") + 1) * F.col("step") - 0.625).alias("end"))
    lone = rows.select("clip_id", (F.col("end") + 1.5).alias("start"), (F.col("end") + 6.25).alias("end"))
    pitch = rows.select("clip_id", F.floor("start").alias("t0"), "seg_ord", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k")).select(
        "clip_id", (F.col("t0") + F.col("k")).cast("double").alias("t"), F.when((F.col("seg_ord") + F.col("k")) % 5 > 0, 100.0 + (F.col("seg_ord") * 13 + F.col("k")) % 90).alias("f0"))
    total = rows.select("clip_id", F.lit(30_100.0).alias("seconds")).distinct()
    return passes.focused_split(rows, parts, lone, pitch, _embed(spark, sf_dir), total=total, higher=5.0, width=40.0)


def face_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten frames of a track in each segment; tracks of seven faces."""
    rows = _spoken(spark, sf_dir).withColumn("speaker", F.when(F.col("seg_ord") % 11 == 5, F.lit("SPEAKER_BG1")).otherwise(F.col("speaker")))
    seen = rows.select("clip_id", (F.col("seg_ord") % 50).alias("track_id"), "speaker", "seg_ord", F.floor("start").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    frames = seen.select("clip_id", "track_id", (F.col("t") + 3 * F.col("k")).alias("frame"), ((F.col("seg_ord") * 7 + F.col("k") * 3) % 10 / 8.0).alias("score"))
    clusters = seen.select("clip_id", "track_id", (F.col("track_id") % 7).alias("cluster")).distinct()
    counts = seen.groupBy("clip_id", "speaker", "track_id").agg(F.count("*").alias("n"))
    return passes.face_match(rows, frames, clusters, counts, fps=1.0, ratio=0.25, width=40.0)


def face_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty frames of two tracks in each segment, the second after the first; tracks of three faces, which speakers share unevenly."""
    rows = _spoken(spark, sf_dir).withColumn("speaker", F.when(F.col("seg_ord") % 11 == 5, F.lit("SPEAKER_BG1")).otherwise(F.concat("speaker", F.floor(F.col("seg_ord") / 40).cast("string"))))
    seen = rows.select("clip_id", "seg_ord", "start", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    track = F.when(F.col("k") < F.col("seg_ord") % 40, F.col("seg_ord") % 20).otherwise(F.col("seg_ord") * 7 % 20)
    frames = seen.select("clip_id", track.alias("track_id"), (F.floor(F.col("start") * 4) + F.col("k")).alias("frame"), ((F.col("seg_ord") + F.col("k") * 3) % 9 / 8.0).alias("score"))
    clusters = frames.select("clip_id", "track_id", (F.col("track_id") % 3).alias("cluster")).distinct()
    return passes.face_relabel(rows, frames, clusters, fps=4.0, least_score=0.25, ratio=0.4, hole=6, width=40.0)


def retry_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of 50 segments; speakers by type and other label, some of them outliers or background."""
    rows = views.on_one_clock(spark, sf_dir)
    kind = F.col("seg_ord") % 13
    name = F.when(kind == 4, F.lit("SPEAKER_BG")).when(kind % 3 == 0, F.concat(F.lit("SPEAKER_9"), kind.cast("string"))).otherwise(F.concat("speaker", "other"))
    few = rows.withColumn("clip_id", F.col("clip_id") * 1000 + F.floor(F.col("seg_ord") / 50)).withColumn("speaker", F.when(F.col("clip_id") % 4 == 0, F.col("other")).otherwise(name))
    return passes.retry_decision(few, _embed(spark, sf_dir))


def _dubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with what a dubbed row remembers."""
    c, n = views.chunks(spark, sf_dir), F.col("chunk_ord")
    made = {name: F.lit("x") for name in ("dub_error", "dub_input_signature", "dub_reference_wav", "tts_instruct_text", "translation_blocked_reason")}
    return c.select("clip_id", "chunk_id", "chunk_ord", "speaker", "text_src").withColumns(made).withColumns({
        "dub_stale": F.lit(False), "translation_blocked": F.lit(True), "tts_instruct_source": F.when(n % 2 == 0, "manual").otherwise("llm"),
        "reference_mode_override": F.when(n % 3 == 0, "self"), "reference_chunk_id_override": F.when(n % 3 == 1, "chunk_0000"),
    })


def edited_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = _dubbed(spark, sf_dir), F.col("chunk_ord")
    wanted = rows.filter("(clip_id + chunk_ord) % 5 < 3").select(
        "clip_id", "chunk_id", F.when(n % 4 == 0, " narrator ").when(n % 4 == 1, F.col("speaker")).alias("speaker"),
        F.when(n % 5 == 0, "auto").when(n % 5 == 1, "self").alias("reference_mode"), F.when(n % 7 == 0, " ").when(n % 7 == 1, "chunk_0009").alias("reference_chunk_id"),
    )
    out = edits.edit_speakers(rows, wanted)
    return out.select("clip_id", "chunk_id", "speaker", "speaker_original", "speaker_override", "reference_mode_override", "reference_chunk_id_override", "dub_stale", "dub_error", "dub_reference_wav")


def edited_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = _dubbed(spark, sf_dir), F.col("chunk_ord")
    scores = F.create_map(F.lit("joy"), n / 4.0, F.lit("anger"), 1.0 - n / 4.0, F.lit("none"), F.lit(None).cast("double"))
    wanted = rows.filter("(clip_id + chunk_ord) % 5 < 3").select(
        "clip_id", "chunk_id", F.when(n % 4 == 1, "calm").alias("emotion_label"), F.when(n % 2 == 0, scores).alias("emotion_scores"),
        F.when(n % 3 == 0, F.concat(F.lit("  slowly  日本 "), "speaker")).when(n % 3 == 1, "日本").alias("tts_instruct_text"),
    )
    out = edits.edit_emotions(rows, wanted, "Say:")
    return out.select("clip_id", "chunk_id", "emotion_label", "emotion_confidence", F.try_element_at("emotion_scores", F.lit("anger")).alias("anger"), "emotion_source", "tts_instruct_text", "tts_instruct_source", "dub_stale", "dub_input_signature")


def edited_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dubbed(spark, sf_dir)
    wanted = rows.filter("(clip_id + chunk_ord) % 5 < 3").select("clip_id", "chunk_id", F.when(F.col("chunk_ord") % 3 == 0, " ").otherwise(F.lower("text_src")).alias("text"))
    out = edits.edit_translations(rows, wanted)
    return out.select("clip_id", "chunk_id", "text_translated", "text_tts", "translation_blocked", "translation_blocked_reason", "dub_stale", "tts_instruct_text", "tts_instruct_source")


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each clip by the table function, and the longest pause of each speaker between them by the aggregate, all in SQL."""
    sql.register(spark)
    return spark.sql("""
        WITH turns AS (
          SELECT * FROM speaker_turns(TABLE(SELECT clip_id, speaker, start, end, seg_ord FROM {rows}) PARTITION BY clip_id ORDER BY (start, seg_ord))
        )
        SELECT * FROM (SELECT clip_id, speaker, count(*) AS turns, sum(segments) AS segments, max(end - start) AS longest FROM turns GROUP BY clip_id, speaker)
        JOIN (SELECT clip_id, speaker, longest_pause(start, end) AS pause FROM turns GROUP BY clip_id, speaker) USING (clip_id, speaker)
    """, rows=views.on_one_clock(spark, sf_dir).withColumn("clip_id", F.col("clip_id").cast("long")))  # fmt: skip


def interpolated_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots of 50 frames with one moving face, of which every seventh frame has no detection; faces of different sizes."""
    rows = views.on_one_clock(spark, sf_dir).filter("seg_ord % 7 <> 3")
    frame, shot = F.col("seg_ord") % 50, F.col("clip_id") * 20 + F.floor(F.col("seg_ord") / 50)
    x, size = frame * 0.5 + F.col("seg_ord") % 3, 40.0 + shot % 5 * 20.0
    boxes = rows.select(shot.cast("long").alias("shot_id"), frame.cast("long").alias("frame"), F.array(x, x + 1, x + size, x + 1 + size / 2).alias("bbox"))
    out = visual.interpolated(visual.track_boxes(boxes), 70.0)
    return out.select("shot_id", "track", "frame", *[F.round(F.get("bbox", F.lit(i)), 9).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def file_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders in files of twenty parts, a third of which is written again: what is stale."""
    orders = views.table(spark, sf_dir, "orders").withColumn("part", (F.col("o_orderkey") % 20).cast("int"))
    rows = orders.groupBy("part").agg(F.sum("o_totalprice").alias("total")).withColumn("file", F.concat(F.lit("part="), F.col("part").cast("string")))
    path = table_path(spark, "order-parts")

    def signed() -> DataFrame:
        listed = tables.artifacts(spark, f"{path}/part=*/*.parquet").groupBy(F.regexp_extract("path", r"part=\d+", 0).alias("path")).agg(F.sum("length").alias("length"), F.max("modified").alias("modified"))
        return written(timeline.file_signature(rows, listed, "file", ["total"]), "signed-files")

    orders.repartition("part").write.partitionBy("part").parquet(path)
    before = signed().withColumn("output", F.lit("x"))
    again = orders.filter("part % 3 = 0").repartition("part")
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return timeline.staleness(signed(), before, ["part"]).select("part", "state")


def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second labelling against the first, with expectations in windows from every segment on."""
    rows = views.on_one_clock(spark, sf_dir)
    wanted = rows.select(
        "clip_id", F.col("seg_ord").cast("string").alias("id"), F.when(F.col("seg_ord") % 3 == 0, "single_role").when(F.col("seg_ord") % 3 == 1, "ordered_roles").otherwise("non_asr").alias("kind"),
        "start", (F.col("start") + 120.0).alias("end"), F.lit(None).cast("double").alias("weight"), F.col("other").alias("role"), F.array("other", F.lit(None).cast("string")).alias("roles"),
    )
    out = evaluate.full_report(rows, CLIP, rows.withColumn("speaker", F.col("other")), wanted, step=0.5, short=10.0, width=40.0, whole=views.ROLES, least_coverage=0.1)
    a, b, m, t = (F.col(c) for c in ("prediction", "reference", "reference_metrics", "targeted"))
    return out.select(
        "clip_id", a.n_segments.alias("n_segments"), a.n_speakers.alias("n_speakers"), b.n_speakers.alias("reference_speakers"), F.round(a.coverage, 9).alias("coverage"), F.round(a.entropy, 9).alias("entropy"),
        F.round(m.der, 9).alias("der"), m.count_error.alias("count_error"), t.passed_count.alias("passed_count"), t.expectation_count.alias("expectation_count"), F.round(t.score, 9).alias("score"),
        F.round(F.try_element_at(t.by_kind, F.lit("ordered_roles")), 9).alias("ordered_score"), F.size(t.failures).cast("long").alias("failures"), F.size(t.roles).alias("roles"),
    )


def sequence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where m0, then m2, then any label and then m1 follow each other among twenty neighbours."""
    rows = views.on_one_clock(spark, sf_dir).withColumn("clip_id", F.col("clip_id") * 1000 + F.floor(F.col("seg_ord") / 20))
    labels = rows.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", "other"))), lambda x: x.other).alias("labels"))
    wanted = F.array(F.lit("m0"), F.lit("m2"), F.lit(None).cast("string"), F.lit("m1"))
    return labels.select("clip_id", F.array_join(evaluate.sequence_places(F.col("labels"), wanted), ",").alias("places"))


def minted_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.on_one_clock(spark, sf_dir).withColumnRenamed("seg_ord", "chunk_ord").select("clip_id", "chunk_ord", "speaker")
    n = F.col("chunk_ord")
    shown = rows.filter(n % 5 < 4).select("clip_id", "chunk_ord", F.pmod(n * n, F.lit(7)).alias("face"))
    return speakers.mint_by_faces(rows, shown, rows.select("clip_id", "chunk_ord", (n % 10 / 10.0).alias("own_sim"))).select("clip_id", "chunk_ord", "speaker")


def stage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named stages in order, one of them skipped, from the second on."""
    for name, stage in (
        ("nothing", lambda d: d.limit(0)), ("least_5s", lambda d: d.filter(F.col("end") - F.col("start") >= 5)), ("upper", lambda d: d.withColumn("speaker", F.upper("speaker"))),
        ("later", lambda d: d.withColumn("start", F.col("start") + 1)),
    ):
        if name not in registry.stages.names():
            registry.stages.add(name, stage)
    rows = views.on_one_clock(spark, sf_dir).select("clip_id", "seg_ord", "speaker", "start", "end")
    return registry.run_stages(rows, ["nothing", "later", "upper", "least_5s"], skip=["upper"], first="later")


QUERIES = {f.__name__: f for f in (full_report, sequence_places, minted_speakers, stage_chain, sql_functions, interpolated_tracks, file_signatures, edited_speakers, edited_emotions, edited_translations, sweep_resumed, visual_split, focused_split, face_match, face_relabel, retry_decision)}

_TRIALS = ", ".join(f"({i}, {t['gap']}::DOUBLE, {t['least']}::DOUBLE)" for i, t in enumerate(TRIALS, 1))

# The vector of a stretch, and neighbours of one speaker joined.
_VOICE = "vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_VEC = '(floor({r}.start * 8)::BIGINT + 31 * floor({r}."end" * 8)::BIGINT + 7 * {r}.clip_id) % (SELECT count(*) FROM embeddings)'
_JOINED = """q AS (
  SELECT *, coalesce(lag(speaker) OVER w = speaker AND start - lag("end") OVER w <= 0.1, false) AS same FROM u WINDOW w AS (PARTITION BY clip_id ORDER BY start, k, o, n)
), y AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY clip_id ORDER BY start, k, o, n) AS run FROM q)
SELECT clip_id, run::BIGINT AS seg_ord, arg_min(speaker, (start, k, o, n)) AS speaker, min(start) AS start, arg_max("end", (start, k, o, n)) AS "end",
  coalesce(string_agg(text, ' ' ORDER BY start, k, o, n) FILTER (text <> ''), '') AS text, arg_min(origin, (start, k, o, n)) AS origin FROM y GROUP BY clip_id, run"""

_EDITED = f"""WITH {CHUNKS}, r AS (
  SELECT *, (clip_id + chunk_ord) % 5 < 3 AS hit, CASE WHEN chunk_ord % 2 = 0 THEN 'manual' ELSE 'llm' END AS src,
    CASE WHEN chunk_ord % 3 = 0 THEN 'self' END AS mode0, CASE WHEN chunk_ord % 3 = 1 THEN 'chunk_0000' END AS ref0 FROM chunks
)"""

# The error where the second labelling is the reference: the query of the other direction with the names turned around.
_DER = interval_queries.ORACLE_SQL["der"]
for _old, _new in (
    ("arg_min(speaker, start) AS ref, arg_min(other, start) AS pred", "arg_min(other, start) AS ref, arg_min(speaker, start) AS pred"),
    ("a.pred = 'm0' AND b.pred = 'm1' AND a.ref <> b.ref", "a.ref = 'm0' AND b.ref = 'm1' AND a.pred <> b.pred"),
    ("c.pred = 'm2' AND c.ref <> a.ref AND c.ref <> b.ref", "c.ref = 'm2' AND c.pred <> a.pred AND c.pred <> b.pred"),
):
    _DER = _DER.replace(_old, _new)

ORACLE_SQL = {
    "edited_speakers": _EDITED + """, e AS (
  SELECT *, hit AND chunk_ord % 4 = 0 AS renamed, CASE WHEN hit AND chunk_ord % 5 = 0 THEN 'auto' WHEN hit AND chunk_ord % 5 = 1 THEN 'self' END AS m,
    CASE WHEN hit AND chunk_ord % 7 = 0 THEN '' WHEN hit AND chunk_ord % 7 = 1 THEN 'chunk_0009' END AS f FROM r
), n AS (
  SELECT *, CASE WHEN m = 'auto' THEN NULL ELSE coalesce(m, mode0) END AS mode1, CASE WHEN f = '' THEN NULL WHEN f IS NOT NULL THEN f WHEN m IS NOT NULL THEN NULL ELSE ref0 END AS ref1 FROM e
), c AS (SELECT *, hit AND (renamed OR mode1 IS DISTINCT FROM mode0 OR ref1 IS DISTINCT FROM ref0) AS changed FROM n)
SELECT clip_id, chunk_id, CASE WHEN renamed THEN 'narrator' ELSE speaker END AS speaker, CASE WHEN renamed THEN speaker END AS speaker_original, CASE WHEN renamed THEN true END AS speaker_override,
  mode1 AS reference_mode_override, ref1 AS reference_chunk_id_override, changed AS dub_stale, CASE WHEN NOT changed THEN 'x' END AS dub_error, CASE WHEN NOT changed THEN 'x' END AS dub_reference_wav FROM c""",
    "edited_emotions": _EDITED + """, e AS (
  SELECT *, hit AND chunk_ord % 2 = 0 AS scored, hit AND chunk_ord % 4 = 1 AS named, hit AND chunk_ord % 3 < 2 AS told,
    greatest(0, least(1, chunk_ord / 4.0::DOUBLE)) AS joy, greatest(0, least(1, 1 - chunk_ord / 4.0::DOUBLE)) AS anger FROM r
), d AS (SELECT *, (scored OR named) AND NOT told AND src <> 'manual' AS dropped FROM e)
SELECT clip_id, chunk_id, CASE WHEN named THEN 'calm' WHEN scored THEN CASE WHEN joy > anger THEN 'joy' ELSE 'anger' END END AS emotion_label,
  CASE WHEN scored THEN greatest(joy, anger) END AS emotion_confidence, CASE WHEN scored THEN anger END AS anger, CASE WHEN scored OR named THEN 'manual' END AS emotion_source,
  CASE WHEN told THEN CASE WHEN chunk_ord % 3 = 0 THEN 'Say: slowly ' || speaker END WHEN NOT dropped THEN 'x' END AS tts_instruct_text,
  CASE WHEN told THEN CASE WHEN chunk_ord % 3 = 0 THEN 'manual' END WHEN NOT dropped THEN src END AS tts_instruct_source,
  scored OR named OR told AS dub_stale, CASE WHEN NOT (scored OR named OR told) THEN 'x' END AS dub_input_signature FROM d""",
    "edited_translations": _EDITED + """, e AS (SELECT *, CASE WHEN hit THEN CASE WHEN chunk_ord % 3 = 0 THEN ' ' ELSE lower(text_src) END END AS t FROM r)
SELECT clip_id, chunk_id, t AS text_translated, t AS text_tts, CASE WHEN t IS NULL OR NOT regexp_matches(t, '\\S') THEN true END AS translation_blocked,
  CASE WHEN t IS NULL OR NOT regexp_matches(t, '\\S') THEN 'x' END AS translation_blocked_reason, t IS NOT NULL AS dub_stale,
  CASE WHEN t IS NULL THEN 'x' END AS tts_instruct_text, CASE WHEN t IS NULL THEN src END AS tts_instruct_source FROM e""",
    "sweep_resumed": f"""WITH {CLOCK}, t(trial, gap, least) AS (VALUES {_TRIALS}), a AS (
  SELECT clk.*, t.*, lag(speaker) OVER w IS DISTINCT FROM speaker AS switched FROM clk, t WINDOW w AS (PARTITION BY clip_id, trial ORDER BY start, seg_ord)
), b AS (SELECT *, sum(switched::INT) OVER (PARTITION BY clip_id, trial ORDER BY start, seg_ord) AS stretch FROM a),
c AS (
  SELECT *, switched OR start - max("end") OVER (PARTITION BY clip_id, trial, stretch ORDER BY start, seg_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > gap AS new FROM b
), d AS (SELECT *, sum(new::INT) OVER (PARTITION BY clip_id, trial ORDER BY start, seg_ord) AS island FROM c),
g AS (SELECT clip_id, trial, gap, least, island, max("end") - min(start) AS l FROM d GROUP BY ALL),
r AS (
  SELECT clip_id, trial, gap, count(*) FILTER (l >= least) AS chunks, coalesce(sum(l) FILTER (l >= least), 0) AS speech,
    coalesce(avg((l < 2 * least)::INT) FILTER (l >= least), 0) AS short_share FROM g GROUP BY ALL
)
SELECT clip_id, trial, CASE WHEN trial <= 3 THEN 1 ELSE 2 END AS attempt, CASE WHEN gap < 0 THEN 'failed' WHEN trial <= 3 THEN 'skipped' ELSE 'done' END AS status,
  CASE WHEN gap < 0 THEN 'ValueError: gap is negative' END AS error, CASE WHEN gap >= 0 THEN chunks END AS chunks, CASE WHEN gap >= 0 THEN speech END AS speech,
  CASE WHEN gap >= 0 THEN round(short_share, 9) END AS short_share FROM r""",
    "visual_split": f"""WITH {CLOCK}, {_VOICE}, s AS (
  SELECT clip_id, seg_ord, speaker, start, "end", ['' || seg_ord, 'one', 'two', 'three', 'four', 'five', 'six'] AS w FROM clk
), runs AS (SELECT clip_id, seg_ord AS track, start + 6.25::DOUBLE AS start, start + 6.25::DOUBLE + ("end" - start) / 2 AS "end" FROM clk),
c0 AS (SELECT clip_id, speaker, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s JOIN vec ON vec.id = {_VEC.format(r="s")} WHERE "end" - start >= 0.5),
c1 AS (SELECT clip_id, speaker, i, avg(x) AS x FROM c0 GROUP BY ALL), c2 AS (SELECT clip_id, speaker, list(x ORDER BY i) AS c FROM c1 GROUP BY ALL),
cent AS (SELECT clip_id, speaker AS label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c2),
reg AS (
  SELECT s.clip_id, s.seg_ord, s.speaker, r.track, greatest(s.start, r.start) AS start, least(s."end", r."end") AS "end"
  FROM s JOIN runs r ON r.clip_id = s.clip_id AND r.start < s."end" AND s.start < r."end" WHERE least(s."end", r."end") - greatest(s.start, r.start) >= 0.4
), sim AS (SELECT reg.*, label, list_dot_product(v, c) AS sim FROM reg JOIN vec ON vec.id = {_VEC.format(r="reg")} JOIN cent ON cent.clip_id = reg.clip_id),
best AS (
  SELECT clip_id, seg_ord, speaker, track, start, "end", arg_min(label, (-sim, label)) AS best, max(sim) AS bs, max(sim) FILTER (label = speaker) AS os FROM sim GROUP BY ALL
), cut AS (
  SELECT * FROM best WHERE best <> speaker AND bs >= 0.15 AND bs > os + 0.1 QUALIFY row_number() OVER (PARTITION BY clip_id, seg_ord ORDER BY bs - os DESC, start, "end", track) = 1
), j AS (
  SELECT s.*, cut.start AS a, cut."end" AS b, best, (cut.start - s.start) / (s."end" - s.start) AS lo, (cut."end" - s.start) / (s."end" - s.start) AS hi FROM s LEFT JOIN cut ON cut.clip_id = s.clip_id AND cut.seg_ord = s.seg_ord
), p AS (
  SELECT clip_id, seg_ord AS o, 0 AS k, 0 AS n, start, "end", speaker, array_to_string(w, ' ') AS text, 'kept' AS origin FROM j WHERE a IS NULL
  UNION ALL SELECT clip_id, seg_ord, 0, 0, start, a, speaker, array_to_string(w[1:round_even(7 * lo, 0)::INT], ' '), 'cut' FROM j WHERE a - start >= 0.2
  UNION ALL SELECT clip_id, seg_ord, 0, 1, a, b, best, array_to_string(w[round_even(7 * lo, 0)::INT + 1:round_even(7 * hi, 0)::INT], ' '), 'visual' FROM j WHERE a IS NOT NULL
  UNION ALL SELECT clip_id, seg_ord, 0, 2, b, "end", speaker, array_to_string(w[round_even(7 * hi, 0)::INT + 1:7], ' '), 'cut' FROM j WHERE "end" - b >= 0.2
), h0 AS (SELECT *, lag("end") OVER (PARTITION BY clip_id ORDER BY start, k, o, n) AS prev FROM p),
h AS (
  SELECT clip_id, coalesce(prev, 0.0) AS start, start AS "end" FROM h0 WHERE (prev IS NULL AND start > 0.3) OR start - prev >= 0.5
  UNION ALL SELECT clip_id, arg_max("end", (start, k, o, n)) AS e, 30100.0 FROM p GROUP BY clip_id HAVING 30100.0 - e >= 0.5
), g AS (
  SELECT h.clip_id, r.track, greatest(h.start, r.start) AS start, least(h."end", r."end") AS "end" FROM h JOIN runs r ON r.clip_id = h.clip_id AND r.start < h."end" AND h.start < r."end"
  WHERE least(h."end", r."end") - greatest(h.start, r.start) >= 0.5
), gs AS (SELECT g.*, label, list_dot_product(v, c) AS sim FROM g JOIN vec ON vec.id = {_VEC.format(r="g")} JOIN cent ON cent.clip_id = g.clip_id),
ga AS (SELECT clip_id, track, start, "end", arg_min(label, (-sim, label)) AS speaker, max(sim) AS bs FROM gs GROUP BY ALL HAVING max(sim) >= 0.15),
u AS (SELECT * FROM p UNION ALL SELECT clip_id, track, 1, 0, start, "end", speaker, '', 'gap' FROM ga), {_JOINED}""",
    "face_match": f"""WITH {CLOCK}, s AS (
  SELECT clip_id, seg_ord, CASE WHEN seg_ord % 11 = 5 THEN 'SPEAKER_BG1' ELSE speaker END AS speaker, start, "end", seg_ord || ' one two three four five six' AS text FROM clk
), fr AS (SELECT clip_id, seg_ord % 50 AS track, speaker, seg_ord, floor(start)::BIGINT + 3 * k AS f, (seg_ord * 7 + k * 3) % 10 / 8.0::DOUBLE AS score FROM s, range(10) t(k)),
per AS (SELECT clip_id, track % 7 AS cluster, speaker, count(*) AS n FROM fr GROUP BY ALL),
own AS (SELECT clip_id, cluster, arg_min(speaker, (-n, speaker)) AS owner, max(n) / sum(n) AS ratio FROM per GROUP BY ALL),
m AS (
  SELECT s.clip_id, s.seg_ord, fr.track, count(*) AS n, avg(score) AS mean FROM s JOIN fr ON fr.clip_id = s.clip_id AND fr.f BETWEEN floor(s.start)::BIGINT AND floor(s."end")::BIGINT
  WHERE NOT starts_with(s.speaker, 'SPEAKER_BG') GROUP BY ALL HAVING count(*) >= 3 AND avg(score) >= 0.5
), b AS (
  SELECT m.clip_id, m.seg_ord, arg_min(owner, (-mean, track)) AS owner, arg_min(ratio, (-mean, track)) AS ratio FROM m JOIN own ON own.clip_id = m.clip_id AND own.cluster = m.track % 7 GROUP BY ALL
), u AS (
  SELECT s.clip_id, s.seg_ord AS o, 0 AS k, 0 AS n, start, "end", CASE WHEN ratio >= 0.25 THEN owner ELSE speaker END AS speaker, text,
    CASE WHEN ratio >= 0.25 AND owner <> speaker THEN 'face' ELSE 'kept' END AS origin FROM s LEFT JOIN b ON b.clip_id = s.clip_id AND b.seg_ord = s.seg_ord
), {_JOINED}""",
    "retry_decision": f"""WITH {CLOCK}, {_VOICE}, s AS (
  SELECT clip_id * 1000 + seg_ord // 50 AS clip_id, seg_ord, CASE WHEN (clip_id * 1000 + seg_ord // 50) % 4 = 0 THEN other WHEN seg_ord % 13 = 4 THEN 'SPEAKER_BG'
    WHEN seg_ord % 13 % 3 = 0 THEN 'SPEAKER_9' || (seg_ord % 13) ELSE speaker || other END AS speaker, start, "end" FROM clk
), real AS (SELECT *, starts_with(speaker, 'SPEAKER_9') AS far FROM s WHERE NOT starts_with(speaker, 'SPEAKER_BG')),
z AS (SELECT clip_id, count(*) AS n_segments FROM s GROUP BY 1),
c AS (SELECT clip_id, count(DISTINCT speaker) FILTER (NOT far) AS n_main, count(DISTINCT speaker) FILTER (far) AS n_outlier FROM real GROUP BY 1),
l AS (SELECT * FROM real QUALIFY row_number() OVER (PARTITION BY clip_id, speaker ORDER BY "end" - start DESC, start, seg_ord) = 1),
v AS (SELECT clip_id, speaker, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-9::DOUBLE)) AS v FROM l JOIN vec ON vec.id = {_VEC.format(r="l")}),
p AS (SELECT a.clip_id, list_dot_product(a.v, b.v) AS sim FROM v a JOIN v b ON a.clip_id = b.clip_id AND a.speaker < b.speaker),
d AS (SELECT clip_id, round_even(1 - avg(sim), 3) AS voice_diversity, count(*) FILTER (sim < 0.5) AS distinct_pairs FROM p GROUP BY 1),
o AS (SELECT z.clip_id, n_segments, coalesce(n_main, 0) AS n_main, coalesce(n_outlier, 0) AS n_outlier, coalesce(voice_diversity, 0) AS voice_diversity, coalesce(distinct_pairs, 0) AS distinct_pairs FROM z LEFT JOIN c USING (clip_id) LEFT JOIN d USING (clip_id)),
x AS (
  SELECT *, CASE WHEN n_main + n_outlier < 5 THEN 'retry_higher' WHEN n_main + n_outlier > 12 THEN 'retry_lower' WHEN n_outlier > 2 * n_main AND n_main <= 2 THEN 'retry_lower'
    WHEN n_main <= 4 AND voice_diversity >= 0.4 THEN 'retry_higher' ELSE 'accept' END AS action FROM o
) SELECT *, CASE action WHEN 'accept' THEN 0.4 WHEN 'retry_lower' THEN 0.3 ELSE 0.5 END::DOUBLE AS threshold FROM x""",
    "face_relabel": f"""WITH {CLOCK}, s AS (
  SELECT clip_id, seg_ord, CASE WHEN seg_ord % 11 = 5 THEN 'SPEAKER_BG1' ELSE speaker || (seg_ord // 40) END AS speaker, start, "end" FROM clk
), fr AS (
  SELECT clip_id, CASE WHEN k < seg_ord % 40 THEN seg_ord % 20 ELSE seg_ord * 7 % 20 END AS track, floor(start * 4)::BIGINT + k AS f, (seg_ord + k * 3) % 9 / 8.0::DOUBLE AS score FROM s, range(40) t(k)
), m AS (
  SELECT s.clip_id, s.seg_ord, s.speaker, s.start, s."end", fr.track, fr.track % 3 AS c, fr.f, fr.score, score >= 0.25 AS live FROM s JOIN fr ON fr.clip_id = s.clip_id
    AND fr.f BETWEEN floor(s.start * 4)::BIGINT AND floor(s."end" * 4)::BIGINT WHERE NOT starts_with(s.speaker, 'SPEAKER_BG')
), per AS (SELECT clip_id, speaker, c, count(*) AS n FROM m WHERE live GROUP BY ALL),
mn AS (SELECT clip_id, speaker, arg_min(c, (-n, c)) AS c, max(n) AS most, sum(n) AS a FROM per GROUP BY ALL HAVING max(n) >= 5 AND max(n) / sum(n) >= 0.4),
own AS (SELECT clip_id, c, min(speaker) AS owner FROM mn GROUP BY ALL),
tr AS (SELECT clip_id, seg_ord, speaker, track, c, count(*) FILTER (live) AS n, sum(score) AS s FROM m GROUP BY ALL HAVING count(*) FILTER (live) >= 5),
best AS (SELECT clip_id, seg_ord, speaker, arg_min(c, (-s / n, track)) AS c FROM tr GROUP BY ALL),
st AS (SELECT clip_id, speaker, c, count(*) AS n FROM best GROUP BY ALL HAVING count(*) >= 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY clip_id, speaker ORDER BY n DESC, c) AS r FROM st),
sp AS (SELECT b.clip_id, b.seg_ord, b.speaker || '_v' || b.c AS spread FROM best b JOIN rk ON rk.clip_id = b.clip_id AND rk.speaker = b.speaker AND rk.c = b.c WHERE r > 1),
mt AS (SELECT b.clip_id, b.seg_ord, owner AS "match" FROM best b JOIN own ON own.clip_id = b.clip_id AND own.c = b.c),
l AS (SELECT *, lag(c) OVER w IS NOT DISTINCT FROM c AND f - lag(f) OVER w <= 6 AS j FROM m WHERE live AND "end" - start >= 1.5 WINDOW w AS (PARTITION BY clip_id, seg_ord ORDER BY f, c)),
l2 AS (SELECT *, sum((NOT j)::INT) OVER (PARTITION BY clip_id, seg_ord ORDER BY f, c) AS run FROM l),
ru AS (SELECT clip_id, seg_ord, run, any_value(c) AS c, min(f) AS lo, max(f) AS hi FROM l2 GROUP BY ALL HAVING max(f) - min(f) + 1 >= 5),
r2 AS (SELECT *, lag(c) OVER (PARTITION BY clip_id, seg_ord ORDER BY run) IS NOT DISTINCT FROM c AS same FROM ru),
r3 AS (SELECT *, lead(lo) OVER w AS nx, row_number() OVER w - 1 AS part FROM r2 WHERE NOT same WINDOW w AS (PARTITION BY clip_id, seg_ord ORDER BY run)),
p AS (
  SELECT r3.*, CASE WHEN part = 0 THEN s.start ELSE lo / 4.0::DOUBLE END AS a, coalesce(nx / 4.0::DOUBLE, s."end") AS b FROM r3 JOIN s ON s.clip_id = r3.clip_id AND s.seg_ord = r3.seg_ord
), p2 AS (SELECT *, count(*) OVER (PARTITION BY clip_id, seg_ord) AS k FROM p WHERE b - a >= 0.2),
p3 AS (SELECT p2.clip_id, p2.seg_ord, part, a, b, owner FROM p2 LEFT JOIN own ON own.clip_id = p2.clip_id AND own.c = p2.c WHERE k >= 2)
SELECT s.clip_id, s.seg_ord, coalesce(part, 0)::INT AS part, CASE WHEN part IS NOT NULL THEN coalesce(owner, speaker) ELSE coalesce(spread, "match", speaker) END AS speaker, speaker AS audio_speaker,
  CASE WHEN part IS NOT NULL THEN round(a, 3) ELSE start END AS start, CASE WHEN part IS NOT NULL THEN round(b, 3) ELSE "end" END AS "end",
  CASE WHEN part IS NOT NULL THEN 'split' WHEN spread IS NOT NULL THEN 'spread' WHEN "match" <> speaker THEN 'match' ELSE 'kept' END AS origin
FROM s LEFT JOIN sp ON sp.clip_id = s.clip_id AND sp.seg_ord = s.seg_ord LEFT JOIN mt ON mt.clip_id = s.clip_id AND mt.seg_ord = s.seg_ord LEFT JOIN p3 ON p3.clip_id = s.clip_id AND p3.seg_ord = s.seg_ord""",
    "sql_functions": f"""WITH {CLOCK}, a AS (SELECT *, lag(speaker) OVER w IS DISTINCT FROM speaker AS new FROM clk WINDOW w AS (PARTITION BY clip_id ORDER BY start, seg_ord)),
b AS (SELECT *, sum(new::INT) OVER (PARTITION BY clip_id ORDER BY start, seg_ord) AS turn FROM a),
t AS (SELECT clip_id, turn, any_value(speaker) AS speaker, min(start) AS start, max("end") AS "end", count(*) AS segments FROM b GROUP BY clip_id, turn),
p AS (SELECT *, start - max("end") OVER (PARTITION BY clip_id, speaker ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pause FROM t)
SELECT clip_id, speaker, count(*) AS turns, sum(segments)::BIGINT AS segments, max("end" - start) AS longest, greatest(0, coalesce(max(pause), 0))::DOUBLE AS pause FROM p GROUP BY ALL""",
    "interpolated_tracks": f"""WITH {CLOCK}, b AS (
  SELECT clip_id * 20 + seg_ord // 50 AS shot_id, seg_ord % 50 AS frame, (seg_ord % 50) * 0.5::DOUBLE + seg_ord % 3 AS x FROM clk WHERE seg_ord % 7 <> 3
), n AS (SELECT *, 40.0::DOUBLE + shot_id % 5 * 20.0::DOUBLE AS size, lead(frame) OVER w AS nf, lead(x) OVER w AS nx FROM b WINDOW w AS (PARTITION BY shot_id ORDER BY frame)),
e AS (SELECT shot_id, size, unnest(range(frame, coalesce(nf, frame + 1))) AS f, frame, x, nf, nx FROM n WHERE size > 70),
i AS (SELECT shot_id, size, f, CASE WHEN nf IS NULL THEN x ELSE x + (nx - x) * ((f - frame) / (nf - frame)::DOUBLE) END AS x FROM e)
SELECT shot_id, 0 AS track, f AS frame, round(x, 9) AS x1, round(x + 1, 9) AS y1, round(x + size, 9) AS x2, round(x + 1 + size / 2, 9) AS y2 FROM i""",
    "file_signatures": "SELECT DISTINCT (o_orderkey % 20)::INT AS part, CASE WHEN o_orderkey % 20 % 3 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM orders",
    "focused_split": f"""WITH {CLOCK}, {_VOICE}, s AS (
  SELECT clip_id, seg_ord, speaker, start, "end", ['' || seg_ord, 'one', 'two', 'three', 'four', 'five', 'six'] AS w FROM clk
), c0 AS (SELECT clip_id, speaker, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s JOIN vec ON vec.id = {_VEC.format(r="s")} WHERE "end" - start >= 0.5),
c1 AS (SELECT clip_id, speaker, i, avg(x) AS x FROM c0 GROUP BY ALL), c2 AS (SELECT clip_id, speaker, list(x ORDER BY i) AS c FROM c1 GROUP BY ALL),
cent AS (SELECT clip_id, speaker AS label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c2),
pt AS (
  SELECT clip_id, seg_ord, (k * (seg_ord % 3 + 1) % 4) // 2 AS label, start + k * (2.0::DOUBLE + seg_ord % 7 / 2.0::DOUBLE) - 0.5 AS a, start + (k + 1) * (2.0::DOUBLE + seg_ord % 7 / 2.0::DOUBLE) - 0.625 AS b
  FROM s, range(6) t(k)
), p1 AS (SELECT *, coalesce(lag(label) OVER w = label AND a - lag(b) OVER w <= 0.2, false) AS same FROM pt WINDOW w AS (PARTITION BY clip_id, seg_ord ORDER BY a, b)),
p2 AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY clip_id, seg_ord ORDER BY a, b) AS run FROM p1),
p3 AS (SELECT clip_id, seg_ord, run, any_value(label) AS label, min(a) AS a, max(b) AS b FROM p2 GROUP BY ALL),
p4 AS (
  SELECT s.clip_id, s.seg_ord, greatest(a, s.start) AS start, least(b, s."end") AS "end" FROM p3 JOIN s ON s.clip_id = p3.clip_id AND s.seg_ord = p3.seg_ord
  WHERE s."end" - s.start >= 1.5 AND least(b, s."end") - greatest(a, s.start) >= 0.4 AND (s.clip_id, s.seg_ord) IN (SELECT (clip_id, seg_ord) FROM p3 GROUP BY clip_id, seg_ord HAVING count(DISTINCT label) >= 2)
), p5 AS (SELECT p4.*, label, list_dot_product(v, c) AS sim FROM p4 JOIN vec ON vec.id = {_VEC.format(r="p4")} JOIN cent ON cent.clip_id = p4.clip_id),
p6 AS (SELECT clip_id, seg_ord, start, "end", arg_min(label, (-sim, label)) AS best FROM p5 GROUP BY ALL),
p7 AS (SELECT *, count(*) OVER w AS n, sum("end" - start) OVER w AS total, row_number() OVER (PARTITION BY clip_id, seg_ord ORDER BY start, "end") AS i FROM p6 WINDOW w AS (PARTITION BY clip_id, seg_ord)),
sv AS (SELECT clip_id, seg_ord FROM p6 GROUP BY ALL HAVING count(DISTINCT best) >= 2),
p8 AS (SELECT p7.*, greatest(1, round_even(7 * ("end" - start) / total, 0)::INT) AS take FROM p7 SEMI JOIN sv USING (clip_id, seg_ord)),
p9 AS (SELECT *, coalesce(sum(take) OVER (PARTITION BY clip_id, seg_ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS skip FROM p8),
now AS (
  SELECT s.clip_id, s.seg_ord AS o, 0 AS k, 0::BIGINT AS n, start, "end", speaker, array_to_string(w, ' ') AS text, 'kept' AS origin FROM s ANTI JOIN sv USING (clip_id, seg_ord)
  UNION ALL SELECT p9.clip_id, p9.seg_ord, 0, i, p9.start, p9."end", best, coalesce(array_to_string(w[(skip + 1):(CASE WHEN i = n THEN 7 ELSE skip + take END)], ' '), ''), 'focused' FROM p9 JOIN s ON s.clip_id = p9.clip_id AND s.seg_ord = p9.seg_ord
), h0 AS (SELECT *, lag("end") OVER (PARTITION BY clip_id ORDER BY start, k, o, n) AS prev FROM now),
h AS (
  SELECT clip_id, coalesce(prev, 0.0) AS start, start AS "end" FROM h0 WHERE (prev IS NULL AND start >= 2) OR start - prev >= 2
  UNION ALL SELECT clip_id, arg_max("end", (start, k, o, n)) AS e, 30100.0 FROM now GROUP BY clip_id HAVING 30100.0 - e >= 2
), g AS (
  SELECT DISTINCT h.clip_id, greatest(h.start, s."end" + 1.5) AS start, least(h."end", s."end" + 6.25) AS "end" FROM h JOIN s ON s.clip_id = h.clip_id AND s."end" + 1.5 < h."end" AND h.start < s."end" + 6.25
  WHERE least(h."end", s."end" + 6.25) - greatest(h.start, s."end" + 1.5) >= 0.4
), gv0 AS (SELECT g.*, label, list_dot_product(v, c) AS sim FROM g JOIN vec ON vec.id = {_VEC.format(r="g")} JOIN cent ON cent.clip_id = g.clip_id),
gv AS (SELECT clip_id, start, "end", arg_min(label, (-sim, label)) AS best FROM gv0 GROUP BY ALL),
f AS (SELECT clip_id, floor(start) + k AS t, 100.0::DOUBLE + (seg_ord * 13 + k) % 90 AS f0 FROM s, range(30) t(k) WHERE (seg_ord + k) % 5 > 0),
sp AS (SELECT s.clip_id, s.seg_ord, s.speaker, median(f0) AS f0 FROM s JOIN f ON f.clip_id = s.clip_id AND f.t >= s.start AND f.t < s."end" WHERE s."end" - s.start >= 1 GROUP BY ALL HAVING count(*) >= 3),
us AS (SELECT clip_id, speaker, median(f0) AS usual FROM sp GROUP BY ALL),
gf AS (SELECT g.clip_id, g.start, g."end", median(f0) AS f0 FROM g JOIN f ON f.clip_id = g.clip_id AND f.t >= g.start AND f.t < g."end" GROUP BY ALL HAVING count(*) >= 3),
gt AS (SELECT gf.clip_id, gf.start, gf."end", arg_min(speaker, (abs(f0 - usual), speaker)) AS tone, any_value(f0) > max(usual) + 5 AS above FROM gf JOIN us ON us.clip_id = gf.clip_id GROUP BY ALL),
u AS (
  SELECT * FROM now UNION ALL SELECT gv.clip_id, 0, 1, 0, gv.start, gv."end", CASE WHEN coalesce(above, false) THEN tone ELSE best END, '', 'gap'
  FROM gv LEFT JOIN gt ON gt.clip_id = gv.clip_id AND gt.start = gv.start AND gt."end" = gv."end"
), {_JOINED}""",
    "full_report": f"""WITH a AS ({interval_queries.ORACLE_SQL["structure_profile"]}), d AS ({_DER}), x AS ({data_sql.ORACLE_SQL["expectations"]})
SELECT a.clip_id, n_segments, n_speakers, 3::BIGINT AS reference_speakers, coverage, entropy, d.der, d.count_error, t.passed AS passed_count, t.expected AS expectation_count, t.score AS score,
  o.score AS ordered_score, t.expected - t.passed AS failures, 3 AS roles
FROM a JOIN d ON d.clip_id = a.clip_id JOIN x t ON t.clip_id = a.clip_id AND t.kind IS NULL JOIN x o ON o.clip_id = a.clip_id AND o.kind = 'ordered_roles'""",
    "sequence_places": f"""WITH {CLOCK}, l AS (SELECT clip_id * 1000 + seg_ord // 20 AS clip_id, list(other ORDER BY seg_ord) AS w FROM clk GROUP BY 1),
a AS (SELECT *, nullif(list_position(w, 'm0'), 0) AS p FROM l), b AS (SELECT *, p + nullif(list_position(w[p + 1:], 'm2'), 0) AS q FROM a),
c AS (SELECT *, q + 1 + nullif(list_position(w[q + 2:], 'm1'), 0) AS r FROM b)
SELECT clip_id, CASE WHEN r IS NOT NULL THEN concat_ws(',', p, q, q + 1, r) END AS places FROM c""",
    "minted_speakers": f"""WITH {CLOCK}, s AS (SELECT clip_id, seg_ord AS chunk_ord, speaker, CASE WHEN seg_ord % 5 < 4 THEN seg_ord * seg_ord % 7 END AS face FROM clk),
k AS (SELECT clip_id, speaker, face, count(*) AS k FROM s WHERE face IS NOT NULL GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY clip_id, speaker ORDER BY k DESC, face) AS r FROM k)
SELECT s.clip_id, chunk_ord, CASE WHEN r > 1 AND chunk_ord % 10 / 10.0::DOUBLE < 0.6 THEN s.speaker || '_m' || (r - 1) ELSE s.speaker END AS speaker
FROM s LEFT JOIN n ON n.clip_id = s.clip_id AND n.speaker = s.speaker AND n.face = s.face""",
    "stage_chain": f"""WITH {CLOCK} SELECT clip_id, seg_ord, speaker, start + 1 AS start, "end" FROM clk WHERE "end" - (start + 1) >= 5""",
}

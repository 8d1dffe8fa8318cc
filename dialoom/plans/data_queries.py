"""Queries of the text, gate, timeline, run, vector and set operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import text as X
from ..functions import vectors as V
from ..operators import evaluate, gates, runs, segments, speakers, timeline, visual, words
from ..streaming import progress
from . import views

EMOTIONS = ("click", "view", "purchase", "error", "signup")
KEY = ["clip_id", "chunk_ord"]


def _features(rows: DataFrame) -> DataFrame:
    """Chunks with made-up features: null for every fifth."""
    f = F.struct((F.col("chunk_ord") % 11 / 11.0).alias("silence_ratio"), (F.col("chunk_ord") % 4 / 8.0).alias("voiced_ratio"), (F.col("chunk_ord") % 9 / 100.0).alias("clipping_ratio"))
    return rows.withColumn("feature", F.when((F.col("clip_id") + F.col("chunk_ord")) % 5 != 0, f))


def _flat(rows: DataFrame, gate: str = "gate") -> DataFrame:
    return rows.withColumn("accepted", F.col(f"{gate}.accepted")).withColumn("flags", F.array_join(f"{gate}.critical_flags", ",")).withColumn(
        "warnings", F.array_join(f"{gate}.warnings", ",")).withColumn("score", F.col(f"{gate}.score")).drop(gate)


def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", X.spoken_characters(t).alias("characters"), X.word_count(t).alias("words"), X.repetition_ratio(t).alias("repetition"),
        X.first_token(t).alias("first_token"), F.length(X.content(t)).alias("content_length"), X.register(t).alias("register"), X.has_negative_word(t).alias("negative"),
    )


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir).withColumn("language", F.when(F.col("chunk_ord") % 2 == 0, "Korean").otherwise("English"))
    b = X.duration_budget(F.col("duration"), F.col("text_src"), F.col("language"), (F.col("chunk_ord") % 4).cast("int"))
    c = c.withColumn("b", b).withColumn("f", X.budget_fit(F.col("text_src"), F.col("language"), F.col("b")))
    return c.select(*KEY, "b.source_units", "b.min_units", "b.target_units", "b.max_units", "f.actual_units", "f.within_budget", "f.over_budget", "f.under_budget", "f.distance_from_target")


def speech_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir)
    seconds = X.speech_seconds(F.col("text_src"), F.lit("English"))
    c = c.withColumn("estimate", seconds)
    fit = gates.tempo_fit(F.col("estimate"), F.col("duration"), 0.8, 1.25)
    return c.select(*KEY, "estimate", gates.preflight(F.col("estimate"), F.col("duration")).ratio.alias("ratio"), gates.prompt_cap(F.col("estimate"), F.col("duration")).alias("cap"), fit.tempo.alias("tempo"), fit.action.alias("action"))


def asr_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _features(views.chunks(spark, sf_dir))
    return _flat(c.select(*KEY, gates.asr_gate(F.col("text_src"), F.col("duration"), F.col("feature")).alias("gate")))


def _with_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _features(views.chunks(spark, sf_dir))
    gate = gates.reference_gate(F.col("text_src"), F.col("duration"), F.col("chunk_ord") % 6 != 5, F.col("feature"))
    return c.withColumn("gate", gate).withColumn("voiced_ratio", F.coalesce("feature.voiced_ratio", F.lit(0.0)))


def reference_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_with_reference(spark, sf_dir).select(*KEY, "gate"))


def reference_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.reference_bank(_with_reference(spark, sf_dir)).select("clip_id", "speaker", "chunk_ord", "duration")


def reference_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.choose_reference(_with_reference(spark, sf_dir)).select(*KEY, "reference_mode", "reference_ord")


def reference_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.reference_ranking(_with_reference(spark, sf_dir)).select(*KEY, "speaker", "rank")


def translation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next line stands for the translation of a line."""
    c = segments.neighbours(views.chunks(spark, sf_dir), "text_src", order=("chunk_ord",))
    b = X.duration_budget(F.col("duration"), F.col("text_src"), F.lit("English"), F.lit(0))
    c = c.withColumn("b", b).withColumn("f", X.budget_fit(F.col("next_line"), F.lit("English"), F.col("b")))
    return _flat(c.select(*KEY, gates.translation_gate(F.col("text_src"), F.col("next_line"), F.col("f"), F.col("b")).alias("gate")))


def audio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _features(views.chunks(spark, sf_dir))
    return _flat(c.select(*KEY, gates.audio_gate(F.col("duration"), F.col("chunk_ord") + F.lit(1.0), F.col("feature")).alias("gate")))


def transcript_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line against the one before it."""
    c = segments.neighbours(views.chunks(spark, sf_dir), "text_src", order=("chunk_ord",)).filter("previous_line IS NOT NULL")
    c = c.withColumn("similarity", X.similarity(X.content(F.col("text_src")), X.content(F.col("previous_line"))))
    gate = gates.transcript_gate(F.col("duration"), F.col("text_src"), F.col("previous_line"), F.col("similarity"))
    return _flat(c.select(*KEY, F.round("similarity", 6).alias("similarity"), gate.alias("gate")))


def merged_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _with_reference(spark, sf_dir).withColumn("asr", gates.asr_gate(F.col("text_src"), F.col("duration"), F.col("feature")))
    both = gates.merged_gates(F.create_map(F.lit("asr"), "asr"), F.create_map(F.lit("reference"), "gate"), F.create_map(F.lit("asr"), "gate"))
    return c.select(*KEY, both.alias("g")).select(*KEY, F.array_join(F.array_sort(F.map_keys("g")), ",").alias("stages"), F.col("g")["asr"].score.alias("asr_score"))


def register_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register last heard from a speaker before a line; here a question counts as polite and an exclamation as casual."""
    c = views.chunks(spark, sf_dir)
    heard = F.when(F.col("text_src").endswith("?"), "polite").when(F.col("text_src").endswith("!"), "casual")
    w = Window.partitionBy("clip_id", "speaker").orderBy("chunk_ord").rowsBetween(Window.unboundedPreceding, -1)
    return c.select(*KEY, F.last(heard, ignorenulls=True).over(w).alias("register"))


def neighbour_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.neighbours(views.chunks(spark, sf_dir), "text_src", order=("chunk_ord",)).select(*KEY, "previous_line", "next_line")


def transcript_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir)
    line = X.transcript_line(F.col("chunk_ord") + 1, F.col("chunk_id"), F.col("speaker"), F.col("start"), F.col("end"), F.col("text_src"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_ord", line.alias("line"))))
    return c.groupBy("clip_id").agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("transcript"))


def emotion_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types as scores, blended with the type of the newest event."""
    e = views.table(spark, sf_dir, "events")
    counts = e.groupBy("user_id", "event_type").agg((F.count("*") * 1.0).alias("n"))
    scores = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("scores"))
    newest = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", F.col("m.event_type").alias("read"))
    rows = scores.join(newest, "user_id").withColumn("scores", scalars.normalized_map(F.col("scores")))
    fused = gates.emotion_fused(F.col("scores"), F.col("read"), F.lit(""), 0.7, EMOTIONS)
    rows = rows.withColumn("fused", fused)
    top = F.array_join(F.transform(scalars.top_entries(F.col("scores"), 3), lambda x: x.key), ",")
    return rows.select("user_id", scalars.map_argmax(F.col("scores"), EMOTIONS).alias("heard"), F.col("fused.label").alias("label"), F.round(F.col("fused.scores")["view"], 9).alias("view"), top.alias("top3"))


def timeline_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with three sparse side tables, of which one has doubled keys."""
    c = views.chunks(spark, sf_dir)
    d = views.table(spark, sf_dir, "documents").select((F.col("doc_id") % 500).alias("clip_id"), (F.col("doc_id") % 7).alias("chunk_ord"), "lang", F.col("doc_id").alias("ord"), F.nullif(F.col("source"), F.lit("src3")).alias("source"))
    l = views.table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 500).alias("clip_id"), (F.col("doc_id") % 5).alias("chunk_ord")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))  # noqa: E741
    out = timeline.assemble(c, {"asr": d, "label": l}, KEY)
    return out.select(
        *KEY, timeline.present_else(F.col("asr"), "source", F.lit("none")).alias("source_if_present"), timeline.filled_else(F.col("asr.source"), F.lit("none")).alias("source_if_filled"),
        F.col("asr.lang").alias("lang"), F.col("label.quality").alias("quality"),
    )


def override_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir).withColumn("reference", F.when(F.col("chunk_ord") % 2 == 0, F.col("chunk_id")))
    o = c.filter("chunk_ord % 3 = 0").select(*KEY, F.when(F.col("clip_id") % 2 == 0, "user").alias("speaker"), F.lit("ref").alias("reference"), (F.col("clip_id") % 3 == 0).alias("clear_reference"))
    return timeline.override(c, o, KEY).select(*KEY, "speaker", "original_speaker", "reference")


def _patched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before = views.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("output", F.lit("x"))
    after = before.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("  "), "text")).otherwise(F.col("text")))
    return before, after


def signature_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (d.withColumn("signature", timeline.signature(F.col("text"), F.col("lang"))) for d in _patched(spark, sf_dir))
    return timeline.staleness(after, before.filter("doc_id % 11 <> 0"), ["doc_id"]).select("doc_id", "state")


def reuse_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (d.withColumn("signature", timeline.signature(F.col("text"))) for d in _patched(spark, sf_dir))
    reused, changed = timeline.reuse(after.drop("output"), before, "output", ["doc_id"])
    return reused.select("doc_id", F.lit("reused").alias("part")).union(changed.select("doc_id", F.lit("changed")))


def merge_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _patched(spark, sf_dir)
    updates = after.filter("doc_id % 10 = 0").select("doc_id", "text", F.lit(None).cast("string").alias("source"))
    out = timeline.patch(before, updates, ["text", "source"], {"text": ["output"]}, ["doc_id"])
    return out.select("doc_id", "text", "source", "output", "stale")


def audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _patched(spark, sf_dir)
    out = timeline.audit(before, after.withColumn("lang", F.when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("lang"))), ["text", "lang", "source"], ["doc_id"])
    return out.select("doc_id", "field", "before", "after")


def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir)
    before = c.select(*KEY, "text_src", F.concat(F.lit("say "), "chunk_id").alias("instruction"))
    now = c.select("clip_id", F.when(F.col("clip_id") % 2 == 0, F.col("chunk_ord") + 1).otherwise(F.col("chunk_ord")).alias("chunk_ord"), "text_src")
    return timeline.carry_over(now, before, "instruction", KEY, ["text_src"]).select(*KEY, "instruction", "carried")


def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.key_differences(views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "labels").select((F.col("doc_id") + 5).alias("doc_id")), ["doc_id"])


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.duplicate_keys(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    u = d.filter("doc_id % 4 = 0").select((F.col("doc_id") + 2).alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.when(F.col("doc_id") % 8 == 0, F.lit("new")).alias("source"))
    return timeline.upsert(d, u, ["lang", "source"], ["doc_id"])


def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir).select("clip_id", "chunk_id", "speaker", "start", "end")
    pieces = segments.split_long(c.filter("end - start > 20"), 20.0).select("clip_id", "chunk_id", "speaker", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))
    return timeline.replace_rows(c, pieces).select("clip_id", "chunk_id", "speaker", "start", "end")


def dialogue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").withColumnRenamed("text", "text_src").withColumnRenamed("lang", "language")
    return timeline.dialogue_filter(d, ["en", "de"]).groupBy("reason").agg(F.count("*").alias("n"))


def _chunk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir)
    status = timeline.chunk_status(F.col("chunk_ord") % 13 == 12, F.when(F.col("chunk_ord") % 7 == 6, "failed"), F.col("chunk_ord") % 5 == 4, F.col("chunk_ord") % 2 == 0)
    return c.withColumn("status", status).withColumn("accepted", F.col("clip_id") % 6 != 0).withColumn("emotion", F.when(F.col("chunk_ord") % 3 != 0, F.col("speaker"))).withColumn("text_translated", F.lit(None).cast("string"))


def chunk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_view(spark, sf_dir).select(*KEY, "chunk_id", "status", "accepted", "emotion", "duration")


def chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.find_rows(_chunk_view(spark, sf_dir), speaker="user", search="CHUNK_0002", problems_only=True).select(*KEY, "status")


def repair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.repair_counts(_chunk_view(spark, sf_dir))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunk_view(spark, sf_dir).withColumnRenamed("clip_id", "run_id").withColumn("duration_ratio", F.when(F.col("chunk_ord") % 4 != 0, F.col("duration")))
    out = runs.chunk_metrics(c)
    return out.select("run_id", "chunks", "done", "errors", F.round("mean_ratio", 9).alias("mean_ratio"), F.array_join(F.transform(F.map_entries("emotions"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",").alias("emotions"))


def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.project_summary(views.runs(spark, sf_dir), ["success", "failed", "running"])


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.progress(views.steps(spark, sf_dir))


def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.resume_point(views.steps(spark, sf_dir))


def failed_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.failed_tail(views.steps(spark, sf_dir)).select("run_id", "ord", "state")


def step_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.steps_between(views.steps(spark, sf_dir), 2, 4).select("run_id", "name")


def kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.kpi(views.runs(spark, sf_dir), views.steps(spark, sf_dir), "success", "failed")
    return out.select("runs", "projects", F.round("success_rate", 9).alias("success_rate"), F.round("mean_wall", 4).alias("mean_wall"))


def group_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = views.runs(spark, sf_dir).filter("status = 'failed'").select("run_id")
    return runs.group_failure(views.steps(spark, sf_dir), bad).select("run_id", "ord", "state")


def inferred_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.steps(spark, sf_dir).select("run_id", F.col("name").alias("step"), (F.col("state") == "done").alias("exists"), (F.col("ord") == 4).alias("final"))
    return runs.inferred_steps(s)


def sweep_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = views.table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 40).alias("trial"), F.when((F.col("l_partkey") % 17 == 0) | (F.col("l_suppkey") % 40 == 7), "error").otherwise("done").alias("status"),
        F.floor(F.col("l_discount") * 100).alias("errors"), F.floor("l_quantity").alias("seconds"))
    out = runs.trial_summary(cells)
    return out.select("trial", "cells", "done", "status", *[F.round(c, 9).alias(c) for c in ("macro", "worst", "weighted", "combined")])


def rank_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial"), F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("metric"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 1.0).alias("proxy"))
    return runs.ranked_trials(p, "metric", "proxy", "trial", 25).select("trial", "sort_value")


def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.parameter_grid(spark, {"gap": [0.1, 0.5], "margin": [1, 2, 3], "kind": ["a", "b"]}, {"seed": 7})


def plateaus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("threshold"), F.floor(F.col("p_size") / 20).alias("main_count"))
    return runs.plateaus(p)


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.centroids(views.embeddings(spark, sf_dir), ["speaker"])
    return c.select("speaker", "n", F.posexplode("centroid").alias("place", "x")).withColumn("x", F.round("x", 9))


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = speakers.best_label(views.embeddings(spark, sf_dir), ["chunk_ord"], [])
    out = speakers.confident_label(out, 0.2, 0.02, F.col("speaker"))
    return out.select("chunk_ord", "speaker", "best", F.round("best_sim", 9).alias("best_sim"), F.round("second_sim", 9).alias("second_sim"), "label")


def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.disagreements(views.embeddings(spark, sf_dir), ["chunk_ord"], []).select("chunk_ord", "speaker", "best")


def embed_reassign_pass1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.reassign(views.embeddings(spark, sf_dir), ["chunk_ord"], 0.05, 0.1, [], passes=1).select("chunk_ord", "speaker")


def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.cohesion(views.embeddings(spark, sf_dir).withColumn("clip_id", F.lit(0)), ["clip_id"]).select("clip_id", F.round("cohesion", 9).alias("cohesion"))


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.label_pairs(views.embeddings(spark, sf_dir), []).select("a", "b", F.round("sim", 9).alias("sim"))


def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.silhouettes(views.embeddings(spark, sf_dir)).select("chunk_ord", F.round("silhouette", 9).alias("silhouette"))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in clips of 50 by id."""
    return views.embeddings(spark, sf_dir).withColumn("clip_id", F.floor(F.col("chunk_ord") / 50)).withColumn("start", F.col("chunk_ord") * 2.0).withColumn("end", F.col("start") + 1.5)


def recluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.recluster(_clips(spark, sf_dir), ["chunk_ord"], 0.3)


def greedy_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.greedy_clusters(_clips(spark, sf_dir), ["chunk_ord"], 0.3)


def embed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.merge_labels(_clips(spark, sf_dir), 0.3, 0.2).select("clip_id", "chunk_ord", "speaker")


def embed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.split_labels(_clips(spark, sf_dir), ["chunk_ord"], 2, 0.3, 0.02).select("clip_id", "chunk_ord", "speaker")


def singleton_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.absorb_singletons(_clips(spark, sf_dir).withColumn("clip_id", F.floor(F.col("chunk_ord") / 12)), ["chunk_ord"], 0.2, 0.1, 1.0, 0.02).select("clip_id", "chunk_ord", "speaker")


def gender_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clips(spark, sf_dir).withColumn("f0", F.col("chunk_ord") * 37 % 240 + F.lit(80.0))
    return speakers.gender_split(rows, 150.0, 220.0).select("clip_id", "chunk_ord", "speaker")


def repair_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("embed_reassign", {"keys": ["chunk_ord"], "margin": 0.05, "least": 0.1, "passes": 1}), ("gender_split", {"low": 150.0, "high": 220.0})]
    return speakers.repair(_clips(spark, sf_dir).withColumn("f0", F.col("chunk_ord") * 37 % 240 + F.lit(80.0)), steps).select("clip_id", "chunk_ord", "speaker")


def consensus_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within a day, put together by three labellings: two of three must agree."""
    rows = views.segments(spark, sf_dir).withColumn("clip_id", F.col("clip_id") * 100 + F.floor(F.col("start") / 86400).cast("long")).withColumnRenamed("seg_ord", "node")
    labels = F.array(
        F.struct(F.lit(0).alias("voter"), F.col("speaker").alias("label")), F.struct(F.lit(1).alias("voter"), F.concat(F.lit("k"), F.col("other").cast("string")).alias("label")),
        F.struct(F.lit(2).alias("voter"), F.when(F.col("node") % 5 != 0, F.concat(F.lit("n"), (F.col("node") % 4).cast("string"))).alias("label")))
    votes = rows.select("clip_id", "node", F.explode(labels).alias("v")).select("clip_id", "node", "v.voter", "v.label")
    return speakers.consensus(rows, votes, ["node"], 3, 0.6)


def time_gap_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.on_one_clock(spark, sf_dir).withColumnRenamed("seg_ord", "chunk_ord")
    return speakers.time_gap_parts(rows, 90.0).select("clip_id", "chunk_ord", "part")


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, frames and faces of clips: four tracks in turn, of three faces."""
    rows = views.on_one_clock(spark, sf_dir).withColumnRenamed("seg_ord", "chunk_ord")
    f = rows.select("clip_id", (F.col("chunk_ord") % 4).alias("track_id"), F.col("chunk_ord").alias("frame"), (F.col("start") + 9.0).alias("t"), ((F.col("end") - F.col("start")) / 64).alias("score"))
    faces = f.select("clip_id", "track_id").distinct().withColumn("face", (F.col("track_id") % 3).cast("int"))
    return rows, f, faces


def face_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, frames, faces = _tracks(spark, sf_dir)
    return visual.face_evidence(chunks, frames, faces, 0.25, width=40.0)


def face_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, frames, faces = _tracks(spark, sf_dir)
    dominant = visual.dominant_face(visual.face_evidence(chunks, frames, faces, 0.25, width=40.0))
    a = visual.overwrite_by_face(chunks, dominant).select("clip_id", "chunk_ord", F.col("speaker").alias("overwritten"))
    b = visual.split_by_faces(chunks, dominant).select("clip_id", "chunk_ord", F.col("speaker").alias("split"))
    c = visual.remap_by_faces(chunks, dominant).select("clip_id", "chunk_ord", F.col("speaker").alias("remapped"))
    return a.join(b, ["clip_id", "chunk_ord"]).join(c, ["clip_id", "chunk_ord"])


def cluster_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.on_one_clock(spark, sf_dir).groupBy("clip_id", F.col("other").alias("cluster"), "speaker").agg(F.count("*").alias("n"))
    return speakers.dominant_of_cluster(counts).select("clip_id", "cluster", "speaker", F.round("purity", 9).alias("purity"))


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows from every segment on: it should be the second model's label, or quiet, or begin a sequence."""
    rows = views.on_one_clock(spark, sf_dir)
    e = rows.select(
        "clip_id", F.col("seg_ord").cast("string").alias("id"), F.when(F.col("seg_ord") % 3 == 0, "single_role").when(F.col("seg_ord") % 3 == 1, "ordered_roles").otherwise("non_asr").alias("kind"),
        "start", (F.col("start") + 120.0).alias("end"), F.lit(None).cast("double").alias("weight"), F.col("other").alias("role"), F.array("other", F.lit(None).cast("string")).alias("roles"))
    mapping = evaluate.role_mapping(evaluate.role_overlaps(e, rows, ["clip_id"], 40.0), ["clip_id"], views.ROLES)
    out = evaluate.expectation_scores(evaluate.assess_expectations(e, rows, mapping, ["clip_id"], least_coverage=0.1, width=40.0, mapped_only=True), ["clip_id"])
    return out.select("clip_id", "kind", "expected", "passed", F.round("score", 9).alias("score"))


def role_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.on_one_clock(spark, sf_dir)
    e = rows.select("clip_id", F.col("seg_ord").alias("id"), F.lit("single_role").alias("kind"), "start", (F.col("start") + 120.0).alias("end"), F.col("other").alias("role"))
    return evaluate.role_overlaps(e, rows, ["clip_id"], 40.0)


def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.on_one_clock(spark, sf_dir).withColumn("clip_id", F.col("clip_id") * 1000 + F.floor(F.col("seg_ord") / 4)).withColumn("confident", F.col("seg_ord") % 2 == 0).withColumn("original", F.lit("view"))
    return evaluate.should_adopt(rows, ["clip_id"], 20.0, 25.0)


def challenge_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = segments.merge_chunks(views.on_one_clock(spark, sf_dir), 8.0)
    reasons = evaluate.candidate_reasons(F.col("duration"), F.col("source_segment_count"), 4.0, 90.0, 40.0)
    return merged.select("clip_id", "chunk_ord", F.array_join(reasons, ",").alias("reasons"))


def word_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clips(spark, sf_dir).select("clip_id", F.col("chunk_ord").alias("word_ord"), "embedding")
    return words.best_cut(rows, ["clip_id"]).select("clip_id", "cut_after", F.round("sim", 9).alias("sim"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log lines of runs: a third starts a step, a third ends one, the others are text."""
    e = views.table(spark, sf_dir, "events")
    step = F.concat(F.lit("s_"), F.element_at(F.split(F.lit("a b c d"), " "), (F.col("event_id") % 4 + 1).cast("int")))
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("10:00 Starting step: "), step)).when(F.col("event_type") == "click", F.concat(F.lit("Completed step: "), step)).when(
        F.col("event_type") == "error", F.concat(F.lit("Step failed: "), step, F.lit(" | it broke"))).otherwise(F.concat(F.lit("text "), F.col("event_type")))
    return e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"), "event_id", line.alias("value"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.parse(_log(spark, sf_dir)).select("event_id", "type", "step", "message")


def step_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.durations(progress.parse(_log(spark, sf_dir)).filter("step IS NOT NULL")).select("run_id", "step", "event_id", "type", "duration_ms")


def client_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.client_state(progress.durations(progress.parse(_log(spark, sf_dir)))).select("run_id", "step", "state", "duration_ms")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.replay(progress.parse(_log(spark, sf_dir)), 20).select("run_id", "event_id")


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_distinct("lang").alias("languages"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled and unlabelled documents: intersect, except, union."""
    d, l = views.table(spark, sf_dir, "documents").select("doc_id"), views.table(spark, sf_dir, "labels").select("doc_id")  # noqa: E741
    tagged = lambda x, n: x.select("doc_id", F.lit(n).alias("part"))
    return tagged(d.intersect(l), "both").unionByName(tagged(d.exceptAll(l), "unlabelled")).unionByName(tagged(d.join(l, "doc_id", "left_semi"), "semi"))


def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    return d.rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level"))


def cube_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


QUERIES = {f.__name__: f for f in (
    text_metrics, budget, speech_estimate, asr_gate, reference_gate, reference_bank, reference_choice, reference_ranking, translation_gate, audio_gate,
    transcript_similarity, merged_gates, register_memory, neighbour_lines, transcript_render, emotion_blend, timeline_assembly, override_join, signature_stale,
    reuse_split, merge_patch, audit_diff, carry_over, key_differences, duplicate_keys, upserted, replaced_rows, dialogue_filter, chunk_view, chunk_filter,
    repair_counts, run_metrics, project_summary, run_progress, resume_point, failed_tail, step_range, kpi, group_failure, inferred_steps, sweep_rollup,
    rank_trials, parameter_grid, plateaus, centroids, nearest_centroid, disagreements, embed_reassign_pass1, cohesion, merge_candidates, silhouette, recluster,
    greedy_cluster, embed_merge, embed_split, singleton_absorb, gender_split, repair_chain, consensus_labels, time_gap_parts, face_evidence, face_labels,
    cluster_purity, expectations, role_overlaps, adoption, challenge_reasons, word_cut, log_events, step_durations, client_state, replay, facets, set_operations,
    rollup_totals, cube_totals,
)}

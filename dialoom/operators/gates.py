"""Rule gates: each stage's rules are named conditions; an assessment is made of those that hold.

The rules' names and limits are fixed values: readers of assessments know them.

An assessment is struct(stage, accepted, critical_flags, warnings, score): accepted without critical flags, score
1 - min(.75, .25 a flag) - min(.2, .05 a warning), not below 0. Feature columns may be null: a feature struct that is null
raises nothing, a voiced ratio of 0 counts as missing (1), as a silence or clipping ratio that is null counts as 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scalars import blended, clamp, map_argmax, safe_ratio

Rules = Sequence[tuple[str, Column]]


def _held(rules: Rules) -> Column:
    """Names of the rules whose condition is true, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules])) if rules else F.array().cast("array<string>")


def assessment(stage: str, flags: Rules, warnings: Rules) -> Column:
    held, warned = _held(flags), _held(warnings)
    score = F.lit(1.0) - F.least(F.lit(0.75), 0.25 * F.size(held)) - F.least(F.lit(0.2), 0.05 * F.size(warned))
    return F.struct(
        F.lit(stage).alias("stage"), (F.size(held) == 0).alias("accepted"), held.alias("critical_flags"), warned.alias("warnings"),
        F.greatest(F.lit(0.0), F.bround(score, 3)).alias("score"),
    )


def _voiced(feature: Column) -> Column:
    v = feature.voiced_ratio
    return F.when(v.isNull() | (v == 0), 1.0).otherwise(v)


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _bands(value: Column, bands: tuple[float, float], names: tuple[str, str], below: bool) -> tuple[tuple[str, Column], tuple[str, Column]]:
    severe, mild = bands
    one = value < severe if below else value > severe
    two = (value < mild if below else value > mild) & ~one
    return (names[0], one), (names[1], two)


def asr_gate(text: Column, duration: Column, feature: Column) -> Column:
    line, length = X.normalized(text), _or_zero(duration)
    spoken = line != ""
    rate = safe_ratio(X.spoken_characters(text).cast("double"), length)
    known = feature.isNotNull()
    return assessment("asr", [("blank_transcript", (length > 0.8) & ~spoken)], [
        ("suspiciously_sparse_transcript", spoken & (length >= 2.0) & (rate < 0.8)), ("suspiciously_dense_transcript", spoken & (rate > 18.0)),
        ("repetitive_transcript", spoken & (X.repetition_ratio(text) > 0.6)), ("low_voiced_ratio", known & (_voiced(feature) < 0.1)),
        ("mostly_silent_chunk", known & (_or_zero(feature.silence_ratio) > 0.8)),
    ])


def reference_gate(text: Column, duration: Column, has_audio: Column, feature: Column, least: float = 1.2) -> Column:
    length, known = _or_zero(duration), feature.isNotNull()
    silent = _bands(_or_zero(feature.silence_ratio), (0.85, 0.6), ("reference_mostly_silent", "reference_high_silence"), below=False)
    voiced = _bands(_voiced(feature), (0.08, 0.25), ("reference_low_voiced_ratio", "reference_sparse_voicing"), below=True)
    clipped = _bands(_or_zero(feature.clipping_ratio), (0.05, 0.01), ("reference_clipping_severe", "reference_clipping"), below=False)
    flags = [
        ("missing_reference_audio", ~F.coalesce(has_audio, F.lit(False))), ("missing_reference_transcript", X.normalized(text) == ""),
        ("invalid_reference_duration", length <= 0), ("reference_too_short_critical", (length > 0) & (length < 0.55)),
    ]
    warnings = [("reference_short", (length >= 0.55) & (length < least))]
    return assessment(
        "reference", flags + [(n, known & c) for n, c in (silent[0], voiced[0], clipped[0])],
        warnings + [(n, known & c) for n, c in (silent[1], voiced[1], clipped[1])],
    )


def translation_gate(source: Column, translated: Column, fit: Column, budget: Column) -> Column:
    line = X.normalized(translated)
    actual, low, most = fit.actual_units, budget.min_units, budget.max_units
    over = (actual > 0) & (most > 0) & (actual > most)
    under = (actual > 0) & (low > 0) & (actual < low) & ~over
    known = budget.isNotNull()
    return assessment("translation", [("blank_translation", (X.normalized(source) != "") & (line == ""))], [
        ("repetitive_translation", (line != "") & (X.repetition_ratio(translated) > 0.55)), ("mixed_register", X.register(translated) == "mixed"),
        ("translation_over_budget", known & over), ("translation_under_budget", known & under),
    ])


def audio_gate(actual: Column, expected: Column, feature: Column) -> Column:
    """Gate of synthesised audio by its duration and features."""
    ratio, timed = safe_ratio(_or_zero(actual), expected), expected > 0
    short = _bands(ratio, (0.55, 0.78), ("tts_under_duration_severe", "tts_under_duration"), below=True)
    long = _bands(ratio, (1.45, 1.22), ("tts_over_duration_severe", "tts_over_duration"), below=False)
    silent = _bands(_or_zero(feature.silence_ratio), (0.7, 0.45), ("tts_mostly_silent", "tts_high_silence"), below=False)
    clipped = _bands(_or_zero(feature.clipping_ratio), (0.05, 0.01), ("tts_clipping_severe", "tts_clipping"), below=False)
    both = lambda i: [(short[i][0], timed & short[i][1]), (long[i][0], timed & long[i][1]), silent[i], clipped[i]]
    return assessment("tts", [("empty_tts_output", _or_zero(actual) <= 0), *both(0)], both(1))


def transcript_gate(duration: Column, transcript: Column, target: Column, similarity: Column) -> Column:
    """Gate of what a recogniser heard in synthesised audio against what it should say."""
    heard, wanted = X.normalized(transcript), X.normalized(target)
    both = (heard != "") & (wanted != "")
    repeated, words = X.repetition_ratio(transcript), X.word_count(transcript)
    ratio = safe_ratio(X.spoken_characters(transcript).cast("double"), X.spoken_characters(target).cast("double"))
    short = _bands(ratio, (0.45, 0.65), ("tts_transcript_too_short", "tts_transcript_short"), below=True)
    long = _bands(ratio, (1.8, 1.35), ("tts_transcript_too_long", "tts_transcript_long"), below=False)
    alike = _bands(similarity, (0.28, 0.42), ("tts_transcript_mismatch", "tts_transcript_low_similarity"), below=True)
    opening, first = X.first_token(target), X.first_token(transcript)
    missing = (opening != "") & (first != "") & (opening != first) & (F.length(opening) <= 4) & ~F.contains(heard, opening)
    of = lambda i: [(n, both & c) for n, c in (short[i], long[i], alike[i])]
    often = words >= 5
    return assessment("tts_asr", [
        ("blank_tts_transcript", (_or_zero(duration) > 0.8) & (heard == "")), ("repetitive_tts_transcript", often & (repeated > 0.3)), *of(0),
    ], [
        ("possibly_repetitive_tts_transcript", often & (repeated > 0.2) & (repeated <= 0.3)), *of(1), ("tts_transcript_missing_opening_token", both & missing),
    ])


def merged_gates(*maps: Column) -> Column:
    """One map of stage to assessment; of equal stages the later map's. Keys of earlier maps that a later one has go first."""
    def over(first: Column, later: Column) -> Column:
        return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(later), k)), later)

    return reduce(over, maps)


def preflight(estimated: Column, available: Column) -> Column:
    """struct(ratio, warnings) of speech that has to fit a time."""
    ratio = safe_ratio(estimated, available)
    return F.struct(ratio.alias("ratio"), _held([("speech_may_be_rushed", (ratio > 1.35) & (ratio <= 1.75)), ("speech_too_long", ratio > 1.75)]).alias("warnings"))


def prompt_cap(estimated: Column, prompt_seconds: Column) -> Column:
    """Seconds of prompt to use: at most min(4.5, max(1.4, 1.4 x the estimate)) where the prompt is longer than that."""
    cap = F.least(F.lit(4.5), F.greatest(F.lit(1.4), 1.4 * estimated))
    return F.least(prompt_seconds, cap)


def tempo_fit(actual: Column, target: Column, low: float, high: float) -> Column:
    """struct(tempo, fitted, action): the tempo within limits, the seconds after it, and whether to pad or trim the rest."""
    tempo = F.when((target > 0) & (actual > 0), clamp(safe_ratio(actual, target), low, high)).otherwise(1.0)
    fitted = actual / tempo
    action = F.when(F.abs(fitted - target) < 1e-6, "none").when(fitted < target, "pad").otherwise("trim")
    return F.struct(tempo.alias("tempo"), fitted.alias("fitted"), action.alias("action"))


def reference_bank(rows: DataFrame, by: Sequence[str] = ("clip_id",)) -> DataFrame:
    """The best accepted row of each speaker: score, then duration, then voiced ratio, then the first; columns gate, voiced_ratio."""
    w = Window.partitionBy(*by, "speaker").orderBy(F.desc("gate.score"), F.desc("duration"), F.desc("voiced_ratio"), "chunk_ord")
    return rows.filter("gate.accepted").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def reference_ranking(rows: DataFrame, by: Sequence[str] = ("clip_id",)) -> DataFrame:
    """All rows of each speaker with their ``rank``: accepted first, then by score and duration."""
    w = Window.partitionBy(*by, "speaker").orderBy(F.desc("gate.accepted"), F.desc("gate.score"), F.desc("duration"), "chunk_ord")
    return rows.withColumn("rank", F.row_number().over(w))


def choose_reference(rows: DataFrame, by: Sequence[str] = ("clip_id",)) -> DataFrame:
    """rows with ``reference_ord`` and ``reference_mode``: self if accepted, else the speaker's best, else self by force if it has text."""
    bank = reference_bank(rows, by).select(*by, "speaker", F.col("chunk_ord").alias("_best"))
    met = rows.join(bank, [*by, "speaker"], "left")
    own = F.col("gate.accepted")
    mode = F.when(own, "self").when(F.col("_best").isNotNull(), "bank").when(X.normalized(F.col("text_src")) != "", "forced_self").otherwise("error")
    chosen = F.when(own, F.col("chunk_ord")).when(F.col("_best").isNotNull(), F.col("_best")).when(X.normalized(F.col("text_src")) != "", F.col("chunk_ord"))
    return met.withColumn("reference_mode", mode).withColumn("reference_ord", chosen).drop("_best")


def emotion_fused(scores: Column, external: Column, text: Column, weight: float, labels: tuple[str, ...]) -> Column:
    """struct(label, scores): an external label, or neutral for a happy line with a negative word, is blended in; else as heard."""
    heard = map_argmax(scores, labels)
    read = F.coalesce(external, F.when((heard == "happy") & X.has_negative_word(text), "neutral"))
    mixed = F.when(read.isNotNull() & (read != heard), blended(scores, read, weight, labels)).otherwise(scores)
    return F.struct(map_argmax(mixed, labels).alias("label"), mixed.alias("scores"))


def verdict(current: Column, baseline: Column, lower_is_better: bool) -> Column:
    delta = (baseline - current) if lower_is_better else (current - baseline)
    return F.when(delta > 1e-9, "better").when(delta < -1e-9, "worse").otherwise("same")


def best_threshold(main: Column, background: Column, threshold: Column) -> Column:
    """Aggregate: the threshold with the largest main + background / 2; of equals the lower one."""
    return F.max(F.struct((main + 0.5 * background).alias("s"), (-threshold).alias("t"))).getField("t") * -1

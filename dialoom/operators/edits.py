"""Edits of a timeline's rows: speaker and reference, emotion and instruction, translation; what each clears, and what becomes stale.

Each takes a timeline and a table of edits with a row for each edited key, and is one join. A null field of an edit is not edited.
Columns that an edit touches are added to the timeline where it lacks them. A key that is edited twice is edited by one of them:
make edits unique first, for instance with ``timeline.last_wins``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .timeline import reference_mode

KEY = ("clip_id", "chunk_id")
# What a dubbed row remembers of how it was made, and what an instruction does.
DUB_STATE = {"dub_error": "string", "dub_input_signature": "string", "dub_reference_chunk_id": "string", "dub_reference_wav": "string", "dub_reference_mode": "string"}
INSTRUCTION = {"tts_instruct_text": "string", "tts_instruct_source": "string", "tts_instruct_emotion_label": "string", "tts_instruct_applied": "boolean", "tts_instruct_error": "string"}


def _met(rows: DataFrame, edits: DataFrame, fields: dict[str, str], needed: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """rows with all needed columns, each edit's fields as _field, and _hit where there is an edit."""
    rows = rows.withColumns({n: F.lit(None).cast(kind) for n, kind in needed.items() if n not in rows.columns})
    given = [(F.col(f) if f in edits.columns else F.lit(None)).cast(kind).alias(f"_{f}") for f, kind in fields.items()]
    return rows.join(edits.select(*keys, *given, F.lit(True).alias("_hit")), list(keys), "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def _done(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """All values from the rows as they were; helpers go."""
    out = rows.withColumns({f"_new_{n}": v for n, v in values.items()})
    return out.withColumns({n: F.col(f"_new_{n}") for n in values}).drop(*[c for c in out.columns if c.startswith("_")])


def _without(gone: Column, names: Sequence[str]) -> dict[str, Column]:
    return {n: F.when(~gone, F.col(n)) for n in names}


def edit_speakers(rows: DataFrame, edits: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """edits (keys, speaker, reference_mode, reference_chunk_id): whose voice a row has, and which reference it is dubbed with.

    A new speaker is an override, and the first one replaced stays in speaker_original; a blank one is an error. Mode auto takes
    mode and reference away, self the reference; then a reference given replaces it, and a blank one takes it away. A row that is changed is stale
    and forgets how it was dubbed.
    """
    needed = {"speaker_original": "string", "speaker_override": "boolean", "reference_mode_override": "string", "reference_chunk_id_override": "string", "dub_stale": "boolean", **DUB_STATE}
    met = _met(rows, edits, {"speaker": "string", "reference_mode": "string", "reference_chunk_id": "string"}, needed, keys)
    name = F.trim("_speaker")
    name = F.when(name == "", F.raise_error(F.lit("speaker must not be blank")).cast("string")).otherwise(name)
    renamed = F.col("_speaker").isNotNull() & (name != F.coalesce("speaker", F.lit("")))
    mode = F.when(F.col("_reference_mode").isNotNull(), reference_mode(F.col("_reference_mode")))
    chunk = F.trim("_reference_chunk_id")
    new_mode = F.when(mode.isNull(), F.col("reference_mode_override")).when(mode != "auto", mode)
    reference = F.when(mode.isNull() | ~mode.isin("auto", "self"), F.col("reference_chunk_id_override"))
    reference = F.when(chunk.isNull(), reference).when(chunk != "", chunk)
    changed = renamed | ~new_mode.eqNullSafe(F.col("reference_mode_override")) | ~reference.eqNullSafe(F.col("reference_chunk_id_override"))
    changed = F.col("_hit") & F.coalesce(changed, F.lit(False))
    return _done(met, {
        "speaker_original": F.when(renamed, F.coalesce("speaker_original", "speaker")).otherwise(F.col("speaker_original")),
        "speaker_override": F.when(renamed, True).otherwise(F.col("speaker_override")), "speaker": F.when(renamed, name).otherwise(F.col("speaker")),
        "reference_mode_override": new_mode, "reference_chunk_id_override": reference,
        "dub_stale": F.when(changed, True).otherwise(F.col("dub_stale")), **_without(changed, list(DUB_STATE)),
    })


def edit_emotions(rows: DataFrame, edits: DataFrame, directive: str, keys: Sequence[str] = KEY) -> DataFrame:
    """edits (keys, emotion_label, emotion_scores map, tts_instruct_text): a row's emotion by hand, and how it should be spoken.

    Scores are held to 0..1; the largest is the confidence, and names the emotion if no label is given (of equals the name that sorts
    first). A new emotion takes away an instruction that was not written by hand. An instruction loses its CJK characters and gets the
    directive; if nothing is left, the row has none. An edited row is stale.
    """
    needed = {"emotion_label": "string", "emotion_scores": "map<string,double>", "emotion_confidence": "double", "emotion_source": "string", "dub_stale": "boolean", "dub_input_signature": "string", **INSTRUCTION}
    met = _met(rows, edits, {"emotion_label": "string", "emotion_scores": "map<string,double>", "tts_instruct_text": "string"}, needed, keys)
    scores = F.transform_values(F.map_filter("_emotion_scores", lambda _, v: v.isNotNull() & ~F.isnan(v)), lambda _, v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    some = F.col("_emotion_scores").isNotNull() & (F.size(scores) > 0)
    ranked = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e.value).alias("down"), e.key.alias("name"))))
    top = F.get(ranked, 0)
    felt = F.col("_emotion_label").isNotNull() | F.col("_emotion_scores").isNotNull()
    told = F.col("_tts_instruct_text").isNotNull()
    clean = X.without_cjk(F.col("_tts_instruct_text"))
    said = F.when(clean != "", X.with_directive(clean, directive))
    dropped = felt & ~told & ~F.col("tts_instruct_source").eqNullSafe("manual")
    return _done(met, {
        "emotion_scores": F.when(some, scores).otherwise(F.col("emotion_scores")),
        "emotion_confidence": F.when(some, -top.getField("down")).otherwise(F.col("emotion_confidence")),
        "emotion_label": F.coalesce("_emotion_label", F.when(some, top.getField("name")), "emotion_label"),
        "emotion_source": F.when(felt, "manual").otherwise(F.col("emotion_source")),
        "tts_instruct_text": F.when(told, said).when(~dropped, F.col("tts_instruct_text")),
        "tts_instruct_source": F.when(told, F.when(said.isNotNull(), "manual")).when(~dropped, F.col("tts_instruct_source")),
        **_without(dropped, ["tts_instruct_emotion_label"]), **_without(dropped | told, ["tts_instruct_applied", "tts_instruct_error"]),
        "dub_stale": F.when(felt | told, True).otherwise(F.col("dub_stale")), **_without(felt | told, ["dub_input_signature"]),
    })


def edit_translations(rows: DataFrame, edits: DataFrame, stale: bool = True, keys: Sequence[str] = KEY) -> DataFrame:
    """edits (keys, text): the translation, which is also what is spoken. A text that is not blank ends a block; with ``stale`` the row
    is to be dubbed again and loses its instruction."""
    needed = {"text_translated": "string", "text_tts": "string", "translation_blocked": "boolean", "translation_blocked_reason": "string", "dub_stale": "boolean", "dub_input_signature": "string", **INSTRUCTION}
    met = _met(rows, edits, {"text": "string"}, needed, keys)
    hit = F.col("_text").isNotNull()
    opened = hit & F.col("_text").rlike(r"\S")
    values = {n: F.coalesce("_text", n) for n in ("text_translated", "text_tts")} | _without(F.coalesce(opened, F.lit(False)), ["translation_blocked", "translation_blocked_reason"])
    if stale:
        values |= {"dub_stale": F.when(hit, True).otherwise(F.col("dub_stale")), **_without(hit, ["dub_input_signature", *INSTRUCTION])}
    return _done(met, values)

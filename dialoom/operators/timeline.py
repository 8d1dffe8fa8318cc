"""Timelines: several keyed tables in one, overrides, carrying over, staleness by signature, patches and audits.

Keys are (clip_id, chunk_id). Side tables may hold a key more than once: the row with the largest ``ord`` wins. Their joins
are shuffled equi-joins; Spark broadcasts a side by its measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

KEY = ("clip_id", "chunk_id")


def last_wins(rows: DataFrame, keys: Sequence[str] = KEY, order: str = "ord") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def assemble(chunks: DataFrame, sides: dict[str, DataFrame], keys: Sequence[str] = KEY) -> DataFrame:
    """chunks with each side table as a struct column of its name, null where it has no row; a side's last duplicate counts."""
    for name, side in sides.items():
        rows = last_wins(side, keys) if "ord" in side.columns else side
        packed = rows.select(*keys, F.struct(*[c for c in rows.columns if c not in (*keys, "ord")]).alias(name))
        chunks = chunks.join(packed, list(keys), "left")
    return chunks


def present_else(side: Column, field: str, fallback: Column) -> Column:
    """The side's field where the side has a row, even if it is null there; else the fallback."""
    return F.when(side.isNotNull(), side.getField(field)).otherwise(fallback)


def filled_else(value: Column, fallback: Column) -> Column:
    """The value unless it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def override(chunks: DataFrame, overrides: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """overrides (keys, speaker?, reference?, clear_reference?): a changed speaker keeps the old one in original_speaker."""
    o = overrides.select(*keys, F.col("speaker").alias("_s"), F.col("reference").alias("_r"), F.col("clear_reference").alias("_c"))
    met = chunks.join(o, list(keys), "left")
    changed = F.col("_s").isNotNull() & (F.col("_s") != F.col("speaker"))
    met = met.withColumn("original_speaker", F.when(changed, F.col("speaker"))).withColumn("speaker", F.when(changed, F.col("_s")).otherwise(F.col("speaker")))
    return met.withColumn("reference", F.when(F.coalesce("_c", F.lit(False)), None).otherwise(F.coalesce("_r", "reference"))).drop("_s", "_r", "_c")


def carry_over(now: DataFrame, before: DataFrame, value: str, keys: Sequence[str] = KEY, texts: Sequence[str] = ("text_src", "text_translated")) -> DataFrame:
    """now with ``value`` from before: from the same key if its texts are the same, else from the one row of the clip with these texts."""
    norm = lambda d: d.select("*", F.xxhash64(*[X.normalized(F.col(t)) for t in texts]).alias("_h"))
    a, b = norm(now), norm(before)
    by_key = b.select(*keys, F.col("_h"), F.col(value).alias("_k"))
    clip = [k for k in keys if k != keys[-1]]
    unique = b.withColumn("_n", F.count("*").over(Window.partitionBy(*clip, "_h"))).filter("_n = 1").select(*clip, "_h", F.col(value).alias("_t"))
    met = a.join(by_key, [*keys, "_h"], "left").join(unique, [*clip, "_h"], "left")
    source = F.when(F.col("_k").isNotNull(), "id").when(F.col("_t").isNotNull(), "text").otherwise("none")
    return met.withColumn(value, F.coalesce("_k", "_t")).withColumn("carried", source).drop("_h", "_k", "_t")


def signature(*columns: Column, places: int = 6) -> Column:
    """SHA-256 of the columns' canonical text: texts with white space normalised, numbers rounded, nulls kept apart."""
    parts = [F.coalesce(F.concat(F.lit("="), F.when(_is_text(c), X.normalized(c.cast("string"))).otherwise(number_text(c, places))), F.lit("0")) for c in columns]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def file_signature(rows: DataFrame, listing: DataFrame, file: str, columns: Sequence[str], places: int = 3) -> DataFrame:
    """rows with a ``signature`` of the columns and of the file they name: listing (path, length, modified), as ``sources.artifacts`` has it.

    A file that is written again, even with the same length, gives another signature; so does one that is gone or comes back.
    """
    found = listing.select(F.col("path").alias(file), F.col("length").alias("_length"), F.unix_micros("modified").alias("_modified"))
    met = rows.join(found, file, "left")
    own = [F.col(c) for c in (file, *columns)]
    return met.withColumn("signature", signature(*own, F.col("_length").cast("string"), F.col("_modified").cast("string"), places=places)).drop("_length", "_modified")


def _is_text(c: Column) -> Column:
    return F.typeof(c).isin("string", "boolean", "date", "timestamp", "timestamp_ntz")


def number_text(c: Column, places: int = 6) -> Column:
    """A number's text after rounding, so that noise in the last digits makes no difference; null for other texts."""
    return F.bround(c.try_cast("double") + F.lit(0.0), places).cast("string")


def staleness(now: DataFrame, before: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """now (keys, signature) against before (keys, signature, output): state new, fresh or stale."""
    b = before.select(*keys, F.col("signature").alias("_s"), F.col("output").alias("_o"))
    met = now.join(b, list(keys), "left")
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_s").eqNullSafe(F.col("signature")), "fresh").otherwise("stale")
    return met.withColumn("state", state).drop("_s", "_o")


def reuse(now: DataFrame, before: DataFrame, value: str, keys: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(reused, changed): rows of now whose signature is unchanged, with the value of before, and the rows to compute again."""
    b = before.select(*keys, "signature", value)
    same = [*keys, "signature"]
    return now.join(b, same), now.join(b, same, "left_anti")


def all_reusable(now: DataFrame, before: DataFrame, keys: Sequence[str] = KEY, by: Sequence[str] = ("clip_id",)) -> DataFrame:
    """(by, reusable): whether each expected key of the group has an unchanged row before."""
    b = before.select(*keys, F.col("signature").alias("_s"))
    return now.join(b, list(keys), "left").groupBy(*by).agg(F.bool_and(F.coalesce(F.col("_s") == F.col("signature"), F.lit(False))).alias("reusable"))


def missing_keys(updates: DataFrame, rows: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return updates.select(*keys).distinct().join(rows.select(*keys), list(keys), "left_anti")


def key_differences(expected: DataFrame, got: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, side): keys that only one of two tables has, missing or extra."""
    a, b = expected.select(*keys).distinct().withColumn("_a", F.lit(1)), got.select(*keys).distinct().withColumn("_b", F.lit(1))
    met = a.join(b, list(keys), "full_outer").filter("_a IS NULL OR _b IS NULL")
    return met.select(*keys, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("side"))


def duplicate_keys(rows: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def patch(rows: DataFrame, updates: DataFrame, fields: Sequence[str], clears: dict[str, Sequence[str]], keys: Sequence[str] = KEY) -> DataFrame:
    """rows with the non-null fields of updates. A field that changes clears the columns named for it and sets ``stale``."""
    u = updates.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    met = rows.join(u, list(keys), "left")
    changed = {f: F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f)) for f in fields}
    any_change = F.lit(False)
    for c in changed.values():
        any_change = any_change | c
    out = {}
    for name in rows.columns:
        gone = [changed[f] for f, cleared in clears.items() if name in cleared]
        value = F.coalesce(F.col(f"_{name}"), F.col(name)) if name in fields else F.col(name)
        for g in gone:
            value = F.when(g, F.lit(None)).otherwise(value)
        out[name] = value
    stale = F.coalesce(F.col("stale"), F.lit(False)) if "stale" in rows.columns else F.lit(False)
    out["stale"] = stale | any_change
    return met.select(*[c.alias(n) for n, c in out.items()])


def audit(before: DataFrame, after: DataFrame, fields: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, field, before, after): a row for each field that differs."""
    a, b = (d.select(*keys, *[F.col(f).cast("string").alias(f"{p}{f}") for f in fields]) for d, p in ((before, "a_"), (after, "b_")))
    met = a.join(b, list(keys))
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("before"), F.col(f"b_{f}").alias("after")) for f in fields])
    return met.select(*keys, F.explode(items).alias("x")).select(*keys, "x.*").filter("NOT before <=> after")


def upsert(rows: DataFrame, updates: DataFrame, fields: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """Rows and updates in one; an update replaces the fields of its key, and a key whose fields are all null goes."""
    u = updates.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_u"))
    met = rows.join(u, list(keys), "full_outer")
    merged = met.select(*keys, *[F.when(F.col("_u"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields])
    return merged.filter(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull())


def replace_rows(rows: DataFrame, pieces: DataFrame, by: Sequence[str] = ("clip_id",), key: str = "chunk_id") -> DataFrame:
    """Rows with those replaced that have pieces (1 to n), numbered anew in time order."""
    kept = rows.join(pieces.select(*by, key).distinct(), [*by, key], "left_anti")
    both = kept.unionByName(pieces.select(*kept.columns))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("start", "end", key))
    return both.withColumn("old_id", F.col(key)).withColumn(key, F.format_string("chunk_%04d", place))


def dialogue_filter(chunks: DataFrame, languages: Sequence[str]) -> DataFrame:
    """chunks with ``reason`` why a line is no dialogue to work on: empty_text, language, or null if it is."""
    language = F.lower(F.coalesce("language", F.lit("")))
    return chunks.withColumn("reason", F.when(X.normalized(F.col("text_src")) == "", "empty_text").when(~language.isin([x.lower() for x in languages]), "language"))


def chunk_status(blocked: Column, error: Column, stale: Column, done: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(blocked), "blocked").when(F.coalesce(error, F.lit("")) != "", "error").when(yes(stale), "stale").when(yes(done), "done").otherwise("queued")


def find_rows(rows: DataFrame, speaker: str | None = None, emotion: str | None = None, search: str = "", problems_only: bool = False) -> DataFrame:
    """The list filter: exact speaker and emotion, a text in id, source or translation, rows with a problem."""
    out = rows
    if speaker:
        out = out.filter(F.col("speaker") == speaker)
    if emotion:
        out = out.filter(F.col("emotion") == emotion)
    if search:
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", "chunk_id", "text_src", "text_translated")), F.lit(search.lower())))
    if problems_only:
        out = out.filter("status IN ('blocked', 'error', 'stale') OR NOT accepted")
    return out


#: Other spellings of reference modes and emotion labels.
REFERENCE_MODES = {
    "": "auto", "auto": "auto", "default": "auto", "hybrid": "auto", "self": "self", "self_only": "self", "force_self": "self",
    "speaker_bank": "speaker_bank", "speaker_best": "speaker_bank", "bank": "speaker_bank", "best": "speaker_bank", "manual": "manual",
}
EMOTION_SYNONYMS = {
    "disgust": "disgusted", "fear": "fearful", "happiness": "happy", "sadness": "sad", "surprise": "surprised", "": "unknown", "unk": "unknown", "<unk>": "unknown",
}


def _named(value: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def reference_mode(value: Column) -> Column:
    """The canonical reference mode; an unknown one is an error."""
    word = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    known = _named(word, REFERENCE_MODES)
    return F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown reference mode: "), word)).cast("string"))


def emotion_label(value: Column) -> Column:
    """The part after the last slash in lower case, blanks as underscores, synonyms resolved."""
    word = F.replace(F.lower(F.trim(F.element_at(F.split(F.coalesce(value, F.lit("")), "/"), -1))), F.lit(" "), F.lit("_"))
    return F.coalesce(_named(word, EMOTION_SYNONYMS), word)


def label_scores(rows: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, label, scores): rows (keys, label, score) with labels made canonical; of equal labels the larger score counts."""
    best = rows.withColumn("label", emotion_label(F.col("label"))).groupBy(*keys, "label").agg(F.max("score").alias("score"))
    return best.groupBy(*keys).agg(F.max_by("label", F.struct("score", "label")).alias("top"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "score")))).alias("scores")).withColumnRenamed("top", "label")


def keep_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Those of the named columns that there are, in the given order."""
    return rows.select(*[n for n in names if n in rows.columns])


def duration_of(duration: Column, start: Column, end: Column) -> Column:
    """The duration, or where it is missing the difference of the ends."""
    return F.coalesce(duration, F.when(end > start, end - start))


def dub_duration(*places: Column) -> Column:
    """The first positive duration among the places where one may stand."""
    return F.coalesce(*[F.when(p > 0, p) for p in places])


def scoped_reference(rows: DataFrame, by: Sequence[str] = ("clip_id",)) -> DataFrame:
    """rows (chunk_id, speaker, reference) with ``reference_state``: ok, missing, or other_speaker where the reference is another's."""
    other = rows.select(*by, F.col("chunk_id").alias("reference"), F.col("speaker").alias("_owner"))
    met = rows.join(other, [*by, "reference"], "left")
    state = F.when(F.col("reference").isNull(), "none").when(F.col("_owner").isNull(), "missing").when(F.col("_owner") != F.col("speaker"), "other_speaker").otherwise("ok")
    return met.withColumn("reference_state", state).drop("_owner")


def mark_stale(rows: DataFrame, ids: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """rows with ``stale`` set for the given keys; missing_keys() tells the keys that no row has."""
    marked = ids.select(*keys).distinct().withColumn("_m", F.lit(True))
    old = F.coalesce(F.col("stale"), F.lit(False)) if "stale" in rows.columns else F.lit(False)
    return rows.join(marked, list(keys), "left").withColumn("stale", old | F.coalesce("_m", F.lit(False))).drop("_m")


def scene_dialogue(rows: DataFrame, text: str = "text_src", by: Sequence[str] = ("clip_id",)) -> DataFrame:
    """(by, dialogue): a scene's lines in order, blank ones left out."""
    kept = rows.filter(X.normalized(F.col(text)) != "")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_ord", X.normalized(F.col(text)).alias("line"))))
    return kept.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("dialogue"))


def reply_rows(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Replies holding {"items": [{"chunk_id": ..., "value": ...}]} somewhere -> their items with an id and a value; the others are dropped."""
    parsed = F.from_json(X.json_object_text(F.col(reply)), "struct<items:array<struct<chunk_id:string,value:string>>>")
    items = replies.select(*[c for c in replies.columns if c != reply], F.inline(parsed.items))
    return items.filter((F.trim(F.coalesce("chunk_id", F.lit(""))) != "") & F.col("value").isNotNull())


def reply_text(reply: Column) -> Column:
    """The text of a reply in any of the usual layouts of text services; null if there is none."""
    paths = ("$.choices[0].message.content", "$.choices[0].text", "$.candidates[0].content.parts[0].text", "$.output_text", "$.content[0].text", "$.text")
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(reply, p)), F.lit("")) for p in paths])


def validated(rows: DataFrame, gates: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """rows with the gate of gates (keys, gate) attached; a rejected one sets error and stale, an accepted one clears the error."""
    met = rows.join(gates.select(*keys, F.col("gate").alias("_g")), list(keys), "left")
    bad = F.col("_g").isNotNull() & ~F.col("_g.accepted")
    error = F.when(bad, F.array_join("_g.critical_flags", ",")).when(F.col("_g").isNotNull(), None).otherwise(F.col("error"))
    return met.withColumn("error", error).withColumn("stale", F.coalesce("stale", F.lit(False)) | bad).withColumnRenamed("_g", "gate")

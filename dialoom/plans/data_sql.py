"""The queries of data_queries.py in SQL."""

from ..functions.text import NEGATIVE_WORDS
from .interval_queries import _merge_sql
from .oracle_views import CHUNKS, CLOCK, EMB, RUNS, STEPS, cos, norm

_TOK = r"'[A-Za-z0-9ㄱ-ㆎ가-힣]+'"
_LATIN = "'[A-Za-z0-9]+'"
_SYL = "'[A-Za-z0-9ㄱ-ㆎ가-힣぀-ヿ一-鿿]'"
_NEGATIVE = "'(?i)\\b(" + "|".join(NEGATIVE_WORDS).replace("'", "''") + ")\\b'"


def _chars(t: str) -> str:
    return f"length(regexp_replace({norm(t)}, '\\s+', '', 'g'))"


def _repeat(t: str) -> str:
    found = f"regexp_extract_all(lower({norm(t)}), {_TOK})"
    return f"CASE WHEN len({found}) < 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - list_unique({found}) / len({found}) END"


FEATURES = CHUNKS + """, feat AS (
  SELECT *, (clip_id + chunk_ord) % 5 <> 0 AS known, chunk_ord % 11 / 11.0::DOUBLE AS silence, chunk_ord % 4 / 8.0::DOUBLE AS voiced, chunk_ord % 9 / 100.0::DOUBLE AS clipping FROM chunks
)"""


def _gate(source: str, keys: str, flags: list[tuple[str, str]], warnings: list[tuple[str, str]]) -> str:
    held = lambda rules: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + "], lambda x: x IS NOT NULL)"
    return f""", rules AS (SELECT *, {held(flags)} AS f, {held(warnings)} AS w FROM {source})
SELECT {keys}, len(f) = 0 AS accepted, array_to_string(f, ',') AS flags, array_to_string(w, ',') AS warnings,
  round(greatest(0.0::DOUBLE, 1.0::DOUBLE - least(0.75::DOUBLE, 0.25::DOUBLE * len(f)) - least(0.2::DOUBLE, 0.05::DOUBLE * len(w))), 3) AS score FROM rules"""


_VOICED = "CASE WHEN voiced = 0 THEN 1.0 ELSE voiced END"
_REFERENCE = ([
    ("missing_reference_audio", "chunk_ord % 6 = 5"), ("missing_reference_transcript", f"{norm('text_src')} = ''"), ("invalid_reference_duration", "duration <= 0"),
    ("reference_too_short_critical", "duration > 0 AND duration < 0.55"), ("reference_mostly_silent", "known AND silence > 0.85"),
    ("reference_low_voiced_ratio", f"known AND {_VOICED} < 0.08"), ("reference_clipping_severe", "known AND clipping > 0.05"),
], [
    ("reference_short", "duration >= 0.55 AND duration < 1.2"), ("reference_high_silence", "known AND silence > 0.6 AND silence <= 0.85"),
    ("reference_sparse_voicing", f"known AND {_VOICED} >= 0.08 AND {_VOICED} < 0.25"), ("reference_clipping", "known AND clipping > 0.01 AND clipping <= 0.05"),
])
_REF_ROWS = f"WITH {FEATURES}" + _gate("feat", "clip_id, chunk_ord, speaker, duration, text_src, CASE WHEN known THEN voiced ELSE 0.0 END AS voiced_ratio", *_REFERENCE)

_BUDGET = CHUNKS + f""", lang AS (SELECT *, chunk_ord % 2 = 0 AS ko, chunk_ord % 4 AS pause, len(regexp_extract_all({norm('text_src')}, CASE WHEN chunk_ord % 2 = 0 THEN {_SYL} ELSE {_LATIN} END)) AS source_units FROM chunks),
b1 AS (
  SELECT *, greatest(1, round_even(duration * CASE WHEN ko THEN 3.6::DOUBLE ELSE 2.0::DOUBLE END, 0)::INT) AS lo,
    greatest(1, round_even(duration * CASE WHEN ko THEN 4.8::DOUBLE ELSE 3.0::DOUBLE END, 0)::INT) AS want, round_even(duration * CASE WHEN ko THEN 6.2::DOUBLE ELSE 4.2::DOUBLE END, 0)::INT AS hi0 FROM lang
), b2 AS (SELECT *, greatest(lo, hi0) AS hi FROM b1),
b3 AS (SELECT *, CASE WHEN source_units > 0 THEN greatest(lo, least(hi, greatest(source_units * 2, lo))) ELSE hi END AS held FROM b2),
b4 AS (SELECT *, CASE WHEN source_units > 0 THEN least(held, greatest(lo, want)) ELSE want END AS aim, held + CASE WHEN pause >= 2 THEN least(6, pause) ELSE 0 END AS most FROM b3)"""

_DOCS = """b AS (SELECT doc_id, text, lang, source, 'x' AS output FROM documents),
a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' WHEN doc_id % 7 = 0 THEN '  ' || text ELSE text END AS text, lang, source, output FROM b)"""

_SIMS = EMB + f""", met AS (SELECT e.chunk_ord, e.speaker, t.speaker AS label, t.n, e.embedding AS x, t.total, {cos('e.embedding', 't.total')} AS sim FROM emb e, total t),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_ord ORDER BY sim DESC, label) AS r FROM met),
best AS (
  SELECT chunk_ord, any_value(speaker) AS speaker, max(sim) FILTER (label = speaker) AS own_sim, max(label) FILTER (r = 1) AS best, max(sim) FILTER (r = 1) AS best_sim, max(sim) FILTER (r = 2) AS second_sim
  FROM ranked GROUP BY chunk_ord
)"""

_LOG = """log AS (
  SELECT 'r' || user_id AS run_id, epoch_us(ts) / 1e6::DOUBLE AS ts, event_id, 's_' || substr('abcd', event_id % 4 + 1, 1) AS s,
    CASE event_type WHEN 'view' THEN 'step_start' WHEN 'click' THEN 'step_done' WHEN 'error' THEN 'step_error' ELSE 'log' END AS type, event_type FROM events
), st AS (SELECT * FROM log WHERE type <> 'log'), dur AS (
  SELECT *, CASE WHEN type <> 'step_start' THEN coalesce(CASE WHEN lag(type) OVER w = 'step_start' THEN round_even((ts - lag(ts) OVER w) * 1000, 0)::BIGINT END, 0) END AS duration_ms
  FROM st WINDOW w AS (PARTITION BY run_id, s ORDER BY ts, event_id)
)"""
_VIEW = CHUNKS + """, vw AS (
  SELECT *, CASE WHEN chunk_ord % 13 = 12 THEN 'blocked' WHEN chunk_ord % 7 = 6 THEN 'error' WHEN chunk_ord % 5 = 4 THEN 'stale' WHEN chunk_ord % 2 = 0 THEN 'done' ELSE 'queued' END AS status,
    clip_id % 6 <> 0 AS accepted, CASE WHEN chunk_ord % 3 <> 0 THEN speaker END AS emotion FROM chunks
)"""
_VOTES = """WITH RECURSIVE seg AS (
  SELECT user_id * 100 + floor((epoch_us(ts) / 1e6::DOUBLE - 1704067200) / 86400)::BIGINT AS clip_id, event_id AS node, event_type AS speaker, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS other FROM events
), v AS (
  SELECT clip_id, node, 0 AS voter, speaker AS label FROM seg UNION ALL SELECT clip_id, node, 1, 'k' || other FROM seg
  UNION ALL SELECT clip_id, node, 2, 'n' || (node % 4) FROM seg WHERE node % 5 <> 0
), e AS (SELECT a.clip_id, a.node AS x, b.node AS y FROM v a JOIN v b USING (clip_id, voter, label) WHERE a.node <> b.node GROUP BY ALL HAVING count(*) / 3 >= 0.6),
reach AS (SELECT clip_id, node AS x, node AS y FROM seg UNION SELECT r.clip_id, r.x, e.y FROM reach r JOIN e ON e.clip_id = r.clip_id AND e.x = r.y)"""

ORACLE_SQL = {
    "text_metrics": f"""SELECT doc_id, {_chars('text')} AS characters, len(regexp_extract_all({norm('text')}, {_TOK})) AS words, {_repeat('text')} AS repetition,
  coalesce(regexp_extract_all(lower({norm('text')}), {_TOK})[1], '') AS first_token, length(array_to_string(regexp_extract_all(lower({norm('text')}), {_TOK}), '')) AS content_length,
  'unknown' AS register, regexp_matches(text, {_NEGATIVE}) AS negative FROM documents""",
    "budget": f"""WITH {_BUDGET} SELECT clip_id, chunk_ord, source_units, lo AS min_units, aim AS target_units, most AS max_units, source_units AS actual_units,
  source_units >= lo AND source_units <= most AS within_budget, source_units > most AS over_budget, source_units > 0 AND source_units < lo AS under_budget, abs(source_units - aim) AS distance_from_target FROM b4""",
    "speech_estimate": f"""WITH {CHUNKS}, e AS (SELECT *, greatest(0.6::DOUBLE, {_chars('text_src')} / 12.0::DOUBLE) AS estimate FROM chunks),
t AS (SELECT *, greatest(0.8::DOUBLE, least(1.25::DOUBLE, estimate / duration)) AS tempo FROM e)
SELECT clip_id, chunk_ord, estimate, estimate / duration AS ratio, least(duration, least(4.5::DOUBLE, greatest(1.4::DOUBLE, 1.4::DOUBLE * estimate))) AS cap, tempo,
  CASE WHEN abs(estimate / tempo - duration) < 1e-6 THEN 'none' WHEN estimate / tempo < duration THEN 'pad' ELSE 'trim' END AS action FROM t""",
    "asr_gate": f"WITH {FEATURES}" + _gate("feat", "clip_id, chunk_ord", [("blank_transcript", f"duration > 0.8 AND {norm('text_src')} = ''")], [
        ("suspiciously_sparse_transcript", f"{norm('text_src')} <> '' AND duration >= 2.0 AND {_chars('text_src')} / duration < 0.8"),
        ("suspiciously_dense_transcript", f"{norm('text_src')} <> '' AND {_chars('text_src')} / duration > 18.0"),
        ("repetitive_transcript", f"{norm('text_src')} <> '' AND {_repeat('text_src')} > 0.6"), ("low_voiced_ratio", f"known AND {_VOICED} < 0.1"),
        ("mostly_silent_chunk", "known AND silence > 0.8")]),
    "reference_gate": f"WITH {FEATURES}" + _gate("feat", "clip_id, chunk_ord", *_REFERENCE),
    "reference_bank": f"SELECT clip_id, speaker, chunk_ord, duration FROM ({_REF_ROWS}) WHERE accepted QUALIFY row_number() OVER (PARTITION BY clip_id, speaker ORDER BY score DESC, duration DESC, voiced_ratio DESC, chunk_ord) = 1",
    "reference_choice": f"""WITH r AS ({_REF_ROWS}), b AS (SELECT clip_id, speaker, chunk_ord AS best FROM r WHERE accepted QUALIFY row_number() OVER (PARTITION BY clip_id, speaker ORDER BY score DESC, duration DESC, voiced_ratio DESC, chunk_ord) = 1)
SELECT r.clip_id, r.chunk_ord, CASE WHEN accepted THEN 'self' WHEN best IS NOT NULL THEN 'bank' WHEN {norm('text_src')} <> '' THEN 'forced_self' ELSE 'error' END AS reference_mode,
  CASE WHEN accepted THEN r.chunk_ord WHEN best IS NOT NULL THEN best WHEN {norm('text_src')} <> '' THEN r.chunk_ord END AS reference_ord FROM r LEFT JOIN b USING (clip_id, speaker)""",
    "reference_ranking": f"SELECT clip_id, chunk_ord, speaker, row_number() OVER (PARTITION BY clip_id, speaker ORDER BY accepted DESC, score DESC, duration DESC, chunk_ord) AS rank FROM ({_REF_ROWS})",
    "translation_gate": f"""WITH {CHUNKS}, nx AS (SELECT *, lead(text_src) OVER (PARTITION BY clip_id ORDER BY chunk_ord) AS t, len(regexp_extract_all({norm('text_src')}, {_LATIN})) AS source_units FROM chunks),
u AS (SELECT *, len(regexp_extract_all({norm('t')}, {_LATIN})) AS actual, greatest(1, round_even(duration * 2.0, 0)::INT) AS lo, round_even(duration * 4.2::DOUBLE, 0)::INT AS hi0 FROM nx),
z AS (SELECT *, CASE WHEN source_units > 0 THEN greatest(lo, least(greatest(lo, hi0), greatest(source_units * 2, lo))) ELSE greatest(lo, hi0) END AS most FROM u)""" + _gate(
        "z", "clip_id, chunk_ord", [("blank_translation", f"{norm('text_src')} <> '' AND {norm('t')} = ''")], [
            ("repetitive_translation", f"{norm('t')} <> '' AND {_repeat('t')} > 0.55"), ("mixed_register", "false"),
            ("translation_over_budget", "actual > 0 AND most > 0 AND actual > most"), ("translation_under_budget", "actual > 0 AND lo > 0 AND actual < lo")]),
    "audio_gate": f"WITH {FEATURES}" + _gate("feat", "clip_id, chunk_ord", [
        ("empty_tts_output", "duration <= 0"), ("tts_under_duration_severe", "duration / (chunk_ord + 1) < 0.55"), ("tts_over_duration_severe", "duration / (chunk_ord + 1) > 1.45"),
        ("tts_mostly_silent", "known AND silence > 0.7"), ("tts_clipping_severe", "known AND clipping > 0.05")], [
        ("tts_under_duration", "duration / (chunk_ord + 1) >= 0.55 AND duration / (chunk_ord + 1) < 0.78"), ("tts_over_duration", "duration / (chunk_ord + 1) > 1.22 AND duration / (chunk_ord + 1) <= 1.45"),
        ("tts_high_silence", "known AND silence > 0.45 AND silence <= 0.7"), ("tts_clipping", "known AND clipping > 0.01 AND clipping <= 0.05")]),
    "merged_gates": f"SELECT clip_id, chunk_ord, 'asr,reference' AS stages, score AS asr_score FROM ({_REF_ROWS})",
    "register_memory": f"""WITH {CHUNKS} SELECT clip_id, chunk_ord, last_value(CASE WHEN text_src LIKE '%?' THEN 'polite' WHEN text_src LIKE '%!' THEN 'casual' END IGNORE NULLS)
  OVER (PARTITION BY clip_id, speaker ORDER BY chunk_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS register FROM chunks""",
    "neighbour_lines": f"WITH {CHUNKS} SELECT clip_id, chunk_ord, lag(text_src) OVER w AS previous_line, lead(text_src) OVER w AS next_line FROM chunks WINDOW w AS (PARTITION BY clip_id ORDER BY chunk_ord)",
    "transcript_render": f"""WITH {CHUNKS} SELECT clip_id, string_agg(printf('%03d. [%s] [%s] [%.2f-%.2fs] %s', chunk_ord + 1, chunk_id, speaker, round(start, 2), round("end", 2), coalesce(nullif({norm('text_src')}, ''), '[empty or unrecognized line]')), chr(10) ORDER BY chunk_ord) AS transcript FROM chunks GROUP BY clip_id""",
    "emotion_blend": """WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS t FROM c GROUP BY 1),
l AS (SELECT unnest(['click', 'view', 'purchase', 'error', 'signup']) AS e, unnest([1, 2, 3, 4, 5]) AS o),
s AS (SELECT t.user_id, l.e, l.o, coalesce(c.n, 0) / t.t AS p FROM t CROSS JOIN l LEFT JOIN c ON c.user_id = t.user_id AND c.event_type = l.e),
h AS (SELECT user_id, arg_max(e, p * 1000000 - o) AS heard FROM s GROUP BY 1), r AS (SELECT user_id, arg_max(event_type, event_id) AS read FROM events GROUP BY 1),
k AS (SELECT c.user_id, c.event_type, row_number() OVER (PARTITION BY c.user_id ORDER BY n DESC, event_type) AS k FROM c),
top AS (SELECT user_id, string_agg(event_type, ',' ORDER BY k) AS top3 FROM k WHERE k <= 3 GROUP BY 1)
SELECT h.user_id, heard, read AS label, round(CASE WHEN heard = read THEN v.p ELSE 0.3::DOUBLE * v.p + CASE WHEN read = 'view' THEN 0.7 ELSE 0 END END, 9) AS view, top3
FROM h JOIN r USING (user_id) JOIN s v ON v.user_id = h.user_id AND v.e = 'view' JOIN top ON top.user_id = h.user_id""",
    "timeline_assembly": f"""WITH {CHUNKS}, d AS (SELECT doc_id % 500 AS clip_id, doc_id % 7 AS chunk_ord, lang, nullif(source, 'src3') AS source FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 500, doc_id % 7 ORDER BY doc_id DESC) = 1),
l AS (SELECT doc_id % 500 AS clip_id, doc_id % 5 AS chunk_ord, max(quality) AS quality FROM labels GROUP BY ALL)
SELECT c.clip_id, c.chunk_ord, CASE WHEN d.clip_id IS NOT NULL THEN d.source ELSE 'none' END AS source_if_present, coalesce(d.source, 'none') AS source_if_filled, d.lang, l.quality
FROM chunks c LEFT JOIN d ON d.clip_id = c.clip_id AND d.chunk_ord = c.chunk_ord LEFT JOIN l ON l.clip_id = c.clip_id AND l.chunk_ord = c.chunk_ord""",
    "override_join": f"""WITH {CHUNKS}, o AS (SELECT *, chunk_ord % 3 = 0 AS has, CASE WHEN chunk_ord % 3 = 0 AND clip_id % 2 = 0 THEN 'user' END AS s FROM chunks)
SELECT clip_id, chunk_ord, CASE WHEN s IS NOT NULL AND s <> speaker THEN s ELSE speaker END AS speaker, CASE WHEN s IS NOT NULL AND s <> speaker THEN speaker END AS original_speaker,
  CASE WHEN has AND clip_id % 3 = 0 THEN NULL WHEN has THEN 'ref' WHEN chunk_ord % 2 = 0 THEN chunk_id END AS reference FROM o""",
    "signature_stale": f"""WITH {_DOCS} SELECT a.doc_id, CASE WHEN a.doc_id % 11 = 0 THEN 'new' WHEN {norm('a.text')} = {norm('b.text')} THEN 'fresh' ELSE 'stale' END AS state FROM a JOIN b USING (doc_id)""",
    "reuse_split": f"""WITH {_DOCS} SELECT a.doc_id, CASE WHEN {norm('a.text')} = {norm('b.text')} THEN 'reused' ELSE 'changed' END AS part FROM a JOIN b USING (doc_id)""",
    "merge_patch": f"""WITH {_DOCS} SELECT b.doc_id, CASE WHEN b.doc_id % 10 = 0 THEN a.text ELSE b.text END AS text, b.source,
  CASE WHEN b.doc_id % 10 = 0 AND a.text <> b.text THEN NULL ELSE b.output END AS output, b.doc_id % 10 = 0 AND a.text <> b.text AS stale FROM a JOIN b USING (doc_id)""",
    "audit_diff": f"""WITH {_DOCS} SELECT doc_id, 'text' AS field, b.text AS before, a.text AS after FROM a JOIN b USING (doc_id) WHERE a.text <> b.text
UNION ALL SELECT doc_id, 'lang', lang, 'xx' FROM b WHERE doc_id % 9 = 0 AND lang <> 'xx'""",
    "carry_over": f"""WITH {CHUNKS}, n AS (SELECT clip_id, chunk_ord + (clip_id % 2 = 0)::INT AS chunk_ord, {norm('text_src')} AS t FROM chunks),
b AS (SELECT clip_id, chunk_ord, {norm('text_src')} AS t, 'say ' || chunk_id AS i, count(*) OVER (PARTITION BY clip_id, {norm('text_src')}) AS k FROM chunks)
SELECT n.clip_id, n.chunk_ord, coalesce(x.i, y.i) AS instruction, CASE WHEN x.i IS NOT NULL THEN 'id' WHEN y.i IS NOT NULL THEN 'text' ELSE 'none' END AS carried
FROM n LEFT JOIN b x ON x.clip_id = n.clip_id AND x.chunk_ord = n.chunk_ord AND x.t = n.t LEFT JOIN b y ON y.clip_id = n.clip_id AND y.t = n.t AND y.k = 1""",
    "key_differences": """SELECT d.doc_id, 'missing' AS side FROM documents d ANTI JOIN (SELECT doc_id + 5 AS doc_id FROM labels) l USING (doc_id)
UNION ALL SELECT DISTINCT l.doc_id, 'extra' FROM (SELECT doc_id + 5 AS doc_id FROM labels) l ANTI JOIN documents d USING (doc_id)""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "upserted": """WITH u AS (SELECT doc_id + 2 AS doc_id, NULL::VARCHAR AS lang, CASE WHEN doc_id % 8 = 0 THEN 'new' END AS source FROM documents WHERE doc_id % 4 = 0)
SELECT * FROM (SELECT doc_id, lang, source FROM documents d ANTI JOIN u USING (doc_id) UNION ALL SELECT * FROM u) WHERE coalesce(lang, source) IS NOT NULL""",
    "replaced_rows": f"""WITH {CHUNKS}, p AS (SELECT *, greatest(1, ceil(("end" - start) / 20.0::DOUBLE - 1e-9::DOUBLE))::INT AS k FROM chunks WHERE "end" - start > 20), q AS (SELECT *, unnest(range(0, k)) AS i, ("end" - start) / k AS w FROM p),
a AS (SELECT clip_id, chunk_id, speaker, start, "end" FROM chunks WHERE "end" - start <= 20
  UNION ALL SELECT clip_id, chunk_id, speaker, round(start + i * w, 6), round(CASE WHEN i = k - 1 THEN "end" ELSE start + (i + 1) * w END, 6) FROM q)
SELECT clip_id, printf('chunk_%04d', row_number() OVER (PARTITION BY clip_id ORDER BY start, "end", chunk_id)) AS chunk_id, speaker, start, "end" FROM a""",
    "dialogue_filter": f"SELECT CASE WHEN {norm('text')} = '' THEN 'empty_text' WHEN lower(lang) NOT IN ('en', 'de') THEN 'language' END AS reason, count(*) AS n FROM documents GROUP BY 1",
    "chunk_view": f"WITH {_VIEW} SELECT clip_id, chunk_ord, chunk_id, status, accepted, emotion, duration FROM vw",
    "chunk_filter": f"""WITH {_VIEW} SELECT clip_id, chunk_ord, status FROM vw WHERE speaker = 'user' AND contains(lower(chunk_id || ' ' || text_src), 'chunk_0002') AND (status IN ('blocked', 'error', 'stale') OR NOT accepted)""",
    "repair_counts": f"""WITH {_VIEW} SELECT count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'stale') AS stale,
  count(*) FILTER (NOT accepted) AS rejected, count(*) FILTER (status IN ('blocked', 'error', 'stale') OR NOT accepted) AS total FROM vw""",
    "run_metrics": f"""WITH {_VIEW}, h AS (SELECT clip_id, string_agg(emotion || '=' || n, ',' ORDER BY emotion) AS emotions FROM (SELECT clip_id, emotion, count(*) AS n FROM vw WHERE emotion IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT v.clip_id AS run_id, count(*) AS chunks, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS errors, round(avg(CASE WHEN chunk_ord % 4 <> 0 THEN duration END), 9) AS mean_ratio,
  any_value(h.emotions) AS emotions FROM vw v LEFT JOIN h USING (clip_id) GROUP BY v.clip_id""",
    "project_summary": f"""WITH {RUNS} SELECT input_stem, count(*) AS runs, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'running') AS n_running,
  min(created_at) AS first_created, max(created_at) AS last_created, arg_max(run_id, (created_at, run_id)) AS last_run, arg_max(status, (created_at, run_id)) AS last_status FROM runs GROUP BY 1""",
    "run_progress": f"""WITH {STEPS} SELECT run_id, count(*) AS steps, count(*) FILTER (state IN ('done', 'skipped')) AS finished,
  round_even(100.0::DOUBLE * count(*) FILTER (state IN ('done', 'skipped')) / count(*), 0)::INT AS progress_pct FROM steps GROUP BY 1""",
    "resume_point": f"WITH {STEPS} SELECT run_id, arg_min(name, ord) FILTER (state NOT IN ('done', 'skipped')) AS resume_at FROM steps GROUP BY 1",
    "failed_tail": f"""WITH {STEPS} SELECT run_id, ord, CASE WHEN ord > min(CASE WHEN state = 'failed' THEN ord END) OVER (PARTITION BY run_id) THEN 'pending' ELSE state END AS state FROM steps""",
    "step_range": f"WITH {STEPS} SELECT run_id, name FROM steps WHERE ord BETWEEN 2 AND 4",
    "kpi": f"""WITH {RUNS}, {STEPS}, w AS (SELECT run_id, max(ended_at) - min(started_at) AS wall FROM steps GROUP BY 1)
SELECT count(*) AS runs, count(DISTINCT input_stem) AS projects, round(count(*) FILTER (status = 'success') / count(*) FILTER (status IN ('success', 'failed')), 9) AS success_rate,
  round(avg(wall) FILTER (status = 'success'), 4) AS mean_wall FROM runs LEFT JOIN w USING (run_id)""",
    "group_failure": f"""WITH {RUNS}, {STEPS}, m AS (SELECT s.*, r.run_id IS NOT NULL AS bad, min(CASE WHEN state = 'pending' THEN ord END) OVER (PARTITION BY s.run_id) AS f
  FROM steps s LEFT JOIN (SELECT run_id FROM runs WHERE status = 'failed') r USING (run_id)) SELECT run_id, ord, CASE WHEN bad AND ord = f THEN 'failed' ELSE state END AS state FROM m""",
    "inferred_steps": f"WITH {STEPS} SELECT run_id, name AS step, state = 'done' OR bool_or(ord = 4 AND state = 'done') OVER (PARTITION BY run_id) AS complete FROM steps",
    "sweep_rollup": """WITH c AS (SELECT l_suppkey % 40 AS trial, NOT (l_partkey % 17 = 0 OR l_suppkey % 40 = 7) AS ok, floor(l_discount * 100) AS e, floor(l_quantity) AS s FROM lineitem),
t AS (SELECT trial, count(*) AS cells, count(*) FILTER (ok) AS done, avg(e / s) FILTER (ok AND s > 0) AS macro, max(e / s) FILTER (ok AND s > 0) AS worst,
  sum(e) FILTER (ok) / sum(s) FILTER (ok AND s > 0) AS weighted FROM c GROUP BY 1)
SELECT trial, cells, done, CASE WHEN done = 0 THEN 'failed' WHEN done < cells THEN 'partial' ELSE 'done' END AS status, round(macro, 9) AS macro, round(worst, 9) AS worst, round(weighted, 9) AS weighted,
  round(0.75::DOUBLE * weighted + 0.25::DOUBLE * worst, 9) AS combined FROM t""",
    "rank_trials": """SELECT p_partkey AS trial, coalesce(CASE WHEN p_size % 3 <> 0 THEN p_retailprice END, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END, 'inf'::DOUBLE) AS sort_value FROM part ORDER BY sort_value, trial LIMIT 25""",
    "parameter_grid": """SELECT g.v::DOUBLE AS gap, m.v::INT AS margin, k.v AS kind, 7 AS seed, row_number() OVER (ORDER BY g.v, m.v, k.v)::INT AS trial
FROM (SELECT unnest([0.1, 0.5]) AS v) g, (SELECT unnest([1, 2, 3]) AS v) m, (SELECT unnest(['a', 'b']) AS v) k""",
    "plateaus": """WITH p AS (SELECT p_partkey AS t, floor(p_size / 20)::BIGINT AS m FROM part), r AS (SELECT *, row_number() OVER (ORDER BY t) - row_number() OVER (PARTITION BY m ORDER BY t) AS g FROM p)
SELECT m AS main_count, min(t) AS first, max(t) AS last, count(*) AS length FROM r GROUP BY m, g""",
    "centroids": f"WITH {EMB} SELECT speaker, n, unnest(range(0, len(total)))::INT AS place, round(unnest(total) / sqrt(list_dot_product(total, total)), 9) AS x FROM total",
    "nearest_centroid": f"""WITH {_SIMS} SELECT chunk_ord, speaker, best, round(best_sim, 9) AS best_sim, round(second_sim, 9) AS second_sim,
  CASE WHEN best_sim >= 0.2 AND best_sim - second_sim >= 0.02 THEN best ELSE speaker END AS label FROM best""",
    "disagreements": f"WITH {_SIMS} SELECT chunk_ord, speaker, best FROM best WHERE best <> speaker",
    "embed_reassign_pass1": f"""WITH {EMB}, met AS (
  SELECT e.chunk_ord, e.speaker, t.speaker AS label, t.n, e.embedding AS x, CASE WHEN e.speaker = t.speaker THEN list_transform(list_zip(t.total, e.embedding), lambda p: p[1] - p[2]) ELSE t.total END AS c FROM emb e, total t
), s AS (SELECT *, CASE WHEN speaker = label AND n = 1 THEN 1.0 ELSE {cos('x', 'c')} END AS sim FROM met),
b AS (SELECT chunk_ord, any_value(speaker) AS speaker, max(sim) FILTER (label = speaker) AS own, arg_max(label, sim) AS best, max(sim) AS top FROM s GROUP BY 1)
SELECT chunk_ord, CASE WHEN best <> speaker AND top > own + 0.05 AND top >= 0.1 THEN best ELSE speaker END AS speaker FROM b""",
    "cohesion": f"""WITH {EMB}, s AS (SELECT e.speaker, avg({cos('e.embedding', 't.total')}) AS s FROM emb e JOIN total t USING (speaker) GROUP BY 1) SELECT 0 AS clip_id, round(avg(s), 9) AS cohesion FROM s""",
    "merge_candidates": f"WITH {EMB} SELECT x.speaker AS a, y.speaker AS b, round({cos('x.total', 'y.total')}, 9) AS sim FROM total x JOIN total y ON x.speaker < y.speaker",
    "silhouette": f"""WITH {EMB}, u AS (SELECT chunk_ord, speaker, list_transform(embedding, lambda v: v / sqrt(list_dot_product(embedding, embedding))) AS x FROM emb),
d AS (SELECT a.chunk_ord, a.speaker, b.speaker AS l, avg(1 - list_dot_product(a.x, b.x)) AS d FROM u a JOIN u b ON a.chunk_ord <> b.chunk_ord GROUP BY ALL),
m AS (SELECT chunk_ord, max(d) FILTER (l = speaker) AS a, min(d) FILTER (l <> speaker) AS b FROM d GROUP BY 1) SELECT chunk_ord, round((b - a) / greatest(a, b), 9) AS silhouette FROM m WHERE a IS NOT NULL AND b IS NOT NULL""",
    "gender_split": """WITH e AS (SELECT vec_id // 50 AS clip_id, vec_id AS chunk_ord, printf('S%02d', label) AS speaker, vec_id * 37 % 240 + 80.0 AS f0 FROM embeddings),
c AS (SELECT *, count(*) FILTER (f0 <= 150) OVER w AS m, count(*) FILTER (f0 >= 220) OVER w AS f FROM e WINDOW w AS (PARTITION BY clip_id, speaker))
SELECT clip_id, chunk_ord, speaker || CASE WHEN m >= 2 AND f >= 2 AND m < f AND f0 <= 150 THEN '_gM' WHEN m >= 2 AND f >= 2 AND m >= f AND f0 >= 220 THEN '_gF' ELSE '' END AS speaker FROM c""",
    "consensus_labels": _VOTES + " SELECT clip_id, x AS node, min(y) AS component FROM reach GROUP BY ALL",
    "time_gap_parts": f"""WITH {CLOCK}, g AS (SELECT *, coalesce(start - lag("end") OVER (PARTITION BY clip_id, speaker ORDER BY start, seg_ord) >= 90, false) AS new FROM clk)
SELECT clip_id, seg_ord AS chunk_ord, (sum(new::INT) OVER (PARTITION BY clip_id, speaker ORDER BY start, seg_ord))::BIGINT AS part FROM g""",
    "face_evidence": f"""WITH {CLOCK}, f AS (SELECT clip_id, (seg_ord % 4 % 3)::INT AS face, start + 9 AS t, ("end" - start) / 64 AS score FROM clk)
SELECT c.clip_id, c.seg_ord AS chunk_ord, f.face, count(*) AS frames, sum(f.score) AS score FROM clk c JOIN f ON f.clip_id = c.clip_id AND f.score >= 0.25 AND c.start <= f.t AND f.t < c."end" GROUP BY ALL""",
    "cluster_purity": f"""WITH {CLOCK}, n AS (SELECT clip_id, other AS cluster, speaker, count(*) AS n FROM clk GROUP BY ALL)
SELECT clip_id, cluster, speaker, round(n / sum(n) OVER (PARTITION BY clip_id, cluster), 9) AS purity FROM n QUALIFY row_number() OVER (PARTITION BY clip_id, cluster ORDER BY n DESC, speaker DESC) = 1""",
    "role_overlaps": f"""WITH {CLOCK}, e AS (SELECT clip_id, start, start + 120 AS "end", other AS role FROM clk)
SELECT e.clip_id, e.role, c.speaker, sum(least(e."end", c."end") - greatest(e.start, c.start)) AS seconds FROM e JOIN clk c ON c.clip_id = e.clip_id AND c.start < e."end" AND e.start < c."end" GROUP BY ALL""",
    "expectations": f"""WITH {CLOCK}, e AS (SELECT clip_id, seg_ord AS id, ['single_role', 'ordered_roles', 'non_asr'][seg_ord % 3 + 1] AS kind, start, start + 120 AS "end", other AS role FROM clk),
o AS (SELECT e.clip_id, e.id, e.kind, e.role, c.speaker, c.start, c.seg_ord, least(e."end", c."end") - greatest(e.start, c.start) AS s
  FROM e JOIN clk c ON c.clip_id = e.clip_id AND c.start < e."end" AND e.start < c."end"),
r AS (SELECT clip_id, role, speaker, sum(s) AS s FROM o WHERE kind = 'single_role' GROUP BY ALL),
combos AS (SELECT a.clip_id, a.speaker AS m0, b.speaker AS m1, c.speaker AS m2, a.s + b.s + c.s AS s FROM r a JOIN r b ON b.clip_id = a.clip_id AND a.role = 'm0' AND b.role = 'm1' AND a.speaker <> b.speaker
  JOIN r c ON c.clip_id = a.clip_id AND c.role = 'm2' AND c.speaker NOT IN (a.speaker, b.speaker)),
best AS (SELECT * FROM combos QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY s DESC) = 1),
m AS (SELECT clip_id, unnest(['m0', 'm1', 'm2']) AS role, unnest([m0, m1, m2]) AS speaker FROM best),
t AS (SELECT e.clip_id, e.id, e.kind, m.speaker AS named, coalesce(sum(o.s), 0) AS spoken, coalesce(sum(o.s) FILTER (o.speaker = m.speaker), 0) AS mine, coalesce(arg_min(o.seg_ord, o.start) FILTER (o.s >= 0.12 AND o.speaker = m.speaker) < max(o.seg_ord) FILTER (o.s >= 0.12 AND o.speaker <> m.speaker), false) AS heard
  FROM e LEFT JOIN m ON m.clip_id = e.clip_id AND m.role = e.role LEFT JOIN o ON o.clip_id = e.clip_id AND o.id = e.id GROUP BY ALL),
p AS (SELECT clip_id, kind, coalesce(CASE kind WHEN 'single_role' THEN mine >= 12 WHEN 'ordered_roles' THEN heard ELSE spoken <= 30 END, false) AS passed FROM t)
SELECT clip_id, kind, count(*) AS expected, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*)::DOUBLE, 9) AS score FROM p GROUP BY GROUPING SETS ((clip_id, kind), (clip_id))""",
    "adoption": f"""WITH {CLOCK}, p AS (SELECT clip_id * 1000 + seg_ord // 4 AS clip_id, speaker, sum("end" - start) AS s, coalesce(sum("end" - start) FILTER (seg_ord % 2 = 0), 0) AS c FROM clk GROUP BY ALL)
SELECT clip_id, count(*) FILTER (s >= 20) >= 2 AND bool_or(speaker <> 'view' AND c >= 25) AS adopt FROM p GROUP BY 1""",
    "word_cut": """WITH e AS (SELECT vec_id // 50 AS clip_id, vec_id AS i, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
s AS (SELECT clip_id, i, sum(x) OVER (PARTITION BY clip_id, p ORDER BY i) AS a, sum(x) OVER (PARTITION BY clip_id, p) - sum(x) OVER (PARTITION BY clip_id, p ORDER BY i) AS b,
  row_number() OVER (PARTITION BY clip_id, p ORDER BY i) AS r, count(*) OVER (PARTITION BY clip_id, p) AS n FROM e),
c AS (SELECT clip_id, i, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS sim FROM s WHERE r >= 2 AND n - r >= 2 GROUP BY ALL)
SELECT clip_id, arg_min(i, sim) AS cut_after, round(min(sim), 9) AS sim FROM c GROUP BY 1""",
    "log_events": f"WITH {_LOG} SELECT event_id, type, CASE WHEN type <> 'log' THEN s END AS step, CASE type WHEN 'log' THEN 'text ' || event_type WHEN 'step_error' THEN 'it broke' END AS message FROM log",
    "step_durations": f"WITH {_LOG} SELECT run_id, s AS step, event_id, type, duration_ms FROM dur",
    "client_state": f"""WITH {_LOG} SELECT run_id, s AS step, CASE type WHEN 'step_start' THEN 'running' WHEN 'step_done' THEN 'done' ELSE 'failed' END AS state, duration_ms FROM dur
QUALIFY row_number() OVER (PARTITION BY run_id, s ORDER BY ts DESC, event_id DESC) = 1""",
    "replay": "SELECT 'r' || user_id AS run_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20",
    "facets": "SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT lang) AS languages FROM documents",
    "set_operations": """SELECT doc_id, 'both' AS part FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL
SELECT doc_id, 'unlabelled' FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'semi' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "rollup_totals": "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping(lang, source) AS level FROM documents GROUP BY ROLLUP (lang, source)",
    "cube_totals": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "challenge_reasons": f"WITH {CLOCK}" + _merge_sql("clk", "8.0") + """ SELECT clip_id, chunk_ord,
  CASE WHEN "end" - start BETWEEN 4 AND 90 THEN array_to_string(list_filter([CASE WHEN "end" - start >= 40 THEN 'long' END, CASE WHEN source_segment_count > 1 THEN 'merged' END,
    CASE WHEN "end" - start < 40 THEN 'eligible' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM n""",
}

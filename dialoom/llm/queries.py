"""The queries of this subpackage, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fingerprints, html_text, language_id, line_dedup, minhash, mixing, neighbours, periodic, quality, secret_scan, sentencepiece_codec, warc
from .common import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, removed): text without later repeated runs; removed line numbers from 0."""
    docs = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.withColumn("removed", F.array_join("removed", ","))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars)."""
    return html_text.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) on shingles of three words at 85 %."""
    found = minhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position, next_position), range-sorted by position.

    The positions are the training times of the first and second taking, null if there is none; no document is taken a third time.
    """
    mixed = mixing.ordered(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"),
        *[F.round(F.try_element_at("positions", F.lit(i)), 9).alias(name) for i, name in ((1, "position"), (2, "next_position"))],
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, same): the ids of each whole text, and whether they decode to it."""
    return sentencepiece_codec.round_trip(read_table(spark, sf_dir, "documents"), sentencepiece_codec.load())


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    return secret_scan.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)."""
    judged = quality.assess(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from the archives written."""
    return warc.archive_and_read(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url", "html")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles_estimate, edited_contained)."""
    found = fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "n_shingles_estimate", "edited_contained",
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distances to its language's other sources, and its most overused terms."""
    return divergence.audit(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 20 nearest of every row whose id is divisible by 20."""
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of texts with planted tails."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.find_runs(docs.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text"))))
    # Runs are in the order of the ties, so that only a greater exponent takes the place of an earlier one.
    more = lambda best, x: best.isNull() | (x.length * best.period > best.length * x.period)
    best = F.aggregate("runs", F.get("runs", F.size("runs")), lambda best, x: F.when(more(best, x), x).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)), "")
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_language_id, op3_html_extraction, op4_minhash_dedup, op5_source_mixing, op6_sentencepiece,
        op7_secret_scan, op8_quality_rules, op9_warc, op10_fingerprints, op11_source_divergence,
        op12_nearest_vectors, op13_periodic_runs,
    )
}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    # A line goes if a shortest window of 50 words from it or to it, or around it, has an earlier place.
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL
), units AS (
  SELECT doc_id, i, trim(line, {_BLANK}) AS u, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM lines
), placed AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS through, sum(w) OVER (PARTITION BY doc_id ORDER BY i) - w AS before
  FROM units WHERE w > 0
), framed AS (
  SELECT doc_id, i, min(i) OVER onward AS a, max(i) OVER onward AS b, sum(w) OVER onward AS n, list(u) OVER onward AS content
  FROM placed WINDOW onward AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, i, min(i) OVER back, max(i) OVER back, sum(w) OVER back, list(u) OVER back
  FROM placed WINDOW back AS (PARTITION BY doc_id ORDER BY through RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY content ORDER BY doc_id, a) AS r FROM framed WHERE n >= 50
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM ranked WHERE r > 1
), removed AS (
  SELECT DISTINCT doc_id, i FROM gone JOIN placed USING (doc_id, i)
)
SELECT d.doc_id,
  CASE WHEN count(l.i) = 0 THEN any_value(d.text) ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE r.i IS NULL), '') END AS text,
  count(l.i) AS n_lines, count(r.i) AS n_removed, coalesce(string_agg(r.i::VARCHAR, ',' ORDER BY r.i), '') AS removed
FROM documents d LEFT JOIN lines l USING (doc_id) LEFT JOIN removed r ON r.doc_id = l.doc_id AND r.i = l.i
GROUP BY d.doc_id""",
    "op4_minhash_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)
), two AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, t.y FROM reach r JOIN two t ON r.y = t.x),
c AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component AS component_id, c.component = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id""",
    "op5_source_mixing": """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), v AS (
  SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, [0.5, 1.0, 1.5][(place - 1) % 3 + 1]::DOUBLE AS a,
    [1.5, 1.0, 0.5][(place - 1) % 3 + 1]::DOUBLE AS b, 2 * source_size AS cap, 150 * sum(source_size) OVER () / 100.0::DOUBLE AS total FROM s
), lv AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM v
), r AS (
  SELECT *, (SELECT level FROM lv WHERE cap >= level * weight ORDER BY cap / weight, place LIMIT 1) AS reached FROM lv
), t AS (
  SELECT *, CASE WHEN reached IS NULL OR cap < reached * weight THEN cap::DOUBLE ELSE reached * weight END AS target FROM r
), m AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.a, t.b,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::DOUBLE - d.size / 2.0::DOUBLE AS x
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE size * ((x <= target)::BIGINT + (x + source_size <= target)::BIGINT) END::BIGINT AS taken,
  round(CASE WHEN size > 0 AND x <= target THEN
    CASE WHEN a = b THEN x / target ELSE (sqrt(a * a + 2 * (b - a) * (x / target * (a + b) / 2)) - a) / (b - a) END END, 9) AS position,
  round(CASE WHEN size > 0 AND y <= target THEN
    CASE WHEN a = b THEN y / target ELSE (sqrt(a * a + 2 * (b - a) * (y / target * (a + b) / 2)) - a) / (b - a) END END, 9) AS next_position
FROM (SELECT *, x + source_size AS y FROM m)""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), g AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g""",
    "op11_source_divergence": """
WITH w AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), g AS (SELECT DISTINCT lang, source FROM w),
o AS (SELECT lang, source, d, unnest(terms) AS term FROM w),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON k.lang = o.lang AND k.term = o.term GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
s AS (
  SELECT g.lang, g.source, k.term, c.n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.n, 0) + 2 * l.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v))::BIGINT AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM s WHERE n > 0 AND p > q
), z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT * FROM z WHERE part = 'pair' OR rank <= 10""",
}

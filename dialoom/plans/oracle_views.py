"""The views of views.py in SQL, as common table expressions."""

SEG = """seg AS (
  SELECT user_id AS clip_id, event_id AS seg_ord, event_type AS speaker, epoch_us(ts) / 1e6::DOUBLE - 1704067200 AS start,
    epoch_us(ts) / 1e6::DOUBLE - 1704067200 + value AS "end", CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS other FROM events
)"""
CLOCK = SEG + """, clk AS (
  SELECT seg_ord // 1000 AS clip_id, seg_ord % 1000 AS seg_ord, speaker, (seg_ord % 1000) * 30.0::DOUBLE AS start,
    (seg_ord % 1000) * 30.0::DOUBLE + 1.0::DOUBLE + (floor(("end" - start) * 8)::BIGINT % 512) / 8.0::DOUBLE AS "end", 'm' || other AS other FROM seg
)"""
CHUNKS = """chunks AS (
  SELECT *, "end" - duration AS start, printf('chunk_%04d', chunk_ord) AS chunk_id FROM (
    SELECT conv_id AS clip_id, turn AS chunk_ord, role AS speaker, text AS text_src, greatest(length(text), 1) / 16.0::DOUBLE AS duration,
      sum(greatest(length(text), 1) / 16.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn) AS "end" FROM conversations)
)"""
EMB = """emb AS (
  SELECT vec_id AS chunk_ord, printf('S%02d', label) AS speaker, embedding::DOUBLE[] AS embedding FROM embeddings
), parts AS (
  SELECT chunk_ord, speaker, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM emb
), total AS (
  SELECT speaker, list(x ORDER BY pos) AS total, max(n) AS n FROM (SELECT speaker, pos, sum(x) AS x, count(*) AS n FROM parts GROUP BY ALL) GROUP BY speaker
)"""
COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
RUNS = """runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS input_stem, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
    epoch_us(o_orderdate::TIMESTAMP) / 1e6::DOUBLE AS created_at FROM orders
)"""
STEPS = """steps AS (
  SELECT l_orderkey AS run_id, l_linenumber AS ord, 'step' || l_linenumber AS name,
    CASE WHEN max(l_returnflag) = 'R' THEN 'failed' WHEN max(l_linestatus) = 'F' THEN 'done' WHEN max(l_returnflag) = 'A' THEN 'skipped' ELSE 'pending' END AS state,
    epoch_us(min(l_shipdate)::TIMESTAMP) / 1e6::DOUBLE AS started_at, epoch_us(min(l_shipdate)::TIMESTAMP) / 1e6::DOUBLE + max(l_quantity) AS ended_at
  FROM lineitem GROUP BY l_orderkey, l_linenumber
)"""
NORM = "trim(regexp_replace(coalesce({t}, ''), '\\s+', ' ', 'g'))"


def norm(text: str) -> str:
    return NORM.format(t=text)


def cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b)

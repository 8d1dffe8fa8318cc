"""Queries of the readers and writers: a test table is written in a format, read back, and compared with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table_path
from ..sources import tables
from . import views
from .oracle_views import CLOCK

_DOCUMENT = T.StructType().add("doc_id", "long").add("lang", "string").add("source", "string").add("n_chars", "long")
_NATION = T.StructType().add("n_nationkey", "long").add("n_name", "string")


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "json-lines")
    tables.write_json(views.table(spark, sf_dir, "documents").select(*_DOCUMENT.names), path)
    return tables.read_json(spark, path, _DOCUMENT, lines=True)


def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with a list for each region; entries that are no objects are dropped."""
    path = table_path(spark, "json-lists")
    nations = views.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.struct(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").alias("n"))
    lists = nations.groupBy("region").agg(F.to_json(F.collect_list("n")).alias("value"))
    lists.select("region", F.concat(F.lit("﻿"), "value").alias("value")).write.partitionBy("region").text(path)
    return tables.read_json(spark, path, _NATION).select("n_nationkey", "n_name")


def optional_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path that is not there next to one that is."""
    path = table_path(spark, "optional")
    tables.write_json(views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name"), path)
    there, missing = (tables.read_json_or_empty(spark, p, _NATION, lines=True) for p in (path, table_path(spark, "missing")))
    return there.unionByName(missing)


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended as events in two goes; texts are cut at the log's 240 characters, as the reference does."""
    path = table_path(spark, "activity")
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    for rest in (0, 1):
        tables.write_activity(docs.filter(F.col("doc_id") % 2 == rest), path)
    return tables.read_json(spark, path, T.StructType().add("doc_id", "long").add("text", "string").add("source", "string"), lines=True)


def _rttm(spark: SparkSession, sf_dir: str) -> str:
    path = table_path(spark, "rttm")
    rows = views.on_one_clock(spark, sf_dir)
    tables.write_rttm(rows, path, F.concat(F.lit("clip"), F.col("clip_id").cast("string")))
    return path


def rttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.diarization_records(spark, rttm_path=_rttm(spark, sf_dir))
    return rows.select("file_id", "speaker", "start", "end")


def rttm_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of at least 20 s only."""
    return tables.read_rttm(spark, _rttm(spark, sf_dir), least=20.0).select("file_id", "speaker", "start", "duration")


def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments from JSON: lists, objects with segments and objects with groups, a file for each clip."""
    path = table_path(spark, "segments")
    rows = views.on_one_clock(spark, sf_dir).select("clip_id", "seg_ord", F.struct("speaker", "start", "end").alias("s"), F.struct("speaker", F.col("start").alias("group_start"), F.col("end").alias("group_end")).alias("g"))
    lists = rows.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", "s"))), lambda x: x.s).alias("s"), F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", "g"))), lambda x: x.g).alias("g"))
    kind = F.col("clip_id") % 3
    text = F.when(kind == 0, F.to_json("s")).when(kind == 1, F.to_json(F.struct(F.col("s").alias("segments")))).otherwise(F.to_json(F.struct(F.col("g").alias("groups"))))
    lists.select("clip_id", text.alias("value")).withColumnRenamed("clip_id", "clip").write.partitionBy("clip").text(path)
    return tables.diarization_records(spark, json_path=path).select("seg_ord", "speaker", "start", "end")


def word_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "words")
    rows = views.on_one_clock(spark, sf_dir).select("clip_id", "seg_ord", F.struct(F.concat(F.lit(" "), "other").alias("word"), "start", "end").alias("w"), F.struct(F.col("other").alias("text"), "start", "end").alias("t"))
    lists = rows.groupBy("clip_id").agg(F.collect_list("w").alias("w"), F.collect_list("t").alias("t"))
    text = F.when(F.col("clip_id") % 2 == 0, F.to_json("w")).otherwise(F.to_json(F.struct(F.col("t").alias("words"))))
    lists.select(F.col("clip_id").alias("clip"), text.alias("value")).write.partitionBy("clip").text(path)
    return tables.read_words(spark, path).select("word", "start", "end")


def summary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "summary")
    rows = views.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.struct(F.col("s_nationkey").cast("int").alias("nation")).alias("parameters"))
    tables.write_summary_csv(rows, path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "parameters")


def preferred_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(F.lit("_final"), F.lit("_draft"), F.lit("_raw"), F.lit("")), (F.col("doc_id") * 7 % 4 + 1).cast("int"))
    files = views.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("clip_id"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), mark, F.lit(".json")).alias("path"))
    return tables.preferred_files(files, ["_final", "_draft", ""])


def report_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = views.table(spark, sf_dir, "documents").select(F.concat(F.lit("report"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("report"), F.array("source", "lang").alias("chunks"))
    return tables.report_of(reports, "src3").select("report", F.array_join("chunks", ",", "-").alias("chunks"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "lang").alias("lang"), "source")
    return tables.manifest(items, {"lang": "any", "kind": "text"})


def artifact_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their listing: a file for each nation, of the length of its name and a line end."""
    path = table_path(spark, "artifacts")
    views.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = tables.artifacts(spark, path, ["TXT"])
    return found.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("nation"), "length")


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "log")
    lines = views.table(spark, sf_dir, "region").select(F.explode(F.sequence(F.lit(1), F.lit(40))).alias("i"), "r_name", "r_regionkey")
    # A log is one file by nature; this one has 200 lines.
    lines.orderBy("i", "r_regionkey").coalesce(1).select(F.concat_ws(" ", F.col("i").cast("string"), "r_name").alias("value")).write.text(path)
    return tables.log_tail(spark, path, 12).select("value")


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object a file; a file that does not parse is skipped."""
    path = table_path(spark, "runs")
    nations = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.to_json(F.struct(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")).alias("value"))
    broken = nations.withColumn("value", F.when(F.col("k") % 6 == 5, F.concat(F.lit("{"), "value")).otherwise(F.col("value")))
    broken.repartition("k").write.partitionBy("k").text(path)
    return tables.read_runs(spark, path, _NATION).select("n_nationkey", "n_name")


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "# settings\nA=1\nexport B = 'two words'\n\nC=\"x=y\"\nno setting\nD="
    return spark.createDataFrame(sorted(tables.read_environment(text).items()), "name string, value string")


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    name = F.concat(F.lit(" ."), F.col("p_name"), F.lit("/"), F.col("p_brand"), F.lit("? "))
    template = F.lit("{a}/{b}.{c}.json")
    return p.select(
        "p_partkey", tables.safe_path_part(name).alias("safe"), tables.clip_name(F.concat(F.lit("/x/y.z/"), F.col("p_brand"), F.lit(".tar.gz"))).alias("clip"),
        tables.expanded(template, {"a": F.col("p_partkey"), "b": F.col("p_brand")}).alias("path"),
    )


QUERIES = {f"source_{f.__name__}": f for f in (
    json_lines, json_lists, optional_table, activity_log, rttm, rttm_long, segment_documents, word_documents, summary_csv, preferred_files, report_of, manifest,
    artifact_list, log_tail, run_records, environment, path_parts,
)}

ORACLE_SQL = {
    "source_json_lines": "SELECT doc_id, lang, source, n_chars FROM documents",
    "source_json_lists": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation",
    "source_optional_table": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation",
    "source_activity_log": "SELECT doc_id, left(text, 240) AS text, source FROM documents",
    "source_rttm": f"""WITH {CLOCK} SELECT 'clip' || clip_id AS file_id, speaker, start, "end" FROM clk""",
    "source_rttm_long": f"""WITH {CLOCK} SELECT 'clip' || clip_id AS file_id, speaker, start, "end" - start AS duration FROM clk WHERE "end" - start >= 20""",
    "source_segment_documents": f"""WITH {CLOCK} SELECT seg_ord, speaker, start, "end" FROM clk""",
    "source_word_documents": f"""WITH {CLOCK} SELECT other AS word, start, "end" FROM clk""",
    "source_summary_csv": """SELECT s_suppkey::BIGINT AS s_suppkey, s_name, '{"nation":' || s_nationkey || '}' AS parameters FROM supplier""",
    "source_preferred_files": """SELECT doc_id // 3 AS clip_id, '/d/' || doc_id || ['_final', '_draft', '_raw', ''][doc_id * 7 % 4 + 1] || '.json' AS path FROM documents
QUALIFY row_number() OVER (PARTITION BY doc_id // 3 ORDER BY [0, 1, 2, 2][doc_id * 7 % 4 + 1], path) = 1""",
    "source_report_of": "SELECT 'report' || lpad(doc_id::VARCHAR, 9, '0') AS report, coalesce(source, '-') || ',' || coalesce(lang, '-') AS chunks FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 1",
    "source_manifest": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'lang' ELSE 'any' END AS lang, source, 'text' AS kind FROM documents",
    "source_artifact_list": "SELECT n_nationkey::INT AS nation, strlen(n_name)::BIGINT + 1 AS length FROM nation",
    "source_log_tail": "SELECT i || ' ' || r_name AS value FROM (SELECT unnest(range(1, 41)) AS i, r_name, r_regionkey FROM region) ORDER BY i DESC, r_regionkey DESC LIMIT 12",
    "source_run_records": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_nationkey % 6 <> 5",
    "source_environment": "SELECT * FROM (VALUES ('A', '1'), ('B', 'two words'), ('C', 'x=y'), ('D', '')) t(name, value)",
    "source_path_parts": """SELECT p_partkey, regexp_replace(regexp_replace(' .' || p_name || '/' || p_brand || '? ', '[^\\w.-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS safe,
  p_brand || '.tar' AS clip, p_partkey || '/' || p_brand || '.{c}.json' AS path FROM part""",
}

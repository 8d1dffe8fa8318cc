"""Readers and writers of the tables: JSON lists, JSON lines, RTTM, words, manifests, logs, artifacts.

Readers are lenient: a row that does not fit is dropped, a missing path gives an empty table. Fields are cast with try_cast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.segments import lenient

_BAD = "_corrupt_record"


def read_json(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, lines: bool = False) -> DataFrame:
    """Rows of JSON lists (a file each) or of JSON lines; entries that are no objects of this shape are dropped. BOMs are fine."""
    shape = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    rows = spark.read.schema(shape).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).json(path)
    # A file path column keeps Spark from answering from the corrupt-record column alone.
    whole = F.coalesce(*[F.col(f.name).cast("string") for f in schema.fields]).isNotNull()
    return rows.withColumn("_f", F.col("_metadata.file_path")).filter(F.col(_BAD).isNull() & whole).drop(_BAD, "_f")


def read_json_or_empty(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """As read_json; empty if there is no such path."""
    try:
        return read_json(spark, path, schema, lines)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines without null fields; files appear only when the write is whole (Spark's committer)."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_activity(events: DataFrame, path: str, longest: int = 240) -> None:
    """Appends events; strings are cut at 240 characters, nulls left out."""
    cut = [F.substring(c, 1, longest).alias(c) if t == "string" else F.col(c) for c, t in events.dtypes]
    write_json(events.select(*cut), path, append=True)


def clip_name(path: Column) -> Column:
    """The file's name without folders and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def parse_rttm(lines: DataFrame, value: str = "value") -> DataFrame:
    """(file_id, speaker, start, end, duration) of RTTM lines; comments, other records and lines with under 8 fields are dropped."""
    fields = F.split(F.trim(F.col(value)), r"\s+")
    at = lambda i: F.get(fields, F.lit(i))
    number = lambda i: F.expr(f"try_cast(get(split(trim({value}), '\\\\s+'), {i}) AS DOUBLE)")
    kept = lines.filter((F.size(fields) >= 8) & (at(0) == "SPEAKER") & ~F.startswith(F.trim(F.col(value)), F.lit("#")))
    rows = kept.select(*[c for c in lines.columns if c != value], at(1).alias("file_id"), at(7).alias("speaker"), number(3).alias("start"), number(4).alias("duration"))
    return rows.withColumn("end", F.col("start") + F.col("duration")).filter("start IS NOT NULL AND duration IS NOT NULL")


def read_rttm(spark: SparkSession, path: str | Sequence[str], least: float = 0.0, places: int = 3) -> DataFrame:
    """Segments (clip_id, seg_ord, speaker, start, end, duration) of at least ``least`` seconds; seg_ord numbers a clip's lines by time."""
    lines = spark.read.text(path).withColumn("clip_id", clip_name(F.col("_metadata.file_path")))
    rows = lenient(parse_rttm(lines), places).filter(F.col("duration") >= least)
    order = Window.partitionBy("clip_id").orderBy("start", "end", "speaker")
    return rows.withColumn("seg_ord", (F.row_number().over(order) - 1).cast("long"))


def rttm_lines(rows: DataFrame, file_id: Column) -> DataFrame:
    """RTTM lines in time order."""
    text = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", file_id, F.col("start"), F.col("end") - F.col("start"), F.col("speaker"))
    return rows.orderBy("start", "seg_ord").select(text.alias("value"))


def write_rttm(rows: DataFrame, path: str, file_id: Column) -> None:
    rttm_lines(rows, file_id).write.mode("overwrite").text(path)


_JSON_SEGMENT = "struct<speaker:string,start:string,end:string>"
_GROUP = "struct<speaker:string,group_start:string,group_end:string,start:string,end:string>"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments from .rttm, from a JSON list, or from an object with ``segments`` or ``groups`` (group_start, group_end)."""
    if path.lower().endswith(".rttm"):
        return read_rttm(spark, path)
    whole = spark.read.text(path, wholetext=True).withColumn("clip_id", clip_name(F.col("_metadata.file_path")))
    body = F.regexp_replace("value", "^﻿", "")
    as_list = F.from_json(body, f"array<{_JSON_SEGMENT}>")
    as_object = F.from_json(body, f"struct<segments:array<{_GROUP}>,groups:array<{_GROUP}>>")
    listed = whole.filter(F.ltrim(body).startswith("[")).select("clip_id", F.posexplode(as_list).alias("seg_ord", "s")).select("clip_id", "seg_ord", "s.*")
    inner = F.coalesce(as_object.groups, as_object.segments)
    grouped = whole.filter(~F.ltrim(body).startswith("[")).select("clip_id", F.posexplode(inner).alias("seg_ord", "s")).select(
        "clip_id", "seg_ord", "s.speaker", F.coalesce("s.group_start", "s.start").alias("start"), F.coalesce("s.group_end", "s.end").alias("end"))
    return lenient(listed.unionByName(grouped).withColumn("seg_ord", F.col("seg_ord").cast("long")).filter("speaker IS NOT NULL"))


def diarization_records(spark: SparkSession, *, json_path: str | None = None, rttm_path: str | None = None) -> DataFrame:
    """Exactly one of the two."""
    if (json_path is None) == (rttm_path is None):
        raise ValueError("give either json_path or rttm_path")
    return read_segments(spark, json_path) if json_path else read_rttm(spark, rttm_path)


_WORD = "array<struct<word:string,text:string,start:string,end:string>>"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, word_ord, word, start, end) from a list, or an object with ``words`` or ``segments``; ``text`` stands for ``word``."""
    whole = spark.read.text(path, wholetext=True).withColumn("clip_id", clip_name(F.col("_metadata.file_path")))
    body = F.regexp_replace("value", "^﻿", "")
    nested = F.from_json(body, f"struct<words:{_WORD},segments:{_WORD}>")
    items = F.when(F.ltrim(body).startswith("["), F.from_json(body, _WORD)).otherwise(F.coalesce(nested.words, nested.segments))
    rows = whole.select("clip_id", F.posexplode(items).alias("_p", "w")).select("clip_id", "_p", F.trim(F.coalesce("w.word", "w.text")).alias("word"), "w.start", "w.end")
    kept = lenient(rows.filter("word <> ''"))
    order = Window.partitionBy("clip_id").orderBy("start", "_p")
    return kept.withColumn("word_ord", F.row_number().over(order).cast("long")).select("clip_id", "word_ord", "word", "start", "end")


def preferred_files(files: DataFrame, ranks: Sequence[str], by: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Of each clip's files (path) the first whose name has the earliest of the given marks; the last mark may be ''."""
    rank = F.coalesce(*[F.when(F.contains("path", F.lit(m)), F.lit(i)) for i, m in enumerate(ranks)])
    w = Window.partitionBy(*by).orderBy("_rank", "path")
    return files.withColumn("_rank", rank).filter("_rank IS NOT NULL").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_rank", "_r")


def report_of(reports: DataFrame, name: str) -> DataFrame:
    """The first report (report, chunks array<string>) that lists the chunk."""
    return reports.filter(F.array_contains("chunks", name)).orderBy("report").limit(1)


def manifest(items: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Manifest items with missing fields from the defaults."""
    for name, value in defaults.items():
        items = items.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in items.columns else F.lit(value))
    return items


def write_summary_csv(rows: DataFrame, path: str, parameters: str = "parameters") -> None:
    """CSV with a header; the parameters struct or map as JSON text."""
    flat = rows.withColumn(parameters, F.to_json(parameters)) if parameters in rows.columns else rows
    flat.write.mode("overwrite").option("header", True).csv(path)


def artifacts(spark: SparkSession, path: str, extensions: Sequence[str] = ()) -> DataFrame:
    """(path, length, modified) of files, by their listing alone."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    return listed.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions])) if extensions else listed


def log_tail(spark: SparkSession, path: str, lines: int, most: int = 2000) -> DataFrame:
    """(number, value) of a log's last lines, at most 2000, in order. Line numbers follow the file's blocks."""
    numbered = spark.read.text(path).withColumn("number", F.monotonically_increasing_id())
    return numbered.orderBy(F.desc("number")).limit(max(1, min(most, lines))).orderBy("number").select("number", "value")


def read_environment(text: str) -> dict[str, str]:
    """KEY=VALUE lines of a small settings file: comments and blank lines skipped, ``export`` and quotes removed."""
    found = {}
    for line in text.splitlines():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and not name.startswith("#"):
            value = value.strip()
            found[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return found


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Run records, a JSON object a file, newest file first; files that do not parse are skipped."""
    shape = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    rows = spark.read.schema(shape).option("multiLine", True).option("columnNameOfCorruptRecord", _BAD).json(path)
    rows = rows.withColumn("modified", F.col("_metadata.file_modification_time")).filter(F.col(_BAD).isNull() & F.col(schema.fields[0].name).isNotNull())
    return rows.drop(_BAD).orderBy(F.desc("modified"), schema.fields[0].name)


def safe_path_part(name: Column) -> Column:
    """A file name part: all but letters, digits, dot, dash and underscore become underscores, none at the ends."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\w.-]+", "_"), r"^[_.]+|[_.]+$", ""), F.lit("")), F.lit("item"))


def expanded(template: Column, values: dict[str, Column]) -> Column:
    """A template with each {name} replaced by its value."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template

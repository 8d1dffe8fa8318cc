"""The driver's test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = 1704067200  # 2024-01-01 in UTC, where the events begin
ROLES = ("m0", "m1", "m2")  # the labels of on_one_clock's second labelling


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as labelled intervals of clips: (clip_id, seg_ord, speaker, start, end)."""
    e = table(spark, sf_dir, "events")
    # Whole microseconds, so that every engine gets the same number.
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - EPOCH
    return e.select(
        F.col("user_id").alias("clip_id"), F.col("event_id").alias("seg_ord"), F.col("event_type").alias("speaker"), start.alias("start"),
        (start + F.col("value")).alias("end"), (F.get_json_object("props", "$.k").cast("long") % 3).alias("other"),
    )


def on_one_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, as clips of 1,000 events each on one clock of 30 s an event: neighbours overlap and follow each other closely."""
    s = segments(spark, sf_dir)
    place = F.col("seg_ord") % 1000
    start = place * 30.0
    return s.select(
        F.floor(F.col("seg_ord") / 1000).alias("clip_id"), place.alias("seg_ord"), "speaker", start.alias("start"),
        (start + F.lit(1.0) + F.floor((F.col("end") - F.col("start")) * 8) % 512 / 8.0).alias("end"), F.concat(F.lit("m"), F.col("other").cast("string")).alias("other"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as chunks of speech: 12 characters a second, one after another."""
    c = table(spark, sf_dir, "conversations")
    duration = F.greatest(F.length("text"), F.lit(1)) / F.lit(16.0)
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = c.select(F.col("conv_id").alias("clip_id"), F.col("turn").alias("chunk_ord"), F.col("role").alias("speaker"), F.col("text").alias("text_src"), duration.alias("duration"), "conv_id", "turn")
    out = out.withColumn("end", F.sum("duration").over(w)).withColumn("start", F.col("end") - F.col("duration"))
    return out.withColumn("chunk_id", F.format_string("chunk_%04d", F.col("chunk_ord"))).drop("conv_id", "turn")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_ord"), F.format_string("S%02d", F.col("label")).alias("speaker"), F.col("embedding").cast("array<double>").alias("embedding"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as runs: F is success, P failed, O running."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    created = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1e6)
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("input_stem"), status.alias("status"), created.alias("created_at"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as steps: an order's distinct line numbers, each with its widest values."""
    # Dealt by order first: nearly all rows are groups of their own, so a scan's task would only sort its whole split to merge few of them.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity").repartition("l_orderkey")
    l = lines.groupBy("l_orderkey", "l_linenumber").agg(  # noqa: E741
        F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("line"), F.min("l_shipdate").alias("d"), F.max("l_quantity").alias("q"))
    state = F.when(F.col("flag") == "R", "failed").when(F.col("line") == "F", "done").when(F.col("flag") == "A", "skipped").otherwise("pending")
    start = F.unix_micros(F.col("d").cast("timestamp")) / F.lit(1e6)
    return l.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("step"), F.col("l_linenumber").cast("string")).alias("name"),
        state.alias("state"), start.alias("started_at"), (start + F.col("q")).alias("ended_at"),
    )

"""Progress of runs from their log lines: parsing, durations by state, newest events, client state. Batch and stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

# How steps announce themselves in a log line.
START = r"Starting step:\s+([a-z_]+)\s*$"
DONE = r"Completed step:\s+([a-z_]+)\s*$"
FAIL = r"Step failed:\s+([a-z_]+)\s*\|\s*(.*)$"
REPLAY = 5000


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Log lines -> ``type`` (step_start, step_done, step_error, log), ``step`` (null for log) and ``message``."""
    name = lambda p: F.nullif(F.regexp_extract(value, p, 1), F.lit(""))
    start, done, fail = name(START), name(DONE), name(FAIL)
    kind = F.when(start.isNotNull(), "step_start").when(done.isNotNull(), "step_done").when(fail.isNotNull(), "step_error").otherwise("log")
    message = F.when(fail.isNotNull(), F.regexp_extract(value, FAIL, 2)).when(start.isNull() & done.isNull(), F.col(value))
    return lines.withColumn("type", kind).withColumn("step", F.coalesce(start, done, fail)).withColumn("message", message)


def durations(events: DataFrame) -> DataFrame:
    """Batch: events (run_id, ts, type, step) with ``duration_ms``: of a step's end since its last start, 0 if no start was seen."""
    w = Window.partitionBy("run_id", "step").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("type").isin("step_start", "step_done", "step_error"), F.struct("type", "ts")), ignorenulls=True).over(w)
    ended = F.col("type").isin("step_done", "step_error")
    begun = F.when(last.getField("type") == "step_start", last.getField("ts"))
    return events.withColumn("duration_ms", F.when(ended, F.coalesce(F.bround((F.col("ts") - begun) * 1000).cast("long"), F.lit(0))))


_OUT = "run_id string, step string, type string, ts double, event_id long, duration_ms long"


def stream_durations(events: DataFrame) -> DataFrame:
    """Stream: step events with their duration. State is the start time of each (run, step), gone when the step ends; arrival order counts."""
    ship(events.sparkSession)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun = state.get[0] if state.exists else None
        out = []
        for batch in batches:
            for row in batch.sort_values(["ts", "event_id"]).itertuples():
                spent = None
                if row.type == "step_start":
                    begun = row.ts
                elif row.type in ("step_done", "step_error"):
                    spent = 0 if begun is None else round((row.ts - begun) * 1000)
                    begun = None
                out.append((key[0], key[1], row.type, row.ts, row.event_id, spent))
        if begun is None:
            if state.exists:
                state.remove()
        else:
            state.update((begun,))
        yield pd.DataFrame(out, columns=["run_id", "step", "type", "ts", "event_id", "duration_ms"]).astype({"duration_ms": "Int64"})

    steps = events.filter("step IS NOT NULL").select("run_id", "step", "type", "ts", "event_id")
    return steps.groupBy("run_id", "step").applyInPandasWithState(advance, _OUT, "begun double", "append", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame, n: int = REPLAY) -> DataFrame:
    """What a new subscriber gets: the newest n events of each run that came after its last run_done (which clears)."""
    w = Window.partitionBy("run_id")
    cleared = F.max(F.when(F.col("type") == "run_done", F.col("event_id"))).over(w)
    kept = events.withColumn("_c", cleared).filter("_c IS NULL OR event_id > _c").drop("_c")
    ranked = kept.withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("event_id"))))
    return ranked.filter(F.col("_r") <= n).drop("_r")


def client_state(events: DataFrame) -> DataFrame:
    """(run_id, step, state, ts, duration_ms): the newest step event of each step as its state."""
    steps = events.filter(F.col("type").isin("step_start", "step_done", "step_error"))
    newest = steps.groupBy("run_id", "step").agg(F.max(F.struct("ts", "event_id", "type", "duration_ms")).alias("m"))
    state = F.when(F.col("m.type") == "step_start", "running").when(F.col("m.type") == "step_done", "done").otherwise("failed")
    return newest.select("run_id", "step", state.alias("state"), F.col("m.ts").alias("ts"), F.col("m.duration_ms").alias("duration_ms"))


def push(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Starts a query that hands each micro-batch to ``send``; the checkpoint makes it continue after a loss."""
    writer = events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


_BEAT = "run_id string, beat int"


def heartbeats(events: DataFrame, seconds: float = 15.0) -> DataFrame:
    """Stream of (run_id, type) -> (run_id, beat): a row for each ``seconds`` in which a run that goes on said nothing, numbered from 1.

    A timer of processing time for each run: any event sets it anew, run_done ends it. Start the query with a trigger shorter than that.
    """
    ship(events.sparkSession)
    pause = round(1000 * seconds)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        beat = state.get[0] if state.exists else 0
        out = []
        if state.hasTimedOut:
            beat += 1
            out.append((key[0], beat))
            ended = False
        else:
            ended = any((batch.type == "run_done").any() for batch in batches)
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update((beat,))
            state.setTimeoutDuration(pause)
        yield pd.DataFrame(out, columns=["run_id", "beat"])

    said = events.select("run_id", "type")
    return said.groupBy("run_id").applyInPandasWithState(advance, _BEAT, "beat int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts in event-time windows, batch or stream; a stream drops rows of windows that the watermark, ``late`` behind, has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("window_start"), *by, "events")


def session_counts(events: DataFrame, time: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Sessions that end after ``gap`` without an event, batch or stream (append mode only, as a session comes out when it is closed)."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "events")


def drained(counts: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream of counts over all that its source holds now and returns what came out, with the ``batch`` it came in.

    The checkpoint and the output are in folder, which all executors share: a later call goes on where this one ended. A batch that is
    run again after a loss overwrites its own output.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = counts.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    shape = T.StructType([*counts.schema.fields, T.StructField("batch", T.IntegerType())])
    return counts.sparkSession.read.schema(shape).parquet(f"{folder}/out")


def last_counts(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key of an update-mode stream."""
    return emitted.groupBy(*keys).agg(F.max_by("events", "batch").alias("events"))


def late_counts(events: DataFrame, counted: DataFrame, by: list[str]) -> DataFrame:
    """(by, arrived, late): rows of each key that came, and how many of them no window has counted."""
    kept = counted.groupBy(*by).agg(F.sum("events").alias("kept"))
    return events.groupBy(*by).agg(F.count("*").alias("arrived")).join(kept, by, "left").select(
        *by, "arrived", (F.col("arrived") - F.coalesce("kept", F.lit(0))).alias("late"))

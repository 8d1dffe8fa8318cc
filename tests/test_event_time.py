"""Event time in streams: late rows, sessions, restarts, heartbeats."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dialoom.streaming import progress

EVENTS = "id long, kind string, ts timestamp"
ZERO = datetime(2024, 1, 1)
#: Batches of (kind, minute); the engine drops by the watermark of the batch before: 10 minutes behind the latest row until then.
BATCHES = [[("a", 0), ("b", 3), ("a", 4)], [("a", 30), ("b", 33)], [("a", 31), ("b", 60)], [("a", 2), ("b", 3), ("a", 24), ("a", 61)], [("a", 300), ("b", 49)]]


def put(spark, folder, batches):
    for i, batch in enumerate(batches):
        rows = [(10 * i + k, kind, ZERO + timedelta(minutes=m)) for k, (kind, m) in enumerate(batch)]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)


def stream(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def kept(width):
    """(batch, kind, minute) of the rows that are in time: of batch k, those whose window ends after the mark of the batches before k - 1."""
    out, batches = [], [*BATCHES[:3], [], *BATCHES[3:]]  # a call that has read all ends with an empty batch
    for k, batch in enumerate(batches):
        before = [m for b in batches[: max(0, k - 1)] for _, m in b]
        mark = max(before) - 10 if before else -(10**9)
        out += [(kind, m) for kind, m in batch if width(m) > mark]
    return out


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put(spark, source, BATCHES[:3])
    counts = lambda: progress.windowed_counts(stream(spark, source), "ts", "10 minutes", "10 minutes", ["kind"])
    progress.drained(counts(), out, "update")
    put(spark, source, BATCHES[3:])  # the second call goes on from the first one's state
    emitted = progress.drained(counts(), out, "update")
    got = progress.last_counts(emitted, ["window_start", "kind"])
    want = {}
    for kind, m in kept(lambda m: m // 10 * 10 + 10):
        want[kind, m // 10 * 10] = want.get((kind, m // 10 * 10), 0) + 1
    assert {(r.kind, int((r.window_start - ZERO).total_seconds() // 60)): r.events for r in got.collect()} == want
    late = {r.kind: (r.arrived, r.late) for r in progress.late_counts(spark.read.schema(EVENTS).parquet(source), got, ["kind"]).collect()}
    total = sum(map(len, BATCHES))
    assert sum(a for a, _ in late.values()) == total and sum(b for _, b in late.values()) == total - len(kept(lambda m: m // 10 * 10 + 10)) > 0


def test_sessions_of_a_stream_equal_the_batch(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put(spark, source, [[("a", 0), ("b", 3), ("a", 4)], [("a", 7), ("b", 33)], [("a", 31), ("b", 36)], [("z", 10_000)], [("z", 20_000)]])
    emitted = progress.drained(progress.session_counts(stream(spark, source), "ts", "5 minutes", "10 minutes", ["kind"]), out, "append")
    batch = progress.session_counts(spark.read.schema(EVENTS).parquet(source), "ts", "5 minutes", "10 minutes", ["kind"])
    rows = lambda df: sorted(tuple(r) for r in df.filter("kind <> 'z'").select("kind", "session_start", "session_end", "events").collect())
    assert rows(emitted) == rows(batch) and len(rows(batch)) == 4


def test_heartbeats_while_a_run_goes_on(spark, tmp_path):
    source, seen = f"file://{tmp_path}/in", []
    say = lambda *rows: spark.createDataFrame(rows, "run_id string, type string").coalesce(1).write.mode("append").parquet(source)
    say(("r", "step_start"), ("s", "step_start"))
    beats = progress.heartbeats(spark.readStream.schema("run_id string, type string").parquet(source), seconds=1.0)
    query = beats.writeStream.foreachBatch(lambda df, _: seen.extend((r.run_id, r.beat) for r in df.collect())).option("checkpointLocation", f"file://{tmp_path}/check").trigger(processingTime="200 milliseconds").start()
    wait = lambda condition: any(condition() or time.sleep(0.2) for _ in range(300))
    try:
        assert wait(lambda: {("r", 2), ("s", 2)} <= set(seen)), seen
        say(("s", "run_done"))
        wait(lambda: query.lastProgress is not None and sum(p.numInputRows for p in query.recentProgress) >= 3)
        of = lambda run: [b for r, b in seen if r == run]
        ended, going = len(of("s")), len(of("r"))
        assert wait(lambda: len(of("r")) >= going + 2) and len(of("s")) <= ended + 1
        assert of("r") == list(range(1, len(of("r")) + 1))
    finally:
        query.stop()


def test_windows_of_a_batch(spark):
    rows = spark.createDataFrame([(1, "a", ZERO), (2, "a", ZERO + timedelta(minutes=9)), (3, "b", ZERO + timedelta(minutes=10))], EVENTS)
    got = progress.windowed_counts(rows, "ts", "10 minutes", "1 minute", ["kind"]).select(F.minute("window_start").alias("m"), "kind", "events").collect()
    assert sorted(tuple(r) for r in got) == [(0, "a", 2), (10, "b", 1)]

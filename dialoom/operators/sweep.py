"""Parameter sweeps as resumable Spark jobs: every item with every trial is a cell, computed once, whatever is lost on the way.

Cells are computed in waves of trials. A wave is one job: the items' rows meet the wave's trials, each cell goes to a task as one
group, and its report is appended to a table in the results folder when the job commits. What a killed sweep has committed stays. A
later call reads the table, takes finished cells out by an anti-join and computes the rest: cells that failed before are tried
again, as their next attempt. A cell whose work raises is recorded as failed with its message and stops no other.

Items may be many; a cell holds one item's rows, and these are copied for each trial of a wave, so the trials of a wave are few.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from itertools import product

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

Work = Callable[[dict[str, float], pd.DataFrame], Mapping[str, object]]
MOST_MESSAGE = 500


def grid_trials(values: Mapping[str, Sequence[float]], fixed: Mapping[str, float] | None = None) -> list[dict[str, float]]:
    """The parameters of each combination, in the order of the lists."""
    return [{**(fixed or {}), **dict(zip(values, chosen, strict=True))} for chosen in product(*values.values())]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the results folder; none where nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def run_sweep(
    rows: DataFrame, item: str, trials: Sequence[Mapping[str, float]], work: Work, report: str, path: str, resume: bool = False,
    trials_per_wave: int = 4, waves: int | None = None,
) -> DataFrame:
    """(item, trial, attempt, status, seconds, error, report columns): a row for each cell, by trial numbers from 1.

    rows: the items' rows, with their id in column ``item``. work: a trial's parameters and an item's rows -> the values of report
    (DDL). path: the results folder, shared by all executors; results there without ``resume`` are an error. status: done or
    failed; skipped where an earlier call had finished the cell, whose report is returned. waves: compute no more than so many now.
    """
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema[item].dataType.simpleString()
    schema = f"item {kind}, trial int, attempt int, status string, seconds double, error string, {report}"
    names = spark.createDataFrame([], report).columns
    earlier = _read(spark, path, schema)
    if not resume and not earlier.isEmpty():
        raise FileExistsError(f"{path} has results; resume the sweep or choose another folder")
    before = earlier.groupBy("item", "trial").agg(F.max("attempt").alias("last"), F.bool_or(F.col("status") == "done").alias("finished"))
    known = {r.trial: r for r in before.groupBy("trial").agg(F.max("last").alias("last")).collect()}  # a row for each trial
    started_at = max([r.last for r in known.values()], default=0)  # attempts of this call are numbered beyond
    items = rows.select(F.col(item).alias("item")).distinct()

    def cell(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        number, began, found, error = int(key[1]), time.perf_counter(), {}, None
        try:
            found = dict(work(dict(trials[number - 1]), group.drop(columns=["trial"])))
        except Exception as e:  # recorded: a cell must not stop the others
            error = f"{type(e).__name__}: {e}"[:MOST_MESSAGE]
        row = [key[0], number, started_at + 1, "failed" if error else "done", round(time.perf_counter() - began, 6), error]
        return pd.DataFrame([[*row, *[found.get(n) for n in names]]], columns=["item", "trial", "attempt", "status", "seconds", "error", *names])

    numbers = list(range(1, len(trials) + 1))
    for wave in [numbers[i : i + trials_per_wave] for i in range(0, len(numbers), trials_per_wave)][:waves]:
        cells = items.withColumn("trial", F.explode(F.array(*map(F.lit, wave))))
        due = cells.join(before.filter("finished").select("item", "trial"), ["item", "trial"], "left_anti")
        if due.isEmpty():
            continue
        own = rows.withColumn("trial", F.explode(F.array(*map(F.lit, wave)))).join(due.withColumnRenamed("item", item), [item, "trial"], "left_semi")
        own.groupBy(item, "trial").applyInPandas(cell, schema).write.mode("append").parquet(path)
    return sweep_results(spark, path, schema, started_at)


def sweep_results(spark: SparkSession, path: str, schema: str, skipped_to: int = 0) -> DataFrame:
    """The last attempt of each cell, a finished one before all others; done is skipped where the attempt is not beyond ``skipped_to``."""
    order = Window.partitionBy("item", "trial").orderBy(F.desc(F.col("status") == "done"), F.desc("attempt"))
    last = _read(spark, path, schema).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    old = (F.col("status") == "done") & (F.col("attempt") <= skipped_to)
    return last.withColumn("status", F.when(old, "skipped").otherwise(F.col("status"))).withColumn("seconds", F.when(old, 0.0).otherwise(F.col("seconds")))


def merged_speech(parameters: dict[str, float], clip: pd.DataFrame) -> dict[str, object]:
    """Work of a sweep: a clip's segments (speaker, start, end) merged over gaps up to ``gap``, shorter than ``least`` left out."""
    gap, least = parameters["gap"], parameters["least"]
    if gap < 0:
        raise ValueError("gap is negative")
    clip = clip.sort_values(["start", "seg_ord"])
    stretch = (clip.speaker != clip.speaker.shift()).cumsum()
    reach = clip.end.groupby(stretch).cummax().groupby(stretch).shift()
    chunk = (reach.isna() | (clip.start - reach > gap)).cumsum()
    merged = clip.groupby(chunk).agg(start=("start", "min"), end=("end", "max"))
    length = merged.end - merged.start
    kept = length[length >= least]
    return {"chunks": len(kept), "speech": float(kept.sum()), "short_share": float((kept < 2 * least).mean()) if len(kept) else 0.0}

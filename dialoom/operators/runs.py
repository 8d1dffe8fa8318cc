"""Runs of a multi-step job, projects and activity: roll-ups, states, resume points, feeds.

A run row has ``run_id``, ``input_stem``, ``status``, ``created_at``; steps are rows (run_id, name, ord, state, started_at,
ended_at) or an array of such structs. Everything is grouped with partial sums; feeds are top-k, never a full sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINISHED = ("done", "skipped")
MOST_EVENTS = 2000


def chunk_metrics(rows: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Counts, the mean of positive duration ratios, and a histogram of emotions of each run's chunks."""
    flat = rows.groupBy(*by).agg(
        F.count("*").alias("chunks"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("errors"),
        F.avg(F.when(F.col("duration_ratio") > 0, F.col("duration_ratio"))).alias("mean_ratio"),
    )
    counts = rows.filter("emotion IS NOT NULL").groupBy(*by, "emotion").agg(F.count("*").alias("n"))
    hist = counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("emotion", "n")))).alias("emotions"))
    return flat.join(hist, list(by), "left")


def progress(steps: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """(by, steps, finished, progress_pct): the percentage of steps done or skipped, rounded half to even."""
    done = F.count_if(F.col("state").isin(*FINISHED))
    return steps.groupBy(*by).agg(F.count("*").alias("steps"), done.alias("finished")).withColumn(
        "progress_pct", F.bround(100.0 * F.col("finished") / F.col("steps")).cast("int")
    )


def project_summary(runs: DataFrame, statuses: Sequence[str], by: str = "input_stem") -> DataFrame:
    """One row a project: runs, runs of each status, first and last creation, the last run's id and status."""
    last = F.max(F.struct("created_at", "run_id", "status"))
    return runs.groupBy(by).agg(
        F.count("*").alias("runs"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses], F.min("created_at").alias("first_created"),
        F.max("created_at").alias("last_created"), last.run_id.alias("last_run"), last.status.alias("last_status"),
    )


def kpi(runs: DataFrame, steps: DataFrame, good: str, bad: str) -> DataFrame:
    """One row: runs, projects, success rate over finished runs, mean wall time (last end - first start) of good runs."""
    wall = steps.groupBy("run_id").agg((F.max("ended_at") - F.min("started_at")).alias("wall"))
    met = runs.join(wall, "run_id", "left")
    ok, failed = F.count_if(F.col("status") == good), F.count_if(F.col("status") == bad)
    return met.agg(
        F.count("*").alias("runs"), F.count_distinct("input_stem").alias("projects"), F.when(ok + failed > 0, ok / (ok + failed)).alias("success_rate"),
        F.avg(F.when(F.col("status") == good, F.col("wall"))).alias("mean_wall"),
    )


def repair_counts(rows: DataFrame) -> DataFrame:
    """Counts of rows with problems, and how many have any."""
    conditions = {
        "blocked": F.col("status") == "blocked", "errors": F.col("status") == "error", "stale": F.col("status") == "stale",
        "rejected": ~F.coalesce("accepted", F.lit(True)),
    }
    either = F.lit(False)
    for c in conditions.values():
        either = either | F.coalesce(c, F.lit(False))
    return rows.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()], F.count_if(either).alias("total"))


def resume_point(steps: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """(by, resume_at): the first step that is not finished; null if all are."""
    open_ = F.when(~F.col("state").isin(*FINISHED), F.struct("ord", "name"))
    return steps.groupBy(*by).agg(F.min(open_).getField("name").alias("resume_at"))


def failed_tail(steps: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Steps after the first failed one are pending."""
    first = F.min(F.when(F.col("state") == "failed", F.col("ord"))).over(Window.partitionBy(*by))
    return steps.withColumn("_f", first).withColumn("state", F.when(F.col("ord") > F.col("_f"), "pending").otherwise(F.col("state"))).drop("_f")


def steps_between(steps: DataFrame, first: int | None = None, last: int | None = None, only: Sequence[str] = ()) -> DataFrame:
    """Steps of a range, both ends included, or of the given names; a range that is turned around is an error."""
    if first is not None and last is not None and first > last:
        raise ValueError("the first step comes after the last")
    if only:
        return steps.filter(F.col("name").isin(*only))
    return steps.filter((F.col("ord") >= (first if first is not None else -(2**31))) & (F.col("ord") <= (last if last is not None else 2**31 - 1)))


def set_step(steps: Column, name: str, **fields: Column) -> Column:
    """An array of step structs with fields of the named step replaced."""
    def changed(s: Column) -> Column:
        for key, value in fields.items():
            s = s.withField(key, value)
        return s

    return F.transform(steps, lambda s: F.when(s.getField("name") == name, changed(s)).otherwise(s))


def reconcile(runs: DataFrame) -> DataFrame:
    """After a crash: what ran or waited has failed."""
    return runs.withColumn("status", F.when(F.col("status").isin("running", "queued"), "failed").otherwise(F.col("status")))


def group_failure(steps: DataFrame, failed: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """In runs whose step group failed (by), the first pending or running step has failed."""
    met = steps.join(failed.select(*by).distinct().withColumn("_bad", F.lit(True)), list(by), "left")
    first = F.min(F.when(F.col("state").isin("pending", "running"), F.col("ord"))).over(Window.partitionBy(*by))
    return met.withColumn("_f", first).withColumn("state", F.when(F.col("_bad") & (F.col("ord") == F.col("_f")), "failed").otherwise(F.col("state"))).drop("_bad", "_f")


def inferred_steps(outputs: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """(by, step, complete): all outputs of the step exist, or the final output of the run does; rows (by, step, exists, final)."""
    each = outputs.groupBy(*by, "step").agg(F.bool_and("exists").alias("_e"), F.bool_or(F.coalesce(F.col("final") & F.col("exists"), F.lit(False))).alias("_f"))
    return each.select(*by, "step", (F.col("_e") | F.max("_f").over(Window.partitionBy(*by))).alias("complete"))


def activity_feed(events: DataFrame, limit: int, *, newest_first: bool = True) -> DataFrame:
    """The newest events, at most ``limit``, which is held to 1..2000: a top-k over all partitions."""
    order = [F.desc("ts"), F.desc("event_id")] if newest_first else [F.asc("ts"), F.asc("event_id")]
    return events.orderBy(*order).limit(max(1, min(MOST_EVENTS, limit)))


def by_day(events: DataFrame, time: Column) -> DataFrame:
    """(day, events, first_id, last_id)."""
    day = F.to_date(time)
    return events.groupBy(day.alias("day")).agg(F.count("*").alias("events"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def last_n(events: DataFrame, n: int, by: Sequence[str], order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The n newest events of each key."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def trial_summary(cells: DataFrame, by: Sequence[str] = ("trial",)) -> DataFrame:
    """Cells (trial, status, errors, seconds) -> macro, weighted and worst error rate, a combined score and the trial's status."""
    ok = F.col("status") == "done"
    rate = F.when(ok & (F.col("seconds") > 0), F.col("errors") / F.col("seconds"))
    out = cells.groupBy(*by).agg(
        F.count("*").alias("cells"), F.count_if(ok).alias("done"), F.avg(rate).alias("macro"), F.max(rate).alias("worst"),
        (F.sum(F.when(ok, F.col("errors"))) / F.sum(F.when(ok & (F.col("seconds") > 0), F.col("seconds")))).alias("weighted"),
    )
    state = F.when(F.col("done") == 0, "failed").when(F.col("done") < F.col("cells"), "partial").otherwise("done")
    return out.withColumn("status", state).withColumn("combined", 0.75 * F.col("weighted") + 0.25 * F.col("worst"))


def ranked_trials(trials: DataFrame, metric: str, proxy: str, order: str, k: int) -> DataFrame:
    """The k best trials: by the metric, where it is missing by the proxy, else last; of equals the earlier trial."""
    value = F.coalesce(F.col(metric), F.col(proxy), F.lit(float("inf")))
    return trials.withColumn("sort_value", value).orderBy("sort_value", order).limit(k)


def parameter_grid(spark, values: dict[str, Sequence], fixed: dict[str, object] | None = None) -> DataFrame:
    """One row for each combination of the values, with the fixed ones; numbered in the order of the lists."""
    grid = spark.range(1).select(F.lit(0).alias("_"))
    for name, choices in values.items():
        grid = grid.select("*", F.posexplode(F.array(*[F.lit(v) for v in choices])).alias(f"_{name}", name))
    order = [f"_{name}" for name in values]
    for name, value in (fixed or {}).items():
        grid = grid.withColumn(name, F.lit(value))
    # A grid has as many rows as trials: one window over it is small.
    return grid.withColumn("trial", F.row_number().over(Window.orderBy(*order)) if order else F.lit(1)).drop("_", *order)


def plateaus(rows: DataFrame, by: Sequence[str] = (), range_rows: int = 100_000) -> DataFrame:
    """(by, main_count, first, last, length): runs of equal main counts over rising thresholds.

    Rows are cut into ranges of about ``range_rows`` thresholds. Runs are found within each range, and then again among the
    runs, of which a range has few where a plateau is long: no task needs a whole group.
    """
    count, = rows.agg(F.count("*")).first()
    steps = [i / (-(-count // range_rows)) for i in range(1, -(-count // range_rows))]
    cuts = sorted({c for c in rows.agg(F.percentile_approx("threshold", steps)).first()[0]}) if steps else []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("threshold") >= c)) if cuts else F.lit(0)

    def joined(runs: DataFrame, keys: Sequence[str], apart: Sequence[str] = ()) -> DataFrame:
        """Neighbours of one count as one, but for those that agree in ``apart``: they are runs already."""
        w = Window.partitionBy(*keys).orderBy("first", "last")
        differs = ~F.lag("main_count").over(w).eqNullSafe(F.col("main_count"))
        for c in apart:
            differs |= F.lag(c).over(w).eqNullSafe(F.col(c))
        new = runs.withColumn("_n", differs.cast("int"))
        return new.withColumn("_run", F.sum("_n").over(w)).groupBy(*keys, "_run").agg(
            F.first("main_count").alias("main_count"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length")
        ).drop("_run")

    single = rows.select(*by, "main_count", F.col("threshold").alias("first"), F.col("threshold").alias("last"), F.lit(1).cast("long").alias("length"), part.alias("_part"))
    within = joined(single, [*by, "_part"])
    if not cuts:
        return within.drop("_part")
    # Only the first and last run of a range can go on in a neighbour; the others are whole.
    ends = Window.partitionBy(*by, "_part")
    marked = within.withColumn("_end", (F.col("first") == F.min("first").over(ends)) | (F.col("last") == F.max("last").over(ends)))
    edge = marked.filter("_end").withColumn("_key", F.lit(0))
    return joined(edge, [*by, "_key"], ["_part"]).drop("_key").unionByName(marked.filter("NOT _end").drop("_part", "_end"))


def canonical_parameters(parameters: Column, aliases: dict[str, str], allowed: Sequence[str]) -> Column:
    """A map of parameters with aliases resolved; an unknown name is an error."""
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map()
    renamed = F.transform_keys(parameters, lambda k, _: F.coalesce(F.try_element_at(names, k), k)) if aliases else parameters
    unknown = F.filter(F.map_keys(renamed), lambda k: ~k.isin(list(allowed)))
    return F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown parameters: "), F.array_join(unknown, ", "))).cast("map<string,string>")).otherwise(renamed)


def threshold_advice(main: Column, outlier: Column, low: int = 2, high: int = 6) -> Column:
    """Whether a clustering threshold should go up (too many main speakers), down (too few, or many outliers) or stay."""
    return F.when(main > high, "raise").when((main < low) | (outlier > main), "lower").otherwise("accept")

"""Interval tables of one label each: normalising, merging, absorbing, splitting, gaps, runs and profiles.

A segment table has clip columns (``by``, one clip is one media file), ``seg_ord`` (its place in the source), ``speaker``,
``start`` and ``end`` in seconds, half-open. Order within a clip is (start, seg_ord). Windows are over clips, so work
spreads with the number of clips; a clip is a scene or a film, not a corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

BY = ("clip_id",)
ORDER = ("start", "seg_ord")


def in_clip(by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def chunk_id(number: Column) -> Column:
    return F.format_string("chunk_%04d", number)


def lenient(rows: DataFrame, places: int = 6) -> DataFrame:
    """Rows whose start and end are finite numbers with end > start; the others are dropped, times rounded."""
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    timed = rows.withColumn("start", number("start")).withColumn("end", number("end")).filter(finite("start") & finite("end"))
    timed = timed.withColumn("start", F.bround("start", places)).withColumn("end", F.bround("end", places))
    return timed.filter("end > start").withColumn("duration", F.bround(F.col("end") - F.col("start"), places))


def labelled(rows: DataFrame) -> DataFrame:
    """Rows with a speaker that is not blank and end > start, with duration to the millisecond."""
    kept = rows.filter((F.trim(F.coalesce("speaker", F.lit(""))) != "") & (F.col("end") > F.col("start")))
    return kept.withColumn("duration", F.bround(F.col("end") - F.col("start"), 3))


def clip_to(rows: DataFrame, low: Column, high: Column, least: float = 0.0) -> DataFrame:
    """The part of each interval within a window, if it is positive and at least so long."""
    cut = rows.withColumn("start", F.greatest("start", low)).withColumn("end", F.least("end", high))
    return cut.filter((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") >= least))


def islands(rows: DataFrame, breaks: Column, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """rows with ``island``: the number of breaks up to the row in its clip. breaks may use lag() over in_clip()."""
    return rows.withColumn("_break", breaks.cast("int")).withColumn("island", F.sum("_break").over(in_clip(by, order))).drop("_break")


def merge_chunks(
    rows: DataFrame, gap: float = 0.5, by: Sequence[str] = BY, least: float = 0.0, last_end: bool = False, collect: dict[str, Column] | None = None
) -> DataFrame:
    """Joins neighbours in time of the same speaker with at most ``gap`` seconds between, and numbers the chunks.

    The end so far is the running maximum (a segment may lie within an earlier one); with ``last_end`` a chunk ends where
    its last segment does. Another speaker in between always starts a new chunk. ``collect`` adds aggregates of the chunk.
    """
    w = in_clip(by)
    switched = rows.withColumn("_switch", (~F.lag("speaker").over(w).eqNullSafe(F.col("speaker"))).cast("int"))
    switched = switched.withColumn("_stretch", F.sum("_switch").over(w))
    # The end so far within a stretch of one speaker; over a gap that breaks, earlier ends are smaller than the start anyway.
    in_stretch = Window.partitionBy(*by, "_stretch").orderBy(*ORDER)
    reach = F.lag("end").over(in_stretch) if last_end else F.max("end").over(in_stretch.rowsBetween(Window.unboundedPreceding, -1))
    marked = switched.withColumn("_new", F.when(F.col("_switch") == 1, 1).when(F.col("start") - reach > gap, 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("_new").over(w))
    order = F.struct(*ORDER)
    grouped = numbered.groupBy(*by, "island").agg(
        F.first("speaker").alias("speaker"), F.min("start").alias("start"), (F.max_by("end", order) if last_end else F.max("end")).alias("end"),
        F.count("*").cast("int").alias("source_segment_count"), F.min("seg_ord").alias("seg_ord"), *[c.alias(n) for n, c in (collect or {}).items()],
    )
    kept = grouped.filter(F.col("end") - F.col("start") >= least).drop("island")
    place = F.row_number().over(in_clip(by)).cast("long")
    return kept.withColumn("chunk_ord", place).withColumn("chunk_id", chunk_id(F.col("chunk_ord"))).withColumn("duration", F.col("end") - F.col("start"))


def merge_chunks_capped(rows: DataFrame, gap: float = 0.5, longest: float = 15.0, by: Sequence[str] = BY) -> DataFrame:
    """As merge_chunks, but a chunk never grows beyond ``longest`` seconds. The rule needs the chunk so far: a fold over the clip."""
    item = F.struct("start", "seg_ord", "end", "speaker")
    ordered = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    chunk = "array<struct<speaker:string,start:double,end:double,count:int>>"

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        until = F.greatest(last.end, x.end)
        joins = (F.size(done) > 0) & (last.speaker == x.speaker) & (x.start - last.end <= gap) & (until - last.start <= longest)
        grown = F.struct(last.speaker.alias("speaker"), last.start.alias("start"), until.alias("end"), (last["count"] + 1).alias("count"))
        new = F.struct(x.speaker.alias("speaker"), x.start.alias("start"), x.end.alias("end"), F.lit(1).alias("count"))
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(head, F.array(grown))).otherwise(F.concat(done, F.array(new))).cast(chunk)

    folded = ordered.select(*by, F.posexplode(F.aggregate("items", F.array().cast(chunk), step)).alias("pos", "c"))
    return folded.select(
        *by, (F.col("pos") + 1).cast("long").alias("chunk_ord"), chunk_id(F.col("pos") + 1).alias("chunk_id"), "c.speaker", "c.start", "c.end",
        F.col("c.count").alias("source_segment_count"),
    )


def absorb_short(rows: DataFrame, short: float, gap: float, by: Sequence[str] = BY) -> DataFrame:
    """A segment shorter than ``short`` takes the label of its longer neighbour within ``gap``; by the labels as they were."""
    w = in_clip(by)
    length = F.col("end") - F.col("start")
    side = {}
    for name, of in (("prev", F.lag), ("next", F.lead)):
        near = (F.col("start") - of("end").over(w)) if name == "prev" else (of("start").over(w) - F.col("end"))
        side[name] = F.when(near <= gap, of(length).over(w)), of("speaker").over(w)
    (long_p, who_p), (long_n, who_n) = side["prev"], side["next"]
    taken = F.when(length < short, F.when(long_n.isNotNull() & (long_p.isNull() | (long_n > long_p)), who_n).when(long_p.isNotNull(), who_p))
    return rows.withColumn("absorbed", F.coalesce(taken != F.col("speaker"), F.lit(False))).withColumn("speaker", F.coalesce(taken, "speaker"))


def sandwich(rows: DataFrame, gap: float = 0.3, by: Sequence[str] = BY) -> DataFrame:
    """A speaker heard once in the clip, between two segments of another at gaps of 0 to ``gap``, is taken for that one.

    Neighbours are compared as they were: a label heard once cannot have a neighbour changed on both sides by this rule.
    """
    w = in_clip(by)
    once = F.count("*").over(Window.partitionBy(*by, "speaker")) == 1
    left, right = F.col("start") - F.lag("end").over(w), F.lead("start").over(w) - F.col("end")
    around = F.lag("speaker").over(w)
    hit = once & (around == F.lead("speaker").over(w)) & (around != F.col("speaker")) & left.between(0, gap) & right.between(0, gap)
    return rows.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_around", around).withColumn(
        "speaker", F.when(F.col("_hit"), F.col("_around")).otherwise(F.col("speaker"))
    ).drop("_hit", "_around")


def gaps(rows: DataFrame, least: float, by: Sequence[str] = BY, total: Column | None = None, running: bool = True) -> DataFrame:
    """(by, start, end): holes of at least ``least`` seconds before, between and (if ``total`` is given) after the segments."""
    w = in_clip(by)
    until = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) if running else F.lag("end").over(w)
    holes = rows.select(*by, F.coalesce(until, F.lit(0.0)).alias("gap_start"), F.col("start").alias("gap_end"))
    if total is not None:
        ends = rows.groupBy(*by).agg(F.max("end").alias("gap_start"), F.max(total).alias("gap_end"))
        holes = holes.unionByName(ends)
    return holes.filter(F.col("gap_end") - F.col("gap_start") >= least)


_FOLD = "seg_ord long, speaker string, start double, end double"


def _merged(items: list[list], gap: float) -> list[list]:
    out: list[list] = []
    for o, who, start, end in items:
        if out and out[-1][1] == who and start - out[-1][3] <= gap:
            out[-1][3] = max(out[-1][3], end)
        else:
            out.append([o, who, start, end])
    return out


def stabilised(items: list[list], tiny: float, tiny_gap: float, bridge: float, bridge_gap: float, merge_gap: float, most_passes: int) -> list[list]:
    """Absorb, bridge and merge one clip's (seg_ord, speaker, start, end) until nothing changes; changes are seen at once."""
    for _ in range(most_passes):
        before = [list(x) for x in items]
        for i, x in enumerate(items):
            if x[3] - x[2] > tiny:
                continue
            near = []
            for j, away in ((i - 1, x[2] - items[i - 1][3] if i else None), (i + 1, items[i + 1][2] - x[3] if i + 1 < len(items) else None)):
                if away is not None and away <= tiny_gap:
                    near.append((max(away, 0.0), -(items[j][3] - items[j][2]), items[j][1]))
            if len(near) == 2 and near[0][2] == near[1][2]:
                x[1] = near[0][2]
            elif near:
                x[1] = min(near)[2]
        for i in range(1, len(items) - 1):
            a, x, b = items[i - 1 : i + 2]
            calm = x[2] - a[3] <= bridge_gap and b[2] - x[3] <= bridge_gap
            if a[1] == b[1] != x[1] and x[3] - x[2] <= bridge and calm and (a[3] - a[2]) + (b[3] - b[2]) >= x[3] - x[2]:
                x[1] = a[1]
        items = _merged(items, merge_gap)
        if items == before:
            break
    return items


def stabilise(
    rows: DataFrame, tiny: float = 0.4, tiny_gap: float = 0.3, bridge: float = 1.0, bridge_gap: float = 0.3, merge_gap: float = 0.3, most_passes: int = 4,
    by: Sequence[str] = BY,
) -> DataFrame:
    """The fixpoint of absorbing tiny segments, bridging A-B-A and merging, clip by clip: later steps see earlier changes."""
    ship(rows.sparkSession)
    keys = list(by)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def run(clip: pd.DataFrame) -> pd.DataFrame:
        ordered = clip.sort_values(["start", "seg_ord"])
        items = [list(x) for x in zip(ordered.seg_ord, ordered.speaker, ordered.start, ordered.end)]
        done = stabilised(items, tiny, tiny_gap, bridge, bridge_gap, merge_gap, most_passes)
        out = pd.DataFrame(done, columns=["seg_ord", "speaker", "start", "end"])
        for k in keys:
            out[k] = clip[k].iloc[0]
        return out[[*keys, "seg_ord", "speaker", "start", "end"]]

    return labelled(rows).select(*keys, "seg_ord", "speaker", "start", "end").groupBy(*keys).applyInPandas(run, f"{shape}, {_FOLD}")


def speaker_durations(rows: DataFrame, by: Sequence[str] = BY, least_total: float = 0.0) -> DataFrame:
    """(by, speaker, seconds, segments) of speakers with enough time."""
    found = rows.groupBy(*by, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"), F.count("*").alias("segments"))
    return found.filter(F.col("seconds") >= least_total)


def structure_profile(rows: DataFrame, by: Sequence[str] = BY, short: float = 1.0, total: Column | None = None) -> DataFrame:
    """One row of structure figures for each clip: counts, times, shares, switches, entropy of the speakers' time."""
    w = in_clip(by)
    length = F.col("end") - F.col("start")
    marked = rows.withColumn("_switch", F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("int"), F.lit(0)))
    flat = marked.groupBy(*by).agg(
        F.count("*").alias("n_segments"), F.count_distinct("speaker").alias("n_speakers"), F.sum(length).alias("speech_seconds"),
        F.min(length).alias("min_seconds"), F.avg(length).alias("mean_seconds"), F.max(length).alias("max_seconds"),
        F.count_if(length < short).alias("n_short"), F.sum("_switch").alias("n_switches"),
        F.max(F.col("end") if total is None else total).alias("total_seconds"),
    )
    part = speaker_durations(rows, by).withColumn("_all", F.sum("seconds").over(Window.partitionBy(*by)))
    share = F.col("seconds") / F.col("_all")
    entropy = part.filter("seconds > 0").groupBy(*by).agg(F.sum(-share * F.log2(share)).alias("entropy"), F.count("*").alias("_n"))
    entropy = entropy.withColumn("entropy_share", F.when(F.col("_n") > 1, F.col("entropy") / F.log2("_n")).otherwise(0.0)).drop("_n")
    minutes = F.col("total_seconds") / 60
    return flat.join(entropy, list(by), "left").withColumn("short_share", F.col("n_short") / F.col("n_segments")).withColumn(
        "switches_per_minute", F.when(minutes > 0, F.col("n_switches") / minutes).otherwise(0.0)
    ).withColumn("coverage", F.when(F.col("total_seconds") > 0, F.least(F.lit(1.0), F.col("speech_seconds") / F.col("total_seconds"))).otherwise(0.0))


def label_sequence(rows: DataFrame, by: Sequence[str] = BY, least: float = 0.0) -> DataFrame:
    """(by, labels): the speakers in order, repeats collapsed, of segments that are long enough."""
    kept = rows.filter(F.col("end") - F.col("start") >= least)
    changed = kept.withColumn("_new", ~F.lag("speaker").over(in_clip(by)).eqNullSafe(F.col("speaker"))).filter("_new")
    ordered = F.array_sort(F.collect_list(F.struct("start", "seg_ord", "speaker")))
    return changed.groupBy(*by).agg(F.transform(ordered, lambda x: x.speaker).alias("labels"))


def frame_runs(frames: DataFrame, step: Column, by: Sequence[str] = BY, label: str = "speaker", frame: str = "frame") -> DataFrame:
    """Runs of consecutive frames with equal labels: (by, speaker, first_frame, last_frame, start, end)."""
    w = Window.partitionBy(*by).orderBy(frame)
    new = ~(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.coalesce(F.col(frame) - F.lag(frame).over(w) == 1, F.lit(False)))
    runs = frames.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    found = runs.groupBy(*by, "_run").agg(F.first(label).alias(label), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame")).drop("_run")
    return found.withColumn("start", F.col("first_frame") * step).withColumn("end", (F.col("last_frame") + 1) * step)


def speaking_runs(frames: DataFrame, threshold: float, gap: float = 0.2, least: float = 0.5, by: Sequence[str] = BY) -> DataFrame:
    """(by, start, end) of frames (t, score) at or above the threshold; a low frame or a hole of over ``gap`` seconds breaks."""
    w = Window.partitionBy(*by).orderBy("t")
    on = F.col("score") >= threshold
    marked = frames.withColumn("_on", on).withColumn("_new", (on & (F.coalesce(~F.lag(on).over(w), F.lit(True)) | (F.col("t") - F.lag("t").over(w) > gap))).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(w)).filter("_on").groupBy(*by, "_run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("frames"))
    return runs.filter(F.col("end") - F.col("start") >= least).drop("_run")


def pauses(frames: DataFrame, step: float, least: float = 0.18, by: Sequence[str] = BY) -> DataFrame:
    """(by, start, end, duration) of runs of silent frames (frame, silent) of at least ``least`` seconds; the end has one frame more."""
    runs = frame_runs(frames.withColumn("silent", F.col("silent").cast("string")), F.lit(step), by, "silent").filter("silent = 'true'")
    return runs.withColumn("duration", F.col("end") - F.col("start")).filter(F.col("duration") >= least).select(*by, "start", "end", "duration")


def split_long(rows: DataFrame, longest: float) -> DataFrame:
    """Each segment in equal pieces of at most ``longest`` seconds, with ``piece``, ``pieces`` and a reason if there are several."""
    count = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / longest - 1e-9)).cast("int")
    parts = rows.withColumn("pieces", count).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    width = (F.col("end") - F.col("start")) / F.col("pieces")
    return parts.withColumn("_s", F.col("start") + F.col("piece") * width).withColumn(
        "end", F.when(F.col("piece") == F.col("pieces") - 1, F.col("end")).otherwise(F.col("start") + (F.col("piece") + 1) * width)
    ).withColumn("start", F.col("_s")).drop("_s").withColumn("split_reason", F.when(F.col("pieces") > 1, "max_duration"))


def sliding_windows(rows: DataFrame, width: float = 4.0, hop: float = 3.0, least: float = 0.5) -> DataFrame:
    """Each interval cut into windows of ``width`` every ``hop`` seconds; the last ones end with it and are at least ``least`` long."""
    last = F.greatest(F.ceil((F.col("end") - F.col("start") - least) / hop + 1e-9) - 1, F.lit(0)).cast("int")
    cut = rows.filter(F.col("end") - F.col("start") >= least).withColumn("window", F.explode(F.sequence(F.lit(0), last)))
    cut = cut.withColumn("window_start", F.col("start") + F.col("window") * hop)
    return cut.withColumn("window_end", F.least(F.col("window_start") + width, F.col("end"))).filter(F.col("window_end") - F.col("window_start") >= least)


def until_next(rows: DataFrame, total: Column, fade: float = 0.025, by: Sequence[str] = BY) -> DataFrame:
    """``placed_end``: the end, but not beyond the next start, the last not beyond the total; ``fade_out`` where it was cut."""
    limit = F.coalesce(F.lead("start").over(in_clip(by)), total)
    return rows.withColumn("placed_end", F.least("end", limit)).withColumn("fade_out", F.when(F.col("placed_end") < F.col("end"), fade).otherwise(0.0))


def consecutive_groups(rows: DataFrame, key: str, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """rows with ``batch``: neighbours in order with the same key share a number, from 1."""
    w = in_clip(by, order)
    new = ~F.lag(key).over(w).eqNullSafe(F.col(key)) | (F.row_number().over(w) == 1)
    return rows.withColumn("_new", new.cast("int")).withColumn("batch", F.sum("_new").over(w)).drop("_new")


def batches(rows: DataFrame, size: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """rows with ``batch``, from 0, of ``size`` rows each."""
    return rows.withColumn("batch", F.floor((F.row_number().over(in_clip(by, order)) - 1) / size).cast("long"))


def neighbours(rows: DataFrame, text: str = "text", by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    w = in_clip(by, order)
    return rows.withColumn("previous_line", F.lag(text).over(w)).withColumn("next_line", F.lead(text).over(w))


def longest_per_speaker(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The longest segment of each speaker; of equals the first."""
    w = Window.partitionBy(*by, "speaker").orderBy((F.col("end") - F.col("start")).desc(), *ORDER)
    return rows.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def without_overlap(rows: DataFrame, margin: float = 0.3, by: Sequence[str] = BY) -> DataFrame:
    """Segments that no other segment of the clip overlaps, within a margin: by running ends from either side."""
    before = F.max("end").over(in_clip(by).rowsBetween(Window.unboundedPreceding, -1))
    # The smallest start after a row is that of the next row, since rows are in the order of starts.
    after = F.lead("start").over(in_clip(by))
    marked = rows.withColumn("_b", before).withColumn("_a", after)
    return marked.filter((F.coalesce("_b", F.lit(-1e18)) <= F.col("start") - margin) & (F.coalesce("_a", F.lit(1e18)) >= F.col("end") + margin)).drop("_b", "_a")


def boundaries(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, t): all starts and ends, once each."""
    return rows.select(*by, F.col("start").alias("t")).union(rows.select(*by, F.col("end").alias("t"))).distinct()


def median_smoothed(rows: DataFrame, value: str, half: int = 6, by: Sequence[str] = BY, order: Sequence[str] = ("frame",)) -> DataFrame:
    """The median over ``half`` rows on either side."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-half, half)
    return rows.withColumn("smoothed", F.percentile(value, 0.5).over(w))


def speaker_class(speaker: Column) -> Column:
    return F.when(speaker.startswith("SPEAKER_BG"), "background").when(speaker.startswith("SPEAKER_9"), "outlier").otherwise("main")


def run_cuts(runs: DataFrame, segments: DataFrame, by: Sequence[str] = BY, key: str = "face", least: float = 0.7) -> DataFrame:
    """Segments cut where the runs of another face begin: runs (by, seg_ord, face, start, end) within segments; short runs are dropped first,
    then neighbours with equal faces count as one. Segments with one face stay whole."""
    kept = runs.filter(F.col("end") - F.col("start") >= least)
    w = Window.partitionBy(*by, "seg_ord").orderBy("start")
    first = kept.withColumn("_new", ~F.lag(key).over(w).eqNullSafe(F.col(key))).filter("_new").select(*by, "seg_ord", key, F.col("start").alias("_at"))
    numbered = first.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "seg_ord").orderBy("_at")))
    met = segments.join(numbered, [*by, "seg_ord"], "left")
    begin = F.when(F.col("_i") > 1, F.greatest("_at", "start")).otherwise(F.col("start"))
    cut = met.withColumn("_b", begin)
    after = F.lead("_b").over(Window.partitionBy(*by, "seg_ord").orderBy("_b"))
    return cut.withColumn("end", F.coalesce(after, "end")).withColumn("start", F.col("_b")).withColumn("part", F.coalesce("_i", F.lit(1))).drop("_b", "_i", "_at").filter("end > start")


def binned(evidence: DataFrame, step: float = 0.1, by: Sequence[str] = BY, key: str = "face") -> DataFrame:
    """(by, seg_ord, bin, face): the face with the largest summed score in each bin of time; evidence (by, seg_ord, t, face, score)."""
    summed = evidence.groupBy(*by, "seg_ord", F.floor(F.col("t") / step).alias("bin"), key).agg(F.sum("score").alias("s"))
    return summed.groupBy(*by, "seg_ord", "bin").agg(F.max(F.struct("s", key)).alias("m")).select(*by, "seg_ord", "bin", F.col(f"m.{key}").alias(key))


def union_of(rows: DataFrame, pad_before: float = 0.0, pad_after: float = 0.0, by: Sequence[str] = BY) -> DataFrame:
    """(by, start, end): the time covered by the intervals, padded, as disjoint intervals. Its complement is gaps()."""
    padded = rows.select(*by, F.greatest(F.col("start") - pad_before, F.lit(0.0)).alias("start"), (F.col("end") + pad_after).alias("end"))
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = padded.withColumn("_n", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("_i", F.sum("_n").over(w))
    return marked.groupBy(*by, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def interpolated(rows: DataFrame, value: str, by: Sequence[str] = BY, frame: str = "frame") -> DataFrame:
    """Missing values between two known ones on the straight line between them; at the ends the nearest known one."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(frame).alias("f"), F.col(value).alias("v")))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    past = F.last(known, ignorenulls=True).over(Window.partitionBy(*by).orderBy(frame).rowsBetween(*so_far))
    after = F.last(known, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc(frame)).rowsBetween(*so_far))
    met = rows.withColumn("_p", past).withColumn("_a", after)
    share = (F.col(frame) - F.col("_p.f")) / F.when(F.col("_a.f") > F.col("_p.f"), F.col("_a.f") - F.col("_p.f")).otherwise(1)
    between = F.col("_p.v") + (F.col("_a.v") - F.col("_p.v")) * share
    return met.withColumn(value, F.coalesce(between, "_p.v", "_a.v")).drop("_p", "_a")


def signal_features(frames: DataFrame, by: Sequence[str] = BY, silence: float = 0.01, clipped: float = 0.999) -> DataFrame:
    """Figures of framewise levels (by, frame, rms, peak, voiced): shares of silent, voiced and clipped frames, overall RMS and peak."""
    return frames.groupBy(*by).agg(
        F.count("*").alias("frames"), F.avg((F.col("rms") < silence).cast("double")).alias("silence_ratio"), F.avg(F.col("voiced").cast("double")).alias("voiced_ratio"),
        F.avg((F.col("peak") >= clipped).cast("double")).alias("clipping_ratio"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("rms"), F.max("peak").alias("peak"),
    )


def raw_statistics(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Counts of main, outlier and background speakers, and the total, mean, least and largest duration."""
    kind, length = speaker_class(F.col("speaker")), F.col("end") - F.col("start")
    count = lambda k: F.count_distinct(F.when(kind == k, F.col("speaker")))
    return rows.groupBy(*by).agg(
        count("main").alias("main_count"), count("outlier").alias("outlier_count"), count("background").alias("background_count"), F.count("*").alias("n_segments"),
        F.sum(length).alias("total_seconds"), F.avg(length).alias("mean_seconds"), F.min(length).alias("min_seconds"), F.max(length).alias("max_seconds"),
    )

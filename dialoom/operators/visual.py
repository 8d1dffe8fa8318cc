"""Evidence of face tracks for who speaks: frames of tracks meet chunks in time, faces meet speakers by counts.

Track frames (by, track_id, frame, t, score); faces map track_id to face.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .range_join import point_join

BY = ("clip_id",)


def track_frames(tracks: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One row a frame of nested tracks; parallel arrays of unequal lengths end with the shortest."""
    if "scores" in tracks.columns:
        zipped = tracks.select(*by, "track_id", F.explode(F.arrays_zip("frames", "ts", "scores")).alias("f")).select(*by, "track_id", F.col("f.frames").alias("frame"), F.col("f.ts").alias("t"), F.col("f.scores").alias("score"))
        return zipped.dropna(subset=["frame", "t", "score"])
    return tracks.select(*by, "track_id", F.explode("frames").alias("f")).select(*by, "track_id", "f.frame", "f.t", "f.score")


def face_evidence(chunks: DataFrame, frames: DataFrame, faces: DataFrame, threshold: float, by: Sequence[str] = BY, width: float = 5.0) -> DataFrame:
    """(by, chunk_ord, face, frames, score): of frames at or above the threshold within each chunk."""
    seen = frames.filter(F.col("score") >= threshold).join(faces, [*by, "track_id"])
    met = point_join(seen, chunks.select(*by, "chunk_ord", "start", "end"), F.col("t"), by, width)
    return met.groupBy(*by, F.col("r_chunk_ord").alias("chunk_ord"), "face").agg(F.count("*").alias("frames"), F.sum("score").alias("score"))


def dominant_face(evidence: DataFrame, least_frames: int = 1, by: Sequence[str] = BY) -> DataFrame:
    """(by, chunk_ord, face): the largest summed score; of equals the face that sorts first."""
    kept = evidence.filter(F.col("frames") >= least_frames)
    w = Window.partitionBy(*by, "chunk_ord").orderBy(F.desc("score"), "face")
    return kept.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*by, "chunk_ord", "face")


def overwrite_by_face(chunks: DataFrame, dominant: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Speakers become FACE_<face> where there is evidence; what was heard stays in audio_speaker."""
    met = chunks.join(dominant, [*by, "chunk_ord"], "left").withColumn("audio_speaker", F.col("speaker"))
    return met.withColumn("speaker", F.coalesce(F.concat(F.lit("FACE_"), F.col("face").cast("string")), "speaker")).drop("face")


def split_by_faces(chunks: DataFrame, dominant: DataFrame, least_chunks: int = 2, by: Sequence[str] = BY) -> DataFrame:
    """A speaker whose chunks show two or more faces, each in enough chunks, is split: _v0, _v1 in the order of faces' frequency."""
    met = chunks.join(dominant, [*by, "chunk_ord"], "left")
    counts = met.filter("face IS NOT NULL").groupBy(*by, "speaker", "face").agg(F.count("*").alias("n")).filter(F.col("n") >= least_chunks)
    several = counts.withColumn("_k", F.count("*").over(Window.partitionBy(*by, "speaker"))).filter("_k >= 2")
    ranked = several.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "speaker").orderBy(F.desc("n"), "face")) - 1)
    return met.join(ranked.select(*by, "speaker", "face", "_r"), [*by, "speaker", "face"], "left").withColumn(
        "speaker", F.when(F.col("_r").isNotNull(), F.concat("speaker", F.lit("_v"), F.col("_r").cast("string"))).otherwise(F.col("speaker"))
    ).drop("_r")


def remap_by_faces(chunks: DataFrame, dominant: DataFrame, ratio: float = 0.5, by: Sequence[str] = BY) -> DataFrame:
    """The largest face of a speaker keeps it; chunks of another face go to the speaker which that face mostly has, if above the ratio,
    else to a label of their own. In that order of precedence."""
    met = chunks.join(dominant, [*by, "chunk_ord"], "left")
    counts = met.filter("face IS NOT NULL").groupBy(*by, "speaker", "face").agg(F.count("*").alias("n"))
    main = counts.groupBy(*by, "speaker").agg(F.max(F.struct("n", (-F.col("face")).alias("f"))).alias("m")).select(*by, "speaker", (-F.col("m.f")).alias("main_face"))
    owner = counts.groupBy(*by, "face").agg(F.max(F.struct("n", "speaker")).alias("m"), F.sum("n").alias("all"))
    owner = owner.select(*by, "face", F.col("m.speaker").alias("owner"), (F.col("m.n") / F.col("all")).alias("purity"))
    out = met.join(main, [*by, "speaker"], "left").join(owner, [*by, "face"], "left")
    other = F.col("face").isNotNull() & (F.col("face") != F.col("main_face"))
    to = F.when(other & (F.col("purity") > ratio), F.col("owner")).when(other, F.concat("speaker", F.lit("_f"), F.col("face").cast("string")))
    return out.withColumn("speaker", F.coalesce(to, "speaker")).drop("main_face", "owner", "purity")


def largest_boxes(frames: DataFrame, k: int = 7, by: Sequence[str] = BY) -> DataFrame:
    """The k largest boxes (bbox x1, y1, x2, y2) of each track, in time order."""
    area = (F.get("bbox", F.lit(2)) - F.get("bbox", F.lit(0))) * (F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1)))
    w = Window.partitionBy(*by, "track_id").orderBy(area.desc(), "frame")
    return frames.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r").orderBy(*by, "track_id", "frame")


def chain_boxes(boxes: list[tuple[int, tuple]], least_iou: float, hole: int) -> list[int]:
    """Track numbers of (frame, box) in frame order: a box joins the track whose last box it overlaps most, not too long ago."""
    tracks: list[tuple[int, np.ndarray]] = []
    live: list[int] = []
    out = []
    for frame, box in boxes:
        b, best, found = np.asarray(box, float), least_iou, -1
        live = [k for k in live if frame - tracks[k][0] <= hole]  # an ended track is never looked at again
        for k in live:
            last, a = tracks[k]
            if 0 < frame - last:
                side = np.maximum(np.minimum(a[2:], b[2:]) - np.maximum(a[:2], b[:2]), 0)
                common = side[0] * side[1]
                union = np.prod(a[2:] - a[:2]) + np.prod(b[2:] - b[:2]) - common
                if union > 0 and common / union > best:
                    best, found = common / union, k
        if found < 0:
            tracks.append((frame, b))
            found = len(tracks) - 1
            live.append(found)
        else:
            tracks[found] = (frame, b)
        out.append(found)
    return out


def track_boxes(boxes: DataFrame, least_iou: float = 0.5, hole: int = 10, least_frames: int = 10, by: Sequence[str] = ("shot_id",)) -> DataFrame:
    """(by, frame, bbox, track): detections of a shot chained to tracks of enough frames."""
    ship(boxes.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}

    def run(shot: pd.DataFrame) -> pd.DataFrame:
        shot = shot.sort_values("frame", kind="stable")
        shot = shot.assign(track=chain_boxes(list(zip(shot.frame, shot.bbox)), least_iou, hole))
        return shot[shot.groupby("track").frame.transform("size") >= least_frames][[*by, "frame", "bbox", "track"]]

    shape = ", ".join(f"{k} {kinds[k]}" for k in by) + ", frame long, bbox array<double>, track int"
    return boxes.select(*by, "frame", "bbox").groupBy(*by).applyInPandas(run, shape)


def interpolated(tracks: DataFrame, least_face: float = 1.0, by: Sequence[str] = ("shot_id",)) -> DataFrame:
    """(by, track, frame, bbox): tracks with a box for each frame from their first to their last, those between two detections on the
    line between them; of tracks whose mean width or mean height is above ``least_face``."""
    w = Window.partitionBy(*by, "track").orderBy("frame")
    pairs = tracks.withColumn("_f", F.lead("frame").over(w)).withColumn("_b", F.lead("bbox").over(w))
    every = pairs.select(*by, "track", F.col("frame").alias("_a"), "bbox", "_f", "_b", F.explode(F.sequence("frame", F.coalesce(F.col("_f") - 1, "frame"))).alias("frame"))
    share = (F.col("frame") - F.col("_a")) / (F.col("_f") - F.col("_a"))
    between = F.zip_with("bbox", "_b", lambda x, y: x + (y - x) * share)
    filled = every.select(*by, "track", "frame", F.when(F.col("_b").isNull(), F.col("bbox")).otherwise(between).alias("bbox"))
    side = lambda i: F.avg(F.get("bbox", F.lit(i + 2)) - F.get("bbox", F.lit(i)))
    large = filled.groupBy(*by, "track").agg(F.greatest(side(0), side(1)).alias("_s")).filter(F.col("_s") > least_face)
    return filled.join(large.select(*by, "track"), [*by, "track"], "left_semi")

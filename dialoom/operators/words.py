"""Words in time: assignment to speakers' chunks by dynamic programming, runs of another voice, recovery in gaps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, written
from .range_join import nearest_interval, overlap_join, point_join


def best_path(gain: np.ndarray, starts: np.ndarray, ends: np.ndarray, switch: float, pause: float) -> np.ndarray:
    """Speaker numbers of words: the path with the most gain (words x speakers), less a cost for each change, which is free after a pause."""
    best, back = gain[0].astype(float), []
    for i in range(1, len(gain)):
        cost = 0.0 if starts[i] - ends[i - 1] > pause else switch
        top = int(best.argmax())
        stay = best >= best[top] - cost
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - cost) + gain[i]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def assign_words(words: DataFrame, chunks: DataFrame, by: Sequence[str], switch: float = 0.4, pause: float = 0.8, width: float = 5.0) -> DataFrame:
    """words with ``speaker`` and ``chunk_ord``: coverage by each speaker as the gain, the best path through a clip's words, then that
    speaker's chunk with the most overlap.

    A word that no chunk overlaps counts for the speaker of the chunk nearest to its middle; a word that no chunk of its path's speaker
    overlaps goes to the nearest of these. So every word has a chunk where its clip has one; of equally near ones the earlier. Coverage
    and nearness are joined in Spark; the path is one task a clip.
    """
    ship(words.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in words.schema}
    met = overlap_join(words.select(*by, "word_ord", "start", "end"), chunks.select(*by, "chunk_ord", "speaker", "start", "end"), by, width)
    length = F.greatest(F.col("end") - F.col("start"), F.lit(1e-6))
    per_chunk = met.groupBy(*by, "word_ord", F.col("r_speaker").alias("speaker"), F.col("r_chunk_ord").alias("chunk_ord")).agg(F.sum(F.col("overlap") / length).alias("share"))
    intervals = chunks.select(*by, F.col("chunk_ord").alias("seg_ord"), "speaker", "start", "end")
    middle = (F.col("start") + F.col("end")) / 2
    alone = words.select(*by, "word_ord", middle.alias("at")).join(per_chunk, [*by, "word_ord"], "left_anti")
    beside = nearest_interval(alone, intervals, F.col("at"), by, ["word_ord"]).filter("near_speaker IS NOT NULL")
    heard = per_chunk.unionByName(beside.select(*by, "word_ord", F.col("near_speaker").alias("speaker"), F.col("near_ord").alias("chunk_ord"), F.lit(1.0).alias("share")))
    gains = heard.groupBy(*by, "word_ord").agg(F.collect_list(F.struct("speaker", "share")).alias("gains"))
    rows = words.select(*by, "word_ord", "start", "end").join(gains, [*by, "word_ord"], "left")

    def run(clip: pd.DataFrame) -> pd.DataFrame:
        clip = clip.sort_values(["start", "word_ord"])
        names = sorted({g["speaker"] for gs in clip.gains if gs is not None for g in gs})
        out = clip[[*by, "word_ord"]].assign(speaker=None)
        if names:
            gain, place = np.zeros((len(clip), len(names))), {n: i for i, n in enumerate(names)}
            for i, gs in enumerate(clip.gains):
                for g in () if gs is None else gs:
                    gain[i, place[g["speaker"]]] += g["share"]
            out["speaker"] = [names[k] for k in best_path(gain, clip.start.to_numpy(), clip.end.to_numpy(), switch, pause)]
        return out

    paths = rows.groupBy(*by).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in (*by, "word_ord")) + ", speaker string")
    own = per_chunk.groupBy(*by, "word_ord", "speaker").agg(F.max(F.struct("share", (-F.col("chunk_ord")).alias("o"))).alias("m"))
    own = own.select(*by, "word_ord", "speaker", (-F.col("m.o")).alias("chunk_ord"))
    out = written(words.join(paths, [*by, "word_ord"], "left").join(own, [*by, "word_ord", "speaker"], "left"), "word-paths")
    lost = out.filter("chunk_ord IS NULL AND speaker IS NOT NULL").select(*by, "word_ord", "speaker", middle.alias("at"))
    near = nearest_interval(lost, intervals, F.col("at"), [*by, "speaker"], ["word_ord"]).select(*by, "word_ord", "near_ord")
    return out.join(near, [*by, "word_ord"], "left").withColumn("chunk_ord", F.coalesce("chunk_ord", "near_ord")).drop("near_ord")


def word_runs(labelled: DataFrame, by: Sequence[str], least_seconds: float = 2.0, least_words: int = 3) -> DataFrame:
    """(by, seg_ord, label, start, end, words): runs of words of a segment that sound like another speaker than the segment's."""
    w = Window.partitionBy(*by, "seg_ord").orderBy("start", "word_ord")
    new = (~F.lag("label").over(w).eqNullSafe(F.col("label"))).cast("int")
    runs = labelled.withColumn("_n", new).withColumn("_run", F.sum("_n").over(w)).groupBy(*by, "seg_ord", "_run").agg(
        F.first("label").alias("label"), F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("words"))
    return runs.filter((F.col("label") != F.col("speaker")) & (F.col("end") - F.col("start") >= least_seconds) & (F.col("words") >= least_words)).drop("_run")


def words_in_gaps(words: DataFrame, holes: DataFrame, by: Sequence[str], least: float = 0.06, most: float = 2.0, width: float = 5.0) -> DataFrame:
    """Words of plausible length whose middle lies in a gap (by, start, end)."""
    length = F.col("end") - F.col("start")
    usual = words.filter((length >= least) & (length <= most))
    return point_join(usual, holes, (F.col("start") + F.col("end")) / 2, by, width, prefix="gap_")


def best_cut(words: DataFrame, by: Sequence[str], vector: str = "embedding", least: int = 2) -> DataFrame:
    """(by, cut_after, sim): the word of a segment after which the mean vectors of both sides differ most, with enough words on each."""
    parts = words.select(*by, "word_ord", F.posexplode(vector).alias("pos", "x"))
    w = Window.partitionBy(*by, "pos").orderBy("word_ord")
    whole = Window.partitionBy(*by, "pos")
    sums = parts.withColumn("a", F.sum("x").over(w)).withColumn("b", F.sum("x").over(whole) - F.col("a")).withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(whole))
    at = sums.groupBy(*by, "word_ord").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.max("i").alias("i"), F.max("n").alias("n"))
    ok = at.filter((F.col("i") >= least) & (F.col("n") - F.col("i") >= least) & (F.col("aa") > 0) & (F.col("bb") > 0))
    sim = F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))
    return ok.groupBy(*by).agg(F.min(F.struct(sim.alias("sim"), "word_ord")).alias("m")).select(*by, F.col("m.word_ord").alias("cut_after"), "m.sim")

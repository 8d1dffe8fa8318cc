"""Functions for SQL: a table function over partitioned rows and an aggregate, registered under their names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ..session import ship


class SpeakerTurns:
    """Rows of a clip in order -> its turns: stretches of neighbouring segments of one speaker. Holds one turn at a time."""

    def __init__(self):
        self.turn, self.open = 0, None

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.open and self.open[1] == row["speaker"]:
            self.open[3] = max(self.open[3], row["end"])
            self.open[4] += 1
            return
        yield from self.terminate()
        self.turn += 1
        self.open = [row["clip_id"], row["speaker"], row["start"], row["end"], 1]

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            clip, speaker, start, end, n = self.open
            self.open = None
            yield clip, self.turn, speaker, start, end, n


def longest_pause(start: pd.Series, end: pd.Series) -> float:
    """The longest time without speech between a group's intervals; 0 if they leave none."""
    order = start.argsort(kind="stable")
    a, b = start.to_numpy()[order], end.to_numpy()[order]
    reach = pd.Series(b).cummax().to_numpy()
    return float(max([0.0, *(a[1:] - reach[:-1])]))


def register(spark: SparkSession) -> None:
    """speaker_turns(TABLE(t) PARTITION BY clip_id ORDER BY start) over (clip_id long, speaker, start, end), and longest_pause(start, end)."""
    ship(spark)
    turns = F.udtf(SpeakerTurns, returnType="clip_id bigint, turn int, speaker string, start double, end double, segments int")
    spark.udtf.register("speaker_turns", turns)
    spark.udf.register("longest_pause", F.pandas_udf(longest_pause, "double"))

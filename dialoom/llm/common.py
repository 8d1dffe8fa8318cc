"""Shared pieces: the word class, written intermediate tables, table readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, table_path, written

__all__ = ["WHITE_SPACE", "WORD", "free_name", "n_words", "read_table", "shared_folder", "table_path", "words_of", "written"]

#: Fixed value: a word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """Array of the words; null text gives an empty array."""
    split = F.split(F.coalesce(text, F.lit("")), WHITE_SPACE)
    return F.filter(split, lambda w: w != "")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the input does not use, so that extra columns never clash with internal ones."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted

"""A corpus pipeline over documents: each stage reads what the one before has written.

language_id    learns from the labelled rows and drops documents that it rejects as no known language
line_dedup     removes later repeated runs of lines of 50 words or more, and documents of which nothing else is left
near_dedup     keeps one document of each group of near duplicates (five words, similarity 0.8)
mix            repeats or leaves out documents so that sources reach their targets, in training order
encode         SentencePiece ids of each document, with its place in the training order

The mix's order is that of its files and of the rows in each. A reread deals files to tasks in another order, so the last stage
takes each row's place from the file it stands in.

Defined cases, in every stage: null and empty texts and texts without a letter go in the first one; null sources and ids are values
like others; repeated rows get equal decisions; very long texts are worked through whole; ties are broken by doc_id; empty tables
give empty tables; further columns of documents pass through until the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import language_id, line_dedup, minhash, mixing, sentencepiece_codec
from dialoom.llm.common import WORD, read_table, written


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier takes for one of the languages it has learned from these rows."""
    model = language_id.learn(docs)
    return language_id.identify(docs.select(F.struct("*").alias("row"), "text"), model).filter(~F.col("rejected")).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with repeated runs gone from their texts and n_chars counted again; a row of which nothing is left is a copy and goes."""
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[c for c in names if c not in ("doc_id", "text")]).alias("row"))
    short = line_dedup.dedup_lines(packed).filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD)).select("doc_id", "text", "row.*")
    return short.withColumn("n_chars", F.length("text").cast("long")).select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the smallest doc_id of each group."""
    return minhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, sorted by training position."""
    return mixing.training_order(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, same, place) for each row; ascending places are the order of the rows in docs' files."""
    return sentencepiece_codec.round_trip(docs.withColumn("place", place_in_files(docs)), sentencepiece_codec.load(), carried=["place"])


def place_in_files(docs: DataFrame) -> Column:
    """A number that rises from row to row and from file to file as Spark numbered them on writing; null where docs is no table of files."""
    try:
        name, row = docs.select("_metadata.file_name", "_metadata.row_index").columns
    except AnalysisException:
        return F.lit(None).cast("long")
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    task, file = (F.regexp_extract(name, pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)"))
    return F.shiftleft(task, 40) + F.shiftleft(file, 34) + row


STAGES = [
    ("language_id", drop_unknown_languages), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources), ("encode", encode_texts),
]

#: SQL can't express the learned classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

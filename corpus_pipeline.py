"""The corpus pipeline: documents through five operators of graphloom.llm, stage by stage.

Each stage takes (spark, docs, sf_dir), docs being what the stage before has written, and returns a DataFrame. All but
the last return the columns of documents, under their names, whatever these are; other columns of docs are kept. Models are
learned from the labelled rows of sf_dir's own tables, not from what a stage before has kept.

Null and blank texts: the quality classifier scores them by its bias alone, language ID rejects them (no letter).
Repeated rows pass or fail alike up to near-dedup, which leaves one. An empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import made, remove, shared_dir
from graphloom.llm import jaccard, langid, mixing, packing, quality
from graphloom.llm.common import read

#: A document stays if its score for quality is at least this, and its language's probability at least that.
MIN_QUALITY, MIN_LANGUAGE = 0.5, 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.train(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), quality.in_training(F.col("doc_id")))
    return quality.classify(spark, docs, model).where(F.col("quality_score") >= MIN_QUALITY).select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that was learned, with enough probability."""
    model = langid.train(read(spark, sf_dir, "documents"), langid.in_training(F.col("doc_id")))
    named = langid.identify(spark, docs, model)
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= MIN_LANGUAGE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more), that with the smallest id.

    SimHash's pigeonring filtering finds the closest, prefix filtering the rest; every link is checked on the whole texts.
    """
    return jaccard.keep_one(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as before, in expectation, with all sources alike: documents are repeated or left out by Poisson counts.

    A repeated document's rows are equal; each is packed as a document of its own.
    """
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens; sequence_id and offset tell the pieces of repeated documents apart."""
    return packing.pack(docs)


STAGES = [("quality classifier", keep_quality), ("language ID", keep_language), ("SimHash near-dedup", drop_near_copies), ("mixing sources", mix), ("packing", pack)]
ORACLE_SQL = None  # models and packing aren't SQL's


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again.

    What a stage has written besides is removed when its result is there, and its input with it.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        begun = len(made())
        result = stage(spark, docs, sf_dir)
        path = shared_dir(spark, name.replace(" ", "-"))
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        remove(*(x for x in made(begun) if x != path), *([before] if before else []))
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of five stages over `documents`, each on all that the one before has kept.

Classified quality, exact copies, near copies, the mix of sources, pieces. Every stage but the last returns the columns of
its input; run() writes what a stage returns as Parquet in the shared folder and reads it again as the next one's input.

All stages take nulls in any column, null and empty texts (alike throughout), very long texts (read whole), repeated rows,
further columns of any name (carried along as they are) and empty tables (an empty result); each says what it makes of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarf.llm import exact_dedup, mixing, quality_model, sentencepiece, simhash
from swarf.llm.common import read, remove, stage, unstage
from swarf.llm.queries import MODEL_FILE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier takes for good: a score of 0.3 or more.

    Null and empty texts have one score and go or stay together, as do repeated rows; without any labels all scores are 0.5 and
    all rows stay.
    """
    forest = quality_model.train(docs, read(spark, sf_dir, "labels"))
    return quality_model.classify(docs, forest).where("predicted = 1").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal ones: that of the longest original, then the smallest doc_id, null last.

    Null, empty and blank texts are one group; of repeated rows one stays.
    """
    return exact_dedup.exact_dedup(docs).where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose sets of five-word shingles are 0.8 alike or more: that of the smallest doc_id, null last.

    Null, empty and blank texts are one group; texts under five words are alike if their words are equal.
    """
    return simhash.similar_dedup(docs).where("kept").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null and empty texts weigh nothing and are taken at the rate of their source; a null source is a source of its own, and a
    source without words is not taken. Repeated rows are taken apart from each other.
    """
    return mixing.mix(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and its best segmentations with their scores; of a null or empty text the leading space alone."""
    return sentencepiece.encode(docs, MODEL_FILE)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tidy(k: int, function: Stage) -> Stage:
    """function as stage k, which first removes the tables that stages before it have staged for themselves.

    Their results are written and read again by then, so nothing reads those tables any more.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        left = context._swarf_left = getattr(context, "_swarf_left", {})
        for folder in [f for j in range(k) for f in left.pop(j, [])]:
            remove(spark, folder)
        before = set(getattr(context, "_swarf_staged", []))
        out = function(spark, docs, sf_dir)
        left.setdefault(k, []).extend(f for f in getattr(context, "_swarf_staged", []) if f not in before)
        return out

    return run_stage


STAGES = [(f.__name__, tidy(k, f)) for k, f in enumerate((quality, exact, near, mixed, pieces))]

#: SQL can't express the trees, the fingerprints and the lattice; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        after = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            after = stage(after, f"pipeline-{name}")
            if k:  # the result of the stage before, which this one has read
                unstage(docs)
        docs = after
    return docs

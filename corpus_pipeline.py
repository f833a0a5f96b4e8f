"""From raw documents to sampled piece ids: five stages, each a written table that the next one reads again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import save
from trailmark.llm.language_id import UNDETERMINED, identify, train
from trailmark.llm.line_dedup import line_dedup
from trailmark.llm.mixing import mix
from trailmark.llm.ngram_join import keep_one
from trailmark.llm.piece_sampling import sample_encode

#: A document goes if its language is undetermined or less probable than this: short and mixed texts of a known language stay.
MIN_SCORE = 0.3
#: Segmentations sampled of each document.
SAMPLES = 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, learnt from the rows of docs that aren't held out, tells with some certainty."""
    judged = identify(docs.select(F.struct("*").alias("_row"), F.col("text").alias("text")), train(docs))
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of maximal repeated line runs are cut out and n_chars counted anew; a document that loses all its lines goes."""
    cut = line_dedup(docs, whole=True)
    touched = F.size("_removed") > 0
    left = cut.where(~touched | (F.length("text") > 0))
    return left.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.75 and more join, the one of smallest id."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as the mix takes it."""
    return mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SAMPLES distinct segmentations of each document, with their scores. Copies of a document get the same."""
    return sample_encode(docs, SAMPLES)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("ngram_join", near_duplicates), ("source_mix", mixing), ("sample_pieces", pieces)]

#: Learnt languages and sampled pieces cannot be said in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

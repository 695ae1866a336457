"""From documents to token ids: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import exact_dedup, minhash, mixing, pieces, quality
from gradeloom.llm.common import materialise, table
from gradeloom.session import ship_package


#: Near copies share four fifths of their runs of five words or more. A pair at 80 % shares no band with
#: probability 3e-6; estimates deviate more than at op4's 85 %, so the margin is wider.
NEAR = minhash.Settings(similarity=80, rows=5, margin=0.08)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking, fitted on the labelled ones of the corpus, does not reject; null texts are empty ones."""
    ship_package(spark)
    ranker = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, ranker).where("predicted = 1").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies (null and empty texts are one): that of the largest id, nulls lowest."""
    return exact_dedup.exact_dedup(docs).where("kept").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; those without words or id all stay."""
    ship_package(spark)
    gone = minhash.near_components(docs, NEAR).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (none to twice), by output shard, shuffled within it; a null source is one."""
    return mixing.mix(docs).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row; none for a null or empty text."""
    ship_package(spark)
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.load())
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("source mixing", mix_stage),
    ("SentencePiece encoding", pieces_stage),
]

#: The ranking and the hashed draw have no SQL; a test holds run()'s rows against plain versions of the
#: stages, the draw against its targets and bounds.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs

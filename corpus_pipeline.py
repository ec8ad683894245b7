"""From raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  Between stages the rows are written as
Parquet and read again.

In all stages a null text counts as an empty one, further columns are kept
whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join, packing, quality, suffix_dedup, toxicity
from plumbline.llm._text import column
from plumbline.llm.queries import TOKENIZER
from plumbline.storage import shared_dir


def _own(docs: DataFrame) -> str:
    """What goes before the columns that a stage adds for its own use: no column of the documents begins so, however it is spelled."""
    prefix = "__stage_"
    while any(c.casefold().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below its threshold; repeated rows stay or go together."""
    own = _own(docs)
    return toxicity.score(docs, _labels(spark, sf_dir), prefix=own).filter(f"{own}predicted = 0").select(*map(column, docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches its threshold; repeated rows stay or go together."""
    own = _own(docs)
    return quality.score(docs, _labels(spark, sf_dir), prefix=own).filter(f"{own}predicted = 1").select(*map(column, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id (null last; of one id the least hash of the text).

    A class is a chain of links: a text may go that is near to another that
    goes, and not to the one that stays.  Rows that repeat id and text are one;
    texts without words stay.
    """
    return jaccard_join.keep_first(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that an earlier text holds; n_chars follows.  A null text stays null; rows that repeat id and text are one document listed twice."""
    own = _own(docs)
    cut = suffix_dedup.deduplicate(docs, prefix=own)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(f"{own}n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return cut.select(*map(column, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens; each row is packed for itself, one without text as its end id."""
    return packing.pack(docs, TOKENIZER, capacity=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", drop_repeats),
    ("best-fit packing", pack),
]

#: The classifiers' fits and the tokenizer are beyond SQL; tests/llm holds each stage against a brute-force version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = shared_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

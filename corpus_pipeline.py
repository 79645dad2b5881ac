"""A training corpus from raw documents: stages that each take what the one before kept.

Filtering stages return the rows they keep as they came, with all columns: a
column may have the name of a result. Null and empty texts have score and
counts of their own in the first two stages and fail the second's base rules.
Very long texts are judged whole. Repeated rows pass or fail together until the near-duplicates,
where one row of a group stays: the smallest id (nulls last), then the smallest
hash of the text. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import bpe, minhash, mixing, pretokens, quality, toxicity
from siltbed.llm.scratch import cleared, materialize


def packed(docs: DataFrame) -> DataFrame:
    """The text, and each row whole as one column, which no result can overwrite."""
    return docs.select("text", F.struct(*docs.columns).alias("document"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows outside its held-out third, doesn't reject."""
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.classify(packed(docs), model, keep=["document"]).filter("predicted = 0").select("document.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return quality.apply_rules(packed(docs)).filter("kept").select("document.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.drop_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, once for each time it takes them."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, pretokens.default_path(), keep=["doc_id", "source"], with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-pair encoding", tokenize),
]

#: The classifier's verdicts can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is stored before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with cleared(spark) as scope:
            docs = scope.keep(materialize(stage(spark, docs, sf_dir), f"stage-{k}"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline over ``documents``: toxicity, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet in the
shared checkpoint folder and reads it again for the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import ensure_checkpoint_dir, read_table
from quadrille.llm.jaccard_join import jaccard_components
from quadrille.llm.packing import pack
from quadrille.llm.suffix_dedup import clean_texts
from quadrille.llm.toxicity import keep_clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It is fitted on the stage's own input. Null and empty texts are scored
    like texts without a known word; without labelled rows of both classes, or on an empty table, nothing is rejected."""
    return keep_clean(docs, train(docs, read_table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, with all rows that have this id; an id goes if
    all its rows are copies of others. Documents
    without words (null, empty) are in no group and stay; rows without an id stay; an empty table stays empty."""
    groups = jaccard_components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("component_id").alias("component_id"))
    gone = groups.where("doc_id != component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur more than once; documents of which nothing but white space is left go.
    Null texts stay null, empty and short ones stay as they are; of equal documents of 200 bytes or more none keeps its text."""
    return clean_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places; a null or empty text is one id, an empty table no row."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", jaccard_join), ("suffix-array dedup", suffix_dedup), ("best-fit packing", packing)]

#: No SQL expresses the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
    return docs

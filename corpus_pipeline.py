"""The corpus pipeline: documents to a mixed, sharded training set, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Null
and empty texts are rejected by the first stage as of no language; repeated rows are one document to the second stage
and may come again from the fourth, which is what a mix means; an empty table passes through all stages. Further
columns of docs are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.decontamination import clean
from tidepool.llm.language import UNDETERMINED, identify_languages
from tidepool.llm.mixing import mixed
from tidepool.llm.sharding import sharded
from tidepool.llm.simhash import deduplicated
from tidepool.llm.tables import dropped, place, stored, table

#: Texts whose best language scores below this are rejected. The best of k languages scores 1/k at least, so this takes ten.
LEAST_SCORE = 0.1
#: Texts that have less than this overlap with every landmark are of no learned language. Held-out documents of sf0.1
#: have 0.49 at least; texts in other scripts and of random letters 0.34 at most.
LEAST_OVERLAP = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that was learned, with lang set to it."""
    out = identify_languages(docs, kept=tuple(docs.columns), made=("__lang", "__score", "__overlap"))
    kept = out.where((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= LEAST_SCORE) & (F.col("__overlap") >= LEAST_OVERLAP))
    return kept.withColumn("lang", F.col("__lang")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark windows."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, 0 to 39."""
    return sharded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: SQL has neither the classifier, nor components, nor draws of hashes: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored in the shared folder before the next reads it; what no stage needs any more goes."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return docs
        at = place(spark)
        docs = stored(docs, at)
        if before:
            dropped(spark, before)
        before = at
    return docs

"""A corpus pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.

Defined results: null or empty text is scored by the classifier as a text without words; what of it is
kept has an empty set, links with nothing, is never a hit, has size 0 and so is not taken by the
mix. Rows whose doc_id is null stay apart unless their texts are near copies; repeated rows are copies
of each other, of which one stays. An empty table passes every stage as one, and the last writes a
manifest without shards. Columns beyond doc_id, text and source are carried and not read, whatever
their names, but for n_chars, which follows a text that the mix cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readlake.llm import decontaminate, jaccard, mixing, quality_classifier, token_output
from readlake.llm.common import scratch_path


def _classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, quality_classifier.labels_of(spark, sf_dir))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, k=5, percent=80)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.materialise_order(docs)


STAGES = [
    ("quality classifier", _classify),
    ("n-gram Jaccard join", _near_duplicates),
    ("benchmark decontamination", _decontaminate),
    ("mixing to target weights", _mix),
    ("token-ID output", _tokens),
]

#: Stages that learn a model or compare sets have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs

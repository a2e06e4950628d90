"""From raw documents to shards of a training corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its
predecessor kept, written as Parquet and read again.  All but the last return the columns
of ``documents``.

In every stage a null text counts as an empty one, rows that are repeated are rows of
their own unless a stage says otherwise, texts of any length are read whole, an empty
table gives an empty table, and columns besides doc_id, text, source and n_chars pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import decontaminate, mixing, near_dedup, quality, shards
from rankloom.llm.store import drop, fresh, kept, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels, rejects go.  Empty texts are scored like all others; without labels all stay."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Linked are five-word shingle sets with a similarity of 0.8 or more, the preset of the
    operator; the query op5 links at the 0.85 of its contract.  Texts without words link
    with nothing and stay; of rows with one id the first by text stays; rows without an
    id stay.
    """
    return near_dedup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word window of a benchmark item go.  Texts without words have none and stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a row for each time a document, or a stretch of it, is taken.  Texts without words go; null is a source of its own."""
    return mixing.Mix(docs).applied(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in target-sized shards under a committed manifest, with each row's shard: a column shard, with underscores behind it where the rows have one."""
    return shards.shard_documents(docs, fresh(spark, "shards")).read(shard="shard")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Fitted rules, sketches and pseudorandom draws are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        left = stage(spark, docs, sf_dir)
        docs = kept(left, name.replace(" ", "-"))
        drop(left, last)
        last = docs
    return docs

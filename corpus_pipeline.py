"""The training-data pipeline: toxicity, near-duplicates, decontamination, mixing, token-id output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next stage's docs. All but the last return the columns of ``documents``.

Null and empty texts pass the first three stages unless equal to one another, and stay once in the mix. Null ids pass
like others; of repeated rows one stays; an empty table passes all stages; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common
from tidemark.llm.bagminhash import drop_copies
from tidemark.llm.decontaminate import drop_leaks
from tidemark.llm.source_mix import mixed_documents
from tidemark.llm.token_shards import token_table
from tidemark.llm.toxicity import drop_toxic, held_out, train

WEIGHTS = [1, 2, 3]
_left: list[str] = []


def _own_scratch(stage):
    """When a stage begins, its predecessor's result has been written: its scratch tables can go."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            common.delete_path(spark, _left.pop())
        had = set(common._SCRATCH)
        out = stage(spark, docs, sf_dir)
        _left[:] = [p for p in common._SCRATCH if p not in had]
        common._SCRATCH[:] = [p for p in common._SCRATCH if p in had]
        return out

    run.__doc__ = stage.__doc__
    return run


@_own_scratch
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, *train(docs, labels, learn=lambda k: ~held_out(k)))


@_own_scratch
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one of the least doc_id."""
    return drop_copies(docs)


@_own_scratch
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_own_scratch
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them."""
    return mixed_documents(docs, WEIGHTS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted-string-table shards; a row for each stored document, read back from them.

    The shards are the product, and the returned rows are read from them when asked for: they stay.
    """
    while _left:
        common.delete_path(spark, _left.pop())
    return token_table(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Scores, signatures and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = common.scratch(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

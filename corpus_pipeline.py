"""The corpus pipeline: toxicity, near duplicates, contamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps
with their columns; ``run`` writes every stage as Parquet into the folder
that the executors share and reads it again as the next one's input.  The
last stage adds the column ``shard``.  A stage starts when the output of the
one before is written, so it first drops the tables that one stored on its way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm import decontaminate, hyperminhash, mixing, sharding, toxicity
from reelgrid.llm.base import STORED, drop, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_passed: list[str] = []


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _passed:
            drop(spark, _passed.pop())
        before = len(STORED)
        out = f(spark, docs, sf_dir)
        _passed.extend(STORED[before:])
        return out

    return run


@_stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; the model is fitted on labelled rows of these documents."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return hyperminhash.drop_duplicates(docs)


@_stage
def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken by the mixture, repeated for each epoch."""
    return mixing.mixed(docs)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of their shard."""
    return sharding.sharded(docs)


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("decontamination", contaminated), ("mixing", mix), ("sharding", shard)]

#: Neither the classifier nor the suffix arrays can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

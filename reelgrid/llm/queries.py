"""The queries of this folder, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm import decontaminate, hyperminhash, langid, mixing, oracles, sharding, spotsigs, suffixes, toxicity, urlrules, windows
from reelgrid.llm.base import table


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal intervals of text that occurs again, by suffix sorting."""
    return suffixes.intervals(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture, once an epoch."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected documents with their probability."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.rejected(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its tokens and shard."""
    return sharding.shards(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest verbatim match of every affected document and benchmark item."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to remove as near duplicates and the one that stays for each."""
    return hyperminhash.duplicates(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal intervals of windows of 50 tokens that occur more than once."""
    return windows.intervals(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the rules that its URL fires."""
    pages = table(spark, sf_dir, "pages")
    return urlrules.decisions(pages, urlrules.mine(pages, table(spark, sf_dir, "labels")))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with similar signature sets."""
    return spotsigs.groups(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


_ALL = (op1_suffix_array, op2_mixing, op3_toxicity, op4_sharding, op5_decontamination, op6_near_duplicates, op7_substring_dedup, op8_url_rules, op9_spotsigs, op10_language_id)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "op1_suffix_array": oracles.op7(),
    "op2_mixing": mixing.oracle(),
    "op5_decontamination": oracles.op5(),
    "op6_near_duplicates": oracles.op6(),
    "op7_substring_dedup": oracles.op7(),
    "op9_spotsigs": oracles.op9(),
}

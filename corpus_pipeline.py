"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last keeps the columns of documents, whatever their names. A stage returns rows that it has written to
the shared folder; the tables it kept aside on the way are gone by then. Its rows stay until the next stage has written
its own, or to the end of the program. Part of subpackage ``llm``.

Cases, for all stages: null in any column, empty texts, repeated rows and ids, and empty tables (which give empty ones).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm import bpe, exact_dedup, jaccard_join, mixing, quality_rules
from rankforge.llm.common import documents, drop_kept_aside, kept_aside, materialize


_written: list[str] = []  # by the last stage


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        had = set(kept_aside())
        own = f(spark, docs, sf_dir)
        aside = [p for p in kept_aside() if p not in had]
        out = materialize(own)
        drop_kept_aside(spark, aside + _written)
        _written[:] = [p for p in kept_aside() if p not in had]
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose posterior probability of good is 0.5 or more. Null and empty texts go, having fewer than 50 words; rows alike share a fate."""
    return quality_rules.filter_docs(docs)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts that are equal but for white space: most code points, then smallest id, null last. Null counts as empty; all empty texts are one class."""
    return exact_dedup.one_of_each(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of sets of five-word shingles that are 80 % alike: smallest id, null last. Texts without words link with nothing and stay; rows alike in id and text are one."""
    return jaccard_join.one_of_each(docs, n=5, percent=80)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document 0 to 2 times, as its source's target asks for; a null source is a source. Texts without words go; rows alike share what they get."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each row; a null text has no ids."""
    return bpe.encode_decode(docs).drop("decoded")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("source mixing", mix), ("byte-level BPE", encode)]
#: SQL can express neither the components nor the encoding; tests/llm checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, f in STAGES:
        docs = f(spark, docs, sf_dir)
    return docs

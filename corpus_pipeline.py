"""The training-corpus pipeline: five stages from raw documents to packed batches.

Defined results of every stage: null text counts as empty; texts are read whole,
whatever their length; null doc_ids are treated like others and sort last; an
empty table gives an empty one; further columns, of any name, are handed on
unchanged, but for the last stage, which returns its own. Ties, repeated rows and
texts without words are told with each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import exact_dedup, packing, quality, secret_scan, similar
from driftloom.llm import runtime as rt
from driftloom.llm.queries import ranks_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go.

    Texts of fewer than 20 words, empty ones among them, always do; repeated rows
    are judged alike; a posterior of exactly 0.5 stays.
    """
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space stays.

    The longest text stays, then the smallest doc_id; of rows equal in both, any
    one. Texts without words are one group.
    """
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: five-word shingles, similarity of 0.8 or more.

    The smallest doc_id stays; of rows equal in it, any one. Repeated rows are
    copies of each other; texts without words are one component.
    """
    return similar.drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes.

    Texts without secrets stay as they are; of overlapping secrets all is masked;
    repeated rows are masked each.
    """
    return secret_scan.redact(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of all remaining documents.

    Texts without tokens are packed too; those above the budget fill a batch
    alone; of cuts with equal padding the one with the earlier boundary is taken;
    repeated rows are packed each.
    """
    return packing.pack(docs, ranks_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("batches", batches),
]

#: The stages learn by expectation maximisation, hash by XXH64, segment by dynamic programming and
#: tokenise, which SQL cannot express; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with rt.passing():
            docs = rt.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality rules, toxicity, near duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor
kept; all but the last return the columns of ``documents``.  ``run`` writes
each stage's result as Parquet in the shared folder and reads it back.

Defined cases, the same in every stage: an empty table gives an empty one; other
columns are kept, whatever their names (the last stage returns pieces); repeated
rows are judged each, and are copies in the third stage; a null id is kept or
rejected by its text like any other and never learned from.  A null or empty text
fails the quality rules (too few words); the later stages, given one, keep it:
it has the classifier's score without any word, no copies, no benchmark passage,
and packs as its end token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import decontaminate, ngram_join, packing, quality, queries, toxicity
from spendlens.llm.common import materialize, prepare, read_table

#: the stages train a classifier and prune by estimates, which SQL cannot express
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of the default policy fails go."""
    prepare(spark)
    judged, kept = quality.with_verdict(docs, quality.POLICIES[quality.DEFAULT_POLICY])
    return judged.where(F.col(kept)).drop(kept)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is trained on the stage's own documents."""
    prepare(spark)
    score = toxicity.score_documents(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(score < toxicity.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays."""
    prepare(spark)
    return ngram_join.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents kept, packed."""
    prepare(spark)
    return queries.packed(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

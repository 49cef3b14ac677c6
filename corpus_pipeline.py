"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns the columns of ``docs``, the last one pieces of sequences. ``run``
writes each stage as Parquet in the shared folder and reads it again, so a lost
executor costs at most one stage.

Null and empty texts fail the first stage's rules. Rows without doc_id are rows
like any other. Repeated rows and texts are one after the third stage. Very long
texts pass whole through all stages. Other columns, whatever their names, come
back unchanged from all stages but the last, which returns pieces of sequences.
Of an empty table every stage keeps none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, langid, neardup, packing, quality
from millrace.llm.common import named, shared_dir
from millrace.llm.queries import PACK_TOKENIZER

#: Below this no language is more likely than all others together.
MIN_LANGUAGE_SCORE = 0.5


def kept(judged: DataFrame, columns: list[str], test: str) -> DataFrame:
    """``columns`` of the rows whose last column, the operator's verdict, passes ``test``."""
    return judged.filter(test.format(f"`{judged.columns[-1]}`")).select(*named(columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the log-likelihood ratio reject go."""
    weights = quality.log_ratios(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept(quality.judge_quality(docs, weights), docs.columns, "{0}.kept")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language, or in none for sure, go."""
    return kept(langid.predict_languages(docs, langid.fit(docs)), docs.columns, f"{{0}}.lang_pred <> 'und' and {{0}}.score >= {MIN_LANGUAGE_SCORE}")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8) stays."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return kept(decontam.mark_contamination(docs, benchmark), docs.columns, "not {0}.contaminated")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, PACK_TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: No stage but the fourth can be told in SQL without the engine's hash; see tests/llm for brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs

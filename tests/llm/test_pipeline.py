"""The pipeline's stages on a small table: what goes, what stays, and what columns come out."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("millrace.llm")
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        assert out.exceptAll(docs).count() == 0
        counts.append(out.count())
        docs = out
    assert all(a >= b > 0 for a, b in zip(counts, counts[1:])) and counts[1] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0

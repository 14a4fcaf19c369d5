"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from netloom.llm import piece_sampling
from tests.compare import FOLDER
from tests.llm import plain
from tests.llm.test_brute_force import holds, template

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark: SparkSession) -> None:
    rows = {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    before = len(rows)
    refused = {k for k, (_, far) in plain.languages(list(rows.values())).items() if far}
    rows = {k: r for k, r in rows.items() if k not in refused}
    groups = plain.near_groups({k: r["text"] for k, r in rows.items()})
    rows = {k: r for k, r in rows.items() if groups[k] == k}
    items = [template(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = {k: r for k, r in rows.items() if not any(holds(item, template(r["text"] or "")) for item in items)}
    found = corpus_pipeline.run(spark, FOLDER)
    texts = {r["doc_id"]: r["text"] for r in piece_sampling.decoded(found).collect()}
    assert texts == {k: plain.redacted(r["text"]) for k, r in rows.items()}
    assert 0 < len(texts) < before


def test_stages_give_the_columns_of_documents(spark: SparkSession) -> None:
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, FOLDER)
        assert [f.dataType for f in docs_out.select(*docs.columns).schema] == [f.dataType for f in docs.schema]
        assert set(docs_out.columns) == set(docs.columns)

"""From raw documents to training pieces, in five stages.

Each stage takes the documents that its predecessor kept and gives them on with
the same columns; the last gives the pieces of each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import decontamination, language_id, minhash_join, piece_sampling, secret_links
from netloom.llm.lineage import shared_folder


#: Rows of a batch that goes to a Python worker. Texts are long, and workers and
#: buffers of one stage keep their memory beside those of the next.
BATCH_ROWS = 2000


def _bounded(spark: SparkSession) -> None:
    """Sets the session's batches to ``BATCH_ROWS`` at most; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:  # 0 is no bound
        spark.conf.set(name, str(BATCH_ROWS))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go."""
    _bounded(spark)
    return language_id.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the lowest id stays."""
    _bounded(spark)
    return minhash_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _bounded(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced."""
    _bounded(spark)
    return secret_links.redacted(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become sampled pieces, from which they can be decoded."""
    _bounded(spark)
    return piece_sampling.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("piece_sampling", sample_pieces),
]

#: Language models and sampling have no SQL form; tests compare to a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written to the
    shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

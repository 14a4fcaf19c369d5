"""Cutting lineage in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's spark.checkpoint.dir; where it
    is unset (a local session), a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder, so that a lost executor costs no
    recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``cut`` for many rows: in compressed columns, a fraction of a checkpoint's bytes."""
    place = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def cut_narrow(df: DataFrame, partition_rows: int = 50_000) -> DataFrame:
    """``cut`` for rows of a few numbers: read again in partitions of about
    ``partition_rows`` rows, 8 at least, where there are many more than that."""
    out = cut(df)
    fitting = max(8, -(-out.count() // partition_rows))
    return out.coalesce(fitting) if out.rdd.getNumPartitions() > 2 * fitting else out


def without_ids(docs: DataFrame, ids: DataFrame, key: str, broadcast_rows: int = 200_000) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in ``ids``; see ``with_ids``."""
    return docs.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, key, "left_anti")


def with_ids(docs: DataFrame, ids: DataFrame, key: str, broadcast_rows: int = 200_000) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``ids``. Up to ``broadcast_rows`` ids
    are sent to every executor, so that no text is shuffled; more are joined by a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, key, "left_semi")

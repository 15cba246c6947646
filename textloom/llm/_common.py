"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows (of few, narrow columns).
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none (tests on one machine) a temporary folder is
    set; on a cluster that would not be shared, so there it is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if found:
        return found.rstrip("/")
    master = sc.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage, survives lost executors, and lets what follows read
    only the columns it needs. The folder belongs to the session's owner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``rows`` is within ``limit``; beyond it Spark joins by shuffling."""
    return F.broadcast(df) if rows <= limit else df


def only(df: DataFrame, *needed: str) -> DataFrame:
    """The named columns alone, so that extra columns can clash with nothing."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    return df.select(*[F.col(f"`{c}`") for c in needed])

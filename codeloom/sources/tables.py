"""Stored tables in the folder that the session names for shared files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_made: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of this process in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _made.setdefault(("", "dir"), "file://" + tempfile.mkdtemp(prefix="codeloom-graph-"))
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, so that later jobs do not repeat what made it."""
    path = f"{shared_dir(df.sparkSession)}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most rows of a table that every task gets whole, and most ids of a list of ids alone; larger ones are joined by a shuffle.
SMALL, SMALL_IDS = 500_000, 1_000_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A stored table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def stored(spark: SparkSession, key: str, make) -> DataFrame:
    """The table that make() gives, written once a session and key, and read from there on."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _made:
        path = f"{shared_dir(spark)}/graph/{uuid.uuid4().hex}"
        make().write.parquet(path)
        _made[at] = path
    return spark.read.parquet(_made[at])

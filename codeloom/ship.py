"""Sends the package to the executors, which need not share the driver's folders."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package, as an archive, to the Python path of the session's executors, once."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="codeloom-"), "codeloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _sent.add(context.applicationId)


def shipped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f(spark, ...), after ship(spark)."""
    @functools.wraps(f)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        ship(spark)
        return f(spark, *args, **kwargs)

    return run

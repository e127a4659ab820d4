"""Helpers shared by the operators: shared-folder tables, heavy keys, neighbours, components.

Tables between jobs lie in <spark.checkpoint.dir>/codeloom/<application id>. What a
returned DataFrame does not read is deleted when its operator returns; clean() deletes
the rest once the results have been written.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A key is heavy from this share of the rows on, so at most 1/HEAVY_SHARE keys are heavy.
HEAVY_SHARE = 1 / 1024
#: Parts that the rows of one heavy key are dealt to.
HEAVY_PARTS = 64
#: Rows of whole texts that a function in Python works on at once.
FEW_ROWS = 512

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a folder of this process in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own_dir.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="codeloom-"))
    return found.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/codeloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{own_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this application's operators have left; their results must have been written elsewhere."""
    _delete(spark, own_folder(spark))


def cut(df: DataFrame, kind: str) -> DataFrame:
    """df, written to the shared folder and read back: later jobs neither repeat it nor lose it with an executor."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._codeloom_path = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Deletes what cut() wrote for df, once nothing reads it any more."""
    if path := getattr(df, "_codeloom_path", None):
        _delete(df.sparkSession, path)


class Scratch:
    """Tables of one computation: ``with Scratch() as s`` deletes those made by s.cut() at its end, but not those given to s.keep()."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for df in self.made:
            drop_cut(df)

    def cut(self, df: DataFrame, kind: str) -> DataFrame:
        self.made.append(cut(df, kind))
        return self.made[-1]

    def keep(self, df: DataFrame) -> DataFrame:
        self.made = [x for x in self.made if x is not df]
        return df

    def drop(self, df: DataFrame) -> None:
        drop_cut(self.keep(df))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows that jobs started inside pass to Python at once, at most; a DataFrame made inside and run later is not bound by it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = FEW_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most, for functions whose job starts after arrow_rows() has ended."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def heavy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that hold more than HEAVY_SHARE of df's rows: at most 1/HEAVY_SHARE rows, so they may be broadcast."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    least = max(1000.0, df.count() * HEAVY_SHARE)
    rows = counts.where(F.col("_n") > least).select(*keys).limit(int(1 / HEAVY_SHARE) + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.select(*keys).schema)


def heavy_of(counts: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """heavy() of counts(keys, n), of a table of so many rows."""
    found = counts.where(F.col("n") > max(1000.0, rows * HEAVY_SHARE)).select(*keys).limit(int(1 / HEAVY_SHARE) + 1).collect()
    return counts.sparkSession.createDataFrame(found, counts.select(*keys).schema)


def salted_join(many: DataFrame, few: DataFrame, keys: Sequence[str], by: str, how: str = "inner", counted: DataFrame | None = None, hot: DataFrame | None = None, merge: bool = False) -> DataFrame:
    """many joined with few on keys, where few has one row a key and many may have a third of all rows under one key.

    Rows of many with a heavy key are dealt to HEAVY_PARTS parts by a hash of the
    column ``by``; the row of few is repeated once a part. many should be a table, or
    counted one with the same keys (it is read once more, for their counts), unless hot
    gives the heavy keys. merge: both are shuffled at every size.
    """
    keys = list(keys)
    hot = F.broadcast((heavy(many if counted is None else counted, keys) if hot is None else hot).withColumn("_hot", F.lit(True)))
    left = many.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(HEAVY_PARTS))).otherwise(F.lit(0)).cast("int")
    ).drop("_hot")
    right = few.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HEAVY_PARTS - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return (left.hint("merge") if merge else left).join(right, [*keys, "_salt"], how).drop("_salt")


def ranges(df: DataFrame, key: str, rows_each: int = 4096) -> list[int]:
    """Ascending split points of an integer key that deal df into ranges of about rows_each rows."""
    n = df.where(F.col(key).isNotNull()).count()
    want = min(max(1, n // rows_each), 20_000)
    if want < 2:
        return []
    qs = [i / want for i in range(1, want)]
    got = df.select(F.percentile_approx(key, F.array(*[F.lit(q) for q in qs]), F.lit(20 * want)).alias("q")).head()["q"]
    return sorted(set(got or []))


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the undirected graph with edges links(a, b); comp is the component's smallest node.

    Labels fall to the smallest of the neighbours' labels, and each node then
    takes the label of its label (pointer jumping), until nothing changes; stars
    need two or three rounds. Each round is a table in the shared folder.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut(both, "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("_near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("_old"), F.least("comp", "_near").alias("_at"))
        jump = labels.select(F.col("node").alias("_at"), F.col("comp").alias("_to"))
        step = step.join(jump, "_at", "left").select("node", F.least("_at", F.coalesce("_to", "_at")).alias("comp"), (F.least("_at", F.coalesce("_to", "_at")) != F.col("_old")).alias("_moved"))
        done = cut(step, "labels")
        moved = done.where("_moved").limit(1).count()
        drop_cut(labels)
        labels = done.select("node", "comp")
        labels._codeloom_path = done._codeloom_path
        if not moved:
            drop_cut(both)
            return labels

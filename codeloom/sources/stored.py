"""Graph tables in a folder, replaced a source at a time and all at once.

A write adds parts, a folder a table and build, and then one file of the table
manifest, which says for each table and source which build counts and what its rows add up
to. Readers take the last run of the manifest, so what a lost write leaves behind is never
read, and the graph before it stays whole. Sources whose rows did not change keep their build.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.sources.tables import cut

MANIFEST = "run long, token string, table string, source_name string, build string, sum string, schema string"
#: Rows of a source that one file holds, about.
FILE_ROWS = 2_000_000


def _sum() -> list[Column]:
    """Of the rows of a group, in any order: how many there are, and the sum of their hashes."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")).alias("s")]


def sums(df: DataFrame) -> dict[str, str]:
    """What the rows of each source add up to: a row a source."""
    return {r["source_name"]: f"{r['n']}:{r['s']}" for r in df.groupBy("source_name").agg(*_sum()).collect()}


class Stored:
    """The graph tables of a folder: names of tables, each with a column source_name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> list:
        """The rows of the last run, one a table and source; none in a new folder. Of two writers of one run, that of the smaller token counts."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        last = rows.agg(F.max(F.struct("run")).alias("r")).head()["r"]
        if last is None:
            return []
        found = rows.where(F.col("run") == last["run"]).collect()
        token = min(r["token"] for r in found)
        return [r for r in found if r["token"] == token]

    def read(self, table: str) -> DataFrame:
        """A table; an error where it has never been written."""
        rows = [r for r in self.manifest() if r["table"] == table]
        if not rows:
            raise ValueError(f"no table {table} in {self.folder}")
        builds: dict[str, list[str]] = {}
        for r in rows:
            if r["source_name"] is not None:
                builds.setdefault(r["build"], []).append(r["source_name"])
        if not builds:
            return self.spark.createDataFrame([], rows[0]["schema"])
        parts = [self._part(table, b, rows[0]["schema"]).where(F.col("source_name").isin(names)) for b, names in builds.items()]
        return reduce(DataFrame.unionByName, parts)

    def _part(self, table: str, build: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/data/{table}/build={build}")

    def write(self, tables: dict[str, DataFrame], known: dict[str, dict[str, str]] | None = None) -> None:
        """Makes the given tables those of the folder. known: what the rows of each source of a table add up to, where the caller has that already."""
        before = self.manifest()
        build, rows = "b" + uuid.uuid4().hex, []
        run, token = max((r["run"] for r in before), default=0) + 1, uuid.uuid4().hex
        for table, df in tables.items():
            names = [c for c in df.columns if c != "source_name"]
            df = df.select(*names, "source_name")
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
            now = (known or {}).get(table)
            if now is None and not any(r["table"] == table and r["source_name"] is not None for r in before):
                # Nothing to compare with: rows are written once, and counted where they are written.
                now = {}
                if not df.isEmpty():
                    self._add(df, table, build, None)
                    now = sums(self._part(table, build, schema))
                rows += [(run, token, table, n, build, s, schema) for n, s in now.items()] or [(run, token, table, None, build, "", schema)]
                continue
            if now is None:
                df = cut(df)
                now = sums(df)
            same = {r["source_name"]: r["build"] for r in before if r["table"] == table and r["schema"] == schema and now.get(r["source_name"]) == r["sum"] and r["source_name"] is not None}
            changed = [n for n in now if n not in same]
            if changed:
                self._add(df.where(F.col("source_name").isin(changed)) if same else df, table, build, {n: int(s.split(":")[0]) for n, s in now.items() if n in changed})
            rows += [(run, token, table, n, same.get(n, build), s, schema) for n, s in now.items()] or [(run, token, table, None, build, "", schema)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        if any(r["token"] != token for r in self.manifest()[:1]):
            raise RuntimeError(f"another writer has replaced the tables of {self.folder} meanwhile")

    def _add(self, df: DataFrame, table: str, build: str, counts: dict[str, int] | None) -> None:
        """Writes a part, without moving its rows, or with counts a file for each source and FILE_ROWS of its rows: what changed may be little of a large table."""
        if counts is None:
            df.write.option("compression", "zstd").parquet(f"{self.folder}/data/{table}/build={build}")
            return
        files = self.spark.createDataFrame([(n, 1 + c // FILE_ROWS) for n, c in counts.items()], "source_name string, _files int")
        dealt = df.join(files, "source_name").withColumn("_file", F.pmod(F.xxhash64(*[c for c in df.columns if c.endswith("_id") or c == "name"]), F.col("_files")))
        dealt = dealt.repartition("source_name", "_file").select(*df.columns)
        dealt.write.option("compression", "zstd").parquet(f"{self.folder}/data/{table}/build={build}")

    def tables(self) -> Sequence[str]:
        return sorted({r["table"] for r in self.manifest()})

    def vacuum(self) -> int:
        """Deletes the builds that no source of the last run counts; how many. No one may read an earlier run any more."""
        used, gone = {(r["table"], r["build"]) for r in self.manifest()}, 0
        for table in self.tables():
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/{table}")
            files = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
            for status in files.listStatus(at) if files.exists(at) else []:
                if (table, status.getPath().getName().removeprefix("build=")) not in used:
                    files.delete(status.getPath(), True)
                    gone += 1
        return gone

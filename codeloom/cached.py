"""Cached builds: a source is scanned again only if its files, its folder or the scanners changed; names are resolved over all sources every time.

A folder holds the tables snapshot, entities, edges and issues, a subfolder a build, and the
table state: which build of each source counts. A build only adds, state last, so one
that is lost on the way leaves the folder as it was. state has a row a source and run.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.api import CODE, Graph, assembled, files_of
from codeloom.operators import incremental
from codeloom.sources.stored import Stored
from codeloom.sources.tables import cut

TABLES = ["snapshot", "entities", "edges", "issues"]
STATE = "run long, source_name string, build string, path string, parser string"


@dataclass
class Refresh:
    """A graph, the status of each source (comparison() of the snapshots), and the names of those that changed and that were scanned."""

    graph: Graph
    status: DataFrame
    changed: list[str]
    scanned: list[str]


class Cache:
    def __init__(self, spark: SparkSession, folder: str, parser: str = incremental.fingerprint(["facts", "lines", "sql", *CODE])):
        self.spark, self.folder, self.parser = spark, folder.rstrip("/"), parser

    def _read(self, *paths: str, schema: str | None = None) -> DataFrame | None:
        """The tables at paths; None where one is missing."""
        try:
            return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*paths)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def state(self) -> DataFrame:
        """The builds that count: those of the last run; none in a new folder."""
        rows = self._read(f"{self.folder}/state", schema=STATE)
        if rows is None:
            return self.spark.createDataFrame([], STATE)
        return rows.join(F.broadcast(rows.agg(F.max("run").alias("run"))), "run", "left_semi")

    def table(self, name: str) -> DataFrame | None:
        """A table's rows of the builds that count, as far as they are there; None if none is. Builds are at most as many as sources."""
        builds = self.state().select("source_name", "build")
        paths = [f"{self.folder}/{name}/{r['build']}" for r in builds.select("build").distinct().collect()]
        found = [p for p in paths if self._read(p) is not None]
        if not found:
            return None
        return self._read(*found).join(F.broadcast(builds), ["source_name", "build"], "left_semi").drop("build")

    def complete(self) -> list[str]:
        """The sources of which every table is there."""
        rows = self.state().collect()  # a row a source
        ok = {b: all(self._read(f"{self.folder}/{n}/{b}") is not None for n in TABLES) for b in {r["build"] for r in rows}}
        return sorted(r["source_name"] for r in rows if ok[r["build"]])

    def status(self, snapshot: DataFrame, trees: dict[str, str]) -> DataFrame:
        """F04. incremental.comparison() of the files with those of the last run; a new folder or other scanners are reasons too."""
        before = self.state()
        meta = self.spark.createDataFrame([(n, p, self.parser) for n, p in trees.items()], "source_name string, path string, parser string")
        known = self.table("snapshot")
        known = snapshot.limit(0) if known is None else known.select(snapshot.columns)
        return incremental.comparison(snapshot, known, meta, before.select("source_name", "path", "parser"))

    def refresh(self, scope: str, trees: dict[str, str], strict: bool = False) -> Refresh:
        """A12, F05. Scans what changed or lacks its tables, stores it, and resolves the graph of all trees."""
        spark = self.spark
        snapshot = cut(incremental.snapshot(files_of(spark, trees)))
        status = cut(self.status(snapshot, trees).where(F.col("source_name").isin(list(trees))))
        before = {r["source_name"]: r for r in self.state().collect()}  # a row a source
        have = spark.createDataFrame([(n,) for n in self.complete()], "source_name string")
        why = {r["source_name"]: r["reason"] for r in incremental.to_rebuild(status, have).collect()}  # a row a source
        scanned = sorted(why)
        if scanned:
            build = "b" + uuid.uuid4().hex
            parts = assembled(files_of(spark, {n: trees[n] for n in scanned}), strict)
            for name, rows in zip(TABLES, (snapshot.where(F.col("source_name").isin(scanned)), *parts)):
                rows.withColumn("build", F.lit(build)).write.parquet(f"{self.folder}/{name}/{build}")
            run = max((r["run"] for r in before.values()), default=0) + 1
            kept = [(run, n, before[n]["build"], before[n]["path"], before[n]["parser"]) for n in trees if n in before and n not in why]
            new = [(run, n, build, trees[n], self.parser) for n in scanned]
            spark.createDataFrame(kept + new, STATE).coalesce(1).write.mode("append").parquet(f"{self.folder}/state")
        ours = F.col("source_name").isin(list(trees))
        entities, edges, issues = (self.table(t).where(ours) for t in TABLES[1:])
        graph = Graph.of_parts(spark, scope, trees, entities, edges, issues)
        return Refresh(graph, status, sorted(n for n, reason in why.items() if reason != "missing_artifact"), scanned)

    def load(self, done: Refresh, target: str, loaded_scope: str | None, loaded_sources: list[str]) -> str:
        """F06, F07. Writes the graph to a folder of graph tables, as far as what is loaded there makes it necessary; what was done.

        After a load that failed, no loaded sources ask for the whole graph again.
        """
        graph = done.graph
        names = [r["name"] for r in graph.sources.collect()]  # a row a source
        action, changed = incremental.load_decision(loaded_scope, loaded_sources, graph.scope, names, done.changed)
        if action == "full_load":
            graph.write(target)
        elif action == "replace_sources":
            graph.replace(target, changed)
        return action


def loaded_sources(spark: SparkSession, folder: str) -> list[str]:
    """The sources of a folder of graph tables, in order; none where there is no graph."""
    tables = Stored(spark, folder)
    return [r["name"] for r in tables.read("sources").orderBy("index").collect()] if "sources" in tables.tables() else []  # a row a source

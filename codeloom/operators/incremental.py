"""Incremental processing: snapshots of files, their differences, and what to rebuild and load."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SNAPSHOT_VERSION, GRAPH_VERSION = "1", "0.1"


def snapshot(files: DataFrame) -> DataFrame:
    """F01. source_name, path, sha256, size_bytes of files(source_name, rel_path, content)."""
    raw = F.encode("content", "UTF-8")
    return files.select("source_name", F.col("rel_path").alias("path"), F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("size_bytes"))


def diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """F02. source_name, path, change (added, modified, removed) of the files that differ."""
    c = current.select("source_name", "path", F.col("sha256").alias("now"))
    p = previous.select("source_name", "path", F.col("sha256").alias("then"))
    both = c.join(p, ["source_name", "path"], "full_outer")
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "modified")
    return both.withColumn("change", change).where("change is not null").select("source_name", "path", "change")


def comparison(current: DataFrame, previous: DataFrame, meta: DataFrame | None = None, meta_before: DataFrame | None = None) -> DataFrame:
    """F02, F04. A row a source: status (new, changed, unchanged), reasons, and counts of files.

    meta: source_name and further columns whose changes are reasons ``<name>_changed``.
    """
    files = diff(current, previous).groupBy("source_name").pivot("change", ["added", "modified", "removed"]).count()
    names = current.select("source_name").union(previous.select("source_name")).distinct()
    old = previous.select("source_name").distinct().withColumn("known", F.lit(True))
    rows = names.join(files, "source_name", "left").join(old, "source_name", "left").fillna(0, ["added", "modified", "removed"])
    reasons = [F.when(F.col(k) > 0, F.lit(f"files_{k}")) for k in ("added", "modified", "removed")]
    if meta is not None and meta_before is not None:
        fields = [c for c in meta.columns if c != "source_name"]
        before = meta_before.select("source_name", *[F.col(c).alias(f"_{c}") for c in fields])
        rows = rows.join(meta, "source_name", "left").join(before, "source_name", "left")
        reasons += [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")) & F.col("known"), F.lit(f"{c}_changed")) for c in fields]
    listed = F.array_join(F.filter(F.array(*reasons), lambda x: x.isNotNull()), ",")
    status = F.when(F.col("known").isNull(), "new").when(listed != "", "changed").otherwise("unchanged")
    return rows.select("source_name", status.alias("status"), listed.alias("reasons"), "added", "modified", "removed")


def fingerprint(names: Sequence[str], version: str = "1") -> str:
    """F03. Of the extractors' names, in order."""
    return hashlib.sha256("|".join([version, GRAPH_VERSION, *names]).encode()).hexdigest()[:16]


def to_rebuild(compared: DataFrame, stored: DataFrame) -> DataFrame:
    """F05. Sources that are new, changed, or have no stored graph (stored has source_name)."""
    have = stored.select("source_name").distinct().withColumn("has", F.lit(True))
    rows = compared.join(have, "source_name", "left")
    return rows.where("status <> 'unchanged' or has is null").select("source_name", F.when(F.col("status") != "unchanged", F.col("status")).otherwise("missing_artifact").alias("reason"))


def load_decision(loaded_scope: str | None, loaded_sources: Sequence[str], scope: str, sources: Sequence[str], changed: Sequence[str]) -> tuple[str, list[str]]:
    """F06, F07. full_load, replace_sources (with their names) or skip."""
    if loaded_scope != scope or set(loaded_sources) != set(sources):
        return "full_load", []
    return ("replace_sources", sorted(changed)) if changed else ("skip", [])

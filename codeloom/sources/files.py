"""Source trees as a table of files."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_BYTES = 1_000_000
# What a scan takes and leaves out by default.
EXTENSIONS = [".cs", ".vb", ".fs", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".sql", ".yaml", ".yml", ".json", ".toml", ".txt", ".config", ".csproj", ".fsproj", ".vbproj", ".sln", ".props", ".targets", ".asmx", ".svc"]
EXCLUDED = ["node_modules", "bin", "obj", "dist", "build", "venv", "__pycache__", "vendor", "packages", "coverage", "target"]


def _dropped(part: str, excluded: Sequence[str]) -> bool:
    return part.startswith(".") or part in excluded


def _roots(folders: Sequence[str], excluded: Sequence[str]) -> tuple[list[str], list[str]]:
    """(whole, own) of the folders of a tree that hold files: the topmost ones below which nothing is left out, and those of which only the files directly in them are taken."""
    split = [tuple(f.split("/")) if f else () for f in folders]
    cuts = [next((i for i, part in enumerate(f) if _dropped(part, excluded)), None) for f in split]
    mixed = {f[:i] for f, cut in zip(split, cuts) if cut is not None for i in range(cut + 1)}
    whole, own = set(), set()
    for f, cut in zip(split, cuts):
        if cut is None:
            top = next((f[:i] for i in range(len(f) + 1) if f[:i] not in mixed), None)
            (own if top is None else whole).add("/".join(f if top is None else top))
    return sorted(whole), sorted(own)


def _pruned(spark: SparkSession, root: str, extensions: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    """The files of a tree with their content; what stands in folders that are left out, or has another extension, is listed at most, and never read.

    Folders, not files, come to the driver, but for files beside a folder that is left out.
    """
    ending = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{ending}}}")
    listed = reader.load(root).select(_relative(root).alias("rel")).withColumn("folder", F.regexp_extract("rel", "^(.*)/[^/]*$", 1))
    whole, own = _roots([r["folder"] for r in listed.select("folder").distinct().collect()], excluded)
    if whole == [""]:
        return reader.load(root)
    beside = [r["rel"] for r in listed.where(F.col("folder").isin(own)).select("rel").collect()] if own else []
    # Names may hold what load() takes for a pattern.
    paths = [f"{root.rstrip('/')}/" + re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in [*whole, *beside]]
    return reader.load(paths) if paths else reader.load(root).limit(0)


def _relative(root: str) -> Column:
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return F.substring(path, F.length(base) + 2, F.length(path))


def scan_tree(spark: SparkSession, root: str, source: str, extensions: Sequence[str] = EXTENSIONS, excluded: Sequence[str] = EXCLUDED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A02, A03. files(source_name, rel_path, extension, content, size_bytes) under root, without hidden and excluded folders and long files."""
    raw = _pruned(spark, root, extensions, excluded)
    parts = F.split("rel_path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    extension = F.lower(F.regexp_extract("rel_path", r"(\.[^./]+)$", 1))
    rows = raw.where(F.col("length") <= max_bytes).withColumn("rel_path", _relative(root)).withColumn("extension", extension)
    rows = rows.where(~F.exists(folders, lambda d: d.startswith(".") | d.isin(list(excluded))) & F.col("extension").isin(list(extensions)))

    def text(batches):
        for b in batches:
            yield pd.DataFrame({"rel_path": b["rel_path"], "extension": b["extension"], "content": [c.decode("utf-8", "ignore") for c in b["content"]], "size_bytes": b["length"]})

    decoded = rows.select("rel_path", "extension", "content", "length").mapInPandas(text, "rel_path string, extension string, content string, size_bytes long")
    return decoded.select(F.lit(source).alias("source_name"), "*")


def snippet(files: DataFrame, rel_path: str, line: int, context: int = 5) -> DataFrame:
    """A14. line_number, line, highlight around a line; paths that leave the tree are refused."""
    if rel_path.startswith("/") or ".." in rel_path.split("/") or not 0 <= context <= 50:
        raise ValueError("bad path or context")
    rows = files.where(F.col("rel_path") == rel_path).select(F.posexplode(F.split("content", "\r\n|\n|\r")).alias("_i", "line"))
    return rows.select((F.col("_i") + 1).alias("line_number"), "line").where(F.col("line_number").between(line - context, line + context)).withColumn("highlight", F.col("line_number") == line)


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A10. (entities, edges) of an exported graph document."""
    doc = spark.read.json(path, multiLine=True)
    return doc.select(F.explode("entities").alias("e")).select("e.*"), doc.select(F.explode("edges").alias("e")).select("e.*")

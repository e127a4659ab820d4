"""The scaffold of a source: its repository, projects and files, and what contains what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Files that make their folder a project.
MANIFESTS = ["App.config", "Directory.Build.props", "Web.config", "package.json", "packages.config", "pnpm-workspace.yaml", "pyproject.toml", "requirements.txt"]
MANIFEST_SUFFIXES = [".csproj", ".fsproj", ".vbproj", ".props", ".targets", ".sln"]


def folder_of(path: str | Column = "rel_path") -> Column:
    """The folder of a path, empty at the root."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def is_manifest(path: str = "rel_path") -> Column:
    """A04."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return name.isin(MANIFESTS) | name.rlike(r"^requirements-.*\.txt$") | suffix.isin(MANIFEST_SUFFIXES)


def projects(files: DataFrame, declared: DataFrame) -> DataFrame:
    """A04. (source_name, folder, name, manifest): a project a folder and name; declared(source_name, rel_path, name) names those of manifests that do.

    Other manifests name theirs by the folder, at the root by the source.
    """
    rows = files.where(is_manifest()).select("source_name", "rel_path", folder_of().alias("folder"))
    named = declared.groupBy("source_name", "rel_path").agg(F.min("name").alias("name"))
    own = F.coalesce("name", F.nullif(F.element_at(F.split("folder", "/"), -1), F.lit("")), "source_name")
    rows = rows.join(named, ["source_name", "rel_path"], "left").withColumn("name", own)
    return rows.groupBy("source_name", "folder", "name").agg(F.max("rel_path").alias("manifest"))


def owning_projects(files: DataFrame, projects_: DataFrame) -> DataFrame:
    """B03. (source_name, rel_path, project): each file's project, that of the deepest folder above it; of several there, the first by name.

    A file meets its own few ancestor folders, so the join is one of equal keys.
    """
    folder = folder_of()
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.when(folder == "", 0).otherwise(F.size(parts))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))
    rows = files.select("source_name", "rel_path", F.explode(above).alias("a")).select("source_name", "rel_path", "a.depth", "a.folder")
    met = rows.join(projects_.groupBy("source_name", "folder").agg(F.min("name").alias("project")), ["source_name", "folder"])
    return met.groupBy("source_name", "rel_path").agg(F.max_by("project", "depth").alias("project"))


def containment(files: DataFrame, projects_: DataFrame) -> DataFrame:
    """B02. (source_name, edge_type, from_type, from_name, to_type, to_name): the repository contains projects and files, a project its files."""
    owned = owning_projects(files, projects_)

    def edge(rows: DataFrame, kind: str, from_type: str, from_name: str, to_type: str, to_name: str) -> DataFrame:
        return rows.select("source_name", F.lit(kind).alias("edge_type"), F.lit(from_type).alias("from_type"), F.col(from_name).alias("from_name"), F.lit(to_type).alias("to_type"), F.col(to_name).alias("to_name"))

    out = edge(projects_, "CONTAINS_PROJECT", "repository", "source_name", "project", "name").distinct()
    out = out.unionByName(edge(files, "CONTAINS_FILE", "repository", "source_name", "file", "rel_path"))
    return out.unionByName(edge(owned, "CONTAINS_FILE", "project", "project", "file", "rel_path"))

"""The engine as one object: build from source trees, store, read and report."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.functions.exprs import entity_id
from codeloom.operators import assemble, dotnet, facts, incremental, reports, resolve, scaffold, scanners, sqltext, store, traverse
from codeloom.sources import files as file_source
from codeloom.ship import ship
from codeloom.sources.stored import Stored
from codeloom.sources.tables import cut

def _no_text():
    return F.lit(None).cast("string")



def _no_names():
    return F.array().cast("array<string>")


#: Files of the scanners over tokens; calls of caches, messages and storage are looked for in all code.
SCRIPTS = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
CODE = [*SCRIPTS, ".py", ".cs", ".vb"]
#: Files of code in which SQL is looked for.
SQL_CODE = [".cs", ".js", ".jsx", ".py", ".ts", ".tsx", ".vb"]
#: Line facts follow those of the parsers, which count from 0 in each file.
LINE_SEQ = 1_000_000


#: What a scanner knows both ends of: edges of these kinds are resolved when they are found.
DECLARED = r"^(DECLARES|CONTAINS|EXPOSES|RUNS|HANDLES|SELECTS)_|^DEFINES$"
#: Entities that are one a source, whatever the file.
WITHOUT_PATH = ["service", "package", "project", "repository"]


def files_of(spark: SparkSession, trees: dict[str, str]) -> DataFrame:
    """The files of {source name: folder}."""
    ship(spark)
    return functools.reduce(DataFrame.unionByName, [file_source.scan_tree(spark, root, name) for name, root in trees.items()])


def line_facts(files: DataFrame) -> DataFrame:
    """Facts of the scanners over tokens and of SQL text, as facts.scan() has them.

    Interactions of scripts stand twice: from the file, and from the function in which their line stands.
    """
    scripts, code, sql, with_sql = (files.where(F.col("extension").isin(list(x))) for x in (SCRIPTS, CODE, [".sql"], SQL_CODE))

    def made(rows: DataFrame, parser: str, edge_type, to_type, to_name="to_name", near=(F.lit("file"), "rel_path"), **properties) -> DataFrame:
        kept = F.create_map(*[x for k, c in properties.items() for x in (F.lit(k), F.col(c).cast("string"))]) if properties else F.create_map().cast("map<string,string>")
        return rows.select(
            "source_name", "rel_path", (F.col("line_number") + LINE_SEQ).cast("int").alias("seq"), F.lit(parser).alias("parser"), edge_type.alias("edge_type"), near[0].alias("from_type"), F.col(near[1]).alias("from_name"),
            to_type.alias("to_type"), F.col(to_name).alias("to_name"), F.col("line_number").cast("int").alias("line_number"), F.map_filter(kept, lambda k, v: v.isNotNull()).alias("properties"), _no_text().alias("issue"), _no_names().alias("aliases"),
        ).where("to_name <> ''")

    col, lit = F.col, F.lit
    # Every file of code is cut into tokens once, and every line into its scope.
    found = cut(scanners.places(code.where("extension <> '.py'")))
    of_scripts = found.where(F.lower("rel_path").rlike(r"\.(" + "|".join(x[1:] for x in SCRIPTS) + ")$"))
    scoped = cut(scanners.scopes(scripts, of_scripts).where("function is not null").drop("line").unionByName(dotnet.scopes(code)))
    evidence = {"target_boundary": "target_boundary", "dependency_scope": "dependency_scope", "interaction_kind": "interaction_kind"}

    def told(rows: DataFrame, boundary: str, kind) -> DataFrame:
        return rows.withColumns({"target_boundary": lit(boundary), "dependency_scope": lit("runtime"), "interaction_kind": kind})

    def touched(rows: DataFrame) -> list[tuple[DataFrame, str, dict]]:
        """The interactions of scanned files."""
        by = lambda a, b: F.when(col("edge_type").rlike("^(READS|CONSUMES)"), a).otherwise(b)
        return [
            (told(scanners.http_calls(rows).drop("host_service"), "application", F.when(col("edge_type") == "CALLS_SERVICE", "service_call").otherwise("http_call")), "http_calls", {"method": "method", "raw_target": "raw_target"}),
            (told(scanners.cache_calls(rows).withColumn("to_type", lit("cache_key")), "cache", by("cache_read", "cache_write")), "cache_calls", {}),
            (told(scanners.message_calls(rows), "messaging", by("message_consume", "message_publish")), "message_calls", {}),
            (told(scanners.storage_calls(rows).withColumn("to_type", lit("storage_location")), "storage", by("storage_read", "storage_write")), "storage_calls", {}),
        ]

    routes = scanners.routes(of_scripts)
    parts = [
        made(routes, "routes", lit("EXPOSES_ROUTE"), lit("api_route"), "route"),
        made(routes.where("handler is not null"), "routes", lit("HANDLES_ROUTE"), lit("function"), "handler", (lit("api_route"), "route")),
        made(scanners.imports(of_scripts), "imports", lit("IMPORTS"), F.when(col("import_kind") == "relative", "module").otherwise("package"), raw_target="raw_target", import_kind="import_kind"),
        made(scanners.symbols(of_scripts), "symbols", lit("DECLARES_SYMBOL"), col("entity_type"), "name", exported="exported"),
        made(scanners.symbol_calls(of_scripts, scoped), "symbol_calls", lit("CALLS_SYMBOL"), lit("function"), near=(lit("function"), "function")),
        made(scanners.jobs(of_scripts), "jobs", lit("DECLARES_JOB"), lit("scheduled_job"), "name", schedule="schedule", handler="handler"),
        *sql_parts(made, sql, with_sql, files.where(F.col("extension").isin([*SCRIPTS, ".cs"])), scoped),
    ]
    # Python's own scanner finds these by its syntax tree.
    parts += [made(rows, parser, col("edge_type"), col("to_type"), **more, **evidence) for rows, parser, more in touched(found)]
    parts += [made(scanners.within_functions(rows, scripts, scoped), parser, col("edge_type"), col("to_type"), near=(lit("function"), "function"), **more, **evidence) for rows, parser, more in touched(found)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sql_parts(made, sql: DataFrame, with_sql: DataFrame, scripts: DataFrame, scoped: DataFrame) -> list[DataFrame]:
    """B70 to B78. What SQL files define, and the references of SQL, from the object, function or file that they stand in."""
    state, kind = sqltext.provenance()
    of_file = {"schema_state": "schema_state", "sql_source_kind": "sql_source_kind"}
    evidence = {k: k for k in ("target_boundary", "dependency_scope", "interaction_kind", "protocol", "raw_target", "normalized_target", "database_object_type")} | {"sql_operation": "operation"}
    defined = sqltext.definitions(sql)
    inside = F.col("scope").isNotNull()
    found = sqltext.scan(sql).withColumns({"schema_state": state, "sql_source_kind": kind, "context_type": F.when(inside, F.col("origin_type")), "context_name": F.col("scope")})
    within = scanners.within_functions(sqltext.embedded(scripts), scripts, scoped).withColumns({"context_type": F.lit("function"), "context_name": F.col("function")})
    context = {"source_context_type": "context_type", "source_context_name": "context_name"}
    edge, to = F.col("edge_type"), F.col("to_type")
    return [
        made(defined, "sql", F.lit("DEFINES"), F.col("entity_type"), "full_name"),
        made(found, "sql_reference", edge, to, near=(F.col("origin_type"), "origin"), **evidence, **of_file, **context),
        made(sqltext.embedded(with_sql), "sql_reference", edge, to, **evidence),
        made(within, "sql_reference", edge, to, near=(F.lit("function"), "function"), **evidence, **context),
    ]


def path_of(kind: str) -> Column:
    """The path that belongs to an entity's id: its file's, but for those that are one a source."""
    return F.when(F.col(kind).isin(WITHOUT_PATH), _no_text()).when(F.col(kind) == "file", F.col(kind.replace("type", "name"))).otherwise(F.col("rel_path"))


def scaffold_facts(files: DataFrame, found: DataFrame) -> DataFrame:
    """B02 to B04: the repository, projects and files of each source, as facts.scan() has them."""
    declared = found.where("edge_type = 'DECLARES_PACKAGE' and from_type = 'project'").select("source_name", "rel_path", F.col("from_name").alias("name"))
    rows = scaffold.containment(files, scaffold.projects(files, declared))
    path = F.when(F.col("to_type") == "file", F.col("to_name")).otherwise("")
    return rows.select(
        "source_name", path.alias("rel_path"), F.lit(-1).alias("seq"), F.lit("scaffold").alias("parser"), "edge_type", "from_type", "from_name", "to_type", "to_name",
        F.lit(None).cast("int").alias("line_number"), F.create_map().cast("map<string,string>").alias("properties"), _no_text().alias("issue"), _no_names().alias("aliases"),
    )


def entity_facts(found: DataFrame) -> DataFrame:
    """Entity facts of scanned relationships: what stands on their near side, and what they declare, with its other names and properties."""
    none = F.create_map().cast("map<string,string>")
    at = ["source_name", "rel_path", "seq"]
    near = found.where("edge_type <> ''").select(F.col("from_type").alias("entity_type"), F.col("from_name").alias("entity_name"), *at, _no_names().alias("aliases"), none.alias("properties"))
    far = found.where(F.col("edge_type").rlike(DECLARED)).select(F.col("to_type").alias("entity_type"), F.col("to_name").alias("entity_name"), *at, F.coalesce("aliases", _no_names()).alias("aliases"), F.coalesce("properties", none).alias("properties"))
    rows = near.unionByName(far).where("entity_name <> ''")
    return rows.select(
        "entity_type", F.col("entity_name").alias("name"), "source_name", path_of("entity_type").alias("file_path"),
        F.lit(None).cast("int").alias("line_number"), "aliases", "properties", F.struct("rel_path", "seq").alias("seq"),
    )


def edge_facts(found: DataFrame) -> DataFrame:
    """Edge facts of scanned relationships: declared ones are resolved with high confidence, references wait for resolution with a medium one."""
    declared = F.col("edge_type").rlike(DECLARED)
    to = entity_id("source_name", "to_type", "to_name", path_of("to_type"))
    return found.where("edge_type <> ''").select(
        entity_id("source_name", "from_type", "from_name", path_of("from_type")).alias("from_entity_id"), "from_name", "from_type", "to_name", "to_type", F.when(declared, to).alias("to_entity_id"), "edge_type",
        declared.alias("resolved"), "source_name", F.nullif("rel_path", F.lit("")).alias("file_path"), "line_number", _no_text().alias("identity_key"), F.when(declared, "high").otherwise("medium").alias("confidence"), "parser", "properties",
        F.struct("rel_path", "seq").alias("seq"),
    )


def definition_facts(files: DataFrame) -> DataFrame:
    """Entity facts of the objects that SQL text defines: named in full, by their short name too."""
    rows = sqltext.definitions(files.where(F.col("rel_path").endswith(".sql")))
    state, kind = sqltext.provenance()
    properties = {"schema": F.col("schema"), "full_name": F.col("full_name"), "schema_state": state, "sql_source_kind": kind}
    kept = F.map_filter(F.create_map(*[x for k, c in properties.items() for x in (F.lit(k), c)]), lambda k, v: v.isNotNull())
    return rows.select("entity_type", F.col("full_name").alias("name"), "source_name", F.col("rel_path").alias("file_path"), "line_number", F.array("name").alias("aliases"), kept.alias("properties"), F.struct("rel_path", F.col("line_number").alias("seq")).alias("seq"))


def assembled(files: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, issues) of files before resolution. Ids carry the source, so sources assembled apart are the same as together."""
    ship(files.sparkSession)
    files = cut(files)
    found = cut(facts.scan(files).unionByName(line_facts(files)))
    faults = assemble.fact_issues(found.where("issue is null")).select("source_name", "rel_path", F.concat("parser", F.lit(": "), "edge_type", F.lit(": "), "message").alias("message"))
    issues = found.where("issue is not null").select("source_name", "rel_path", F.col("issue").alias("message")).unionByName(faults)
    if strict:
        assemble.require_no_issues(issues)
    found = found.where("issue is null").unionByName(scaffold_facts(files, found))
    entities = cut(assemble.upsert_entities(entity_facts(found).unionByName(definition_facts(files))).drop("seq"))
    return entities, cut(assemble.upsert_edges(edge_facts(found)).drop("seq")), issues


class Graph:
    """sources(index, name, ...), entities, resolved edges and issues of a scope."""

    def __init__(self, scope: str, sources: DataFrame, entities: DataFrame, edges: DataFrame, issues: DataFrame | None = None):
        self.scope, self.sources, self.entities, self.edges, self.issues = scope, sources, entities, edges, issues

    @classmethod
    def build(cls, spark: SparkSession, scope: str, trees: dict[str, str], strict: bool = False) -> Graph:
        """Scans {source name: folder}, assembles and resolves the graph."""
        return cls.of_files(spark, scope, trees, files_of(spark, trees), strict)

    @classmethod
    def of_files(cls, spark: SparkSession, scope: str, trees: dict[str, str], files: DataFrame, strict: bool = False, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Graph:
        """The graph of files(source_name, rel_path, extension, content); include and exclude are patterns of the packages that dependency edges may name."""
        return cls.of_parts(spark, scope, trees, *assembled(files, strict), include, exclude)

    @classmethod
    def of_parts(cls, spark: SparkSession, scope: str, trees: dict[str, str], upserted: DataFrame, found: DataFrame, issues: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Graph:
        """The graph of what assembled() gives, of one run or of several sources' runs together."""
        entities, edges = resolve.resolve(upserted, found)
        if include or exclude:
            edges = edges.where(assemble.keep_dependency(list(include), list(exclude)))
        return cls(scope, spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(trees.items())], "index long, name string, path string"), entities, edges, issues)

    def _tables(self) -> dict[str, DataFrame]:
        return {"sources": self.sources.withColumn("source_name", F.col("name")), "entities": self.entities, "edges": self.edges}

    def write(self, folder: str) -> None:
        """Makes this graph that of the folder, at once; sources that are there as they are now are not written again."""
        Stored(self.entities.sparkSession, folder).write(self._tables())

    def replace(self, folder: str, names: Sequence[str]) -> None:
        """A13, D06. Puts this graph's records into the stored one, in which the named sources give way; targets that nothing points at go with them.

        Only sources whose rows change are written, and they count all at once.
        """
        old = Graph.read(self.entities.sparkSession, folder, self.scope)
        entities, edges = store.replace_sources((old.entities, old.edges), (cut(self.entities), cut(self.edges)), names)
        edges = cut(edges)
        Graph(self.scope, self.sources, store.without_orphans(entities, edges), edges).write(folder)

    def export(self, folder: str) -> None:
        """A11. Entities and edges as JSON, one a line, without null fields."""
        for name, df in (("entities", self.entities), ("edges", self.edges)):
            df.write.mode("overwrite").json(f"{folder}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str, scope: str) -> Graph:
        tables = Stored(spark, folder)
        return cls(scope, tables.read("sources").drop("source_name"), tables.read("entities"), tables.read("edges"))

    def stats(self) -> DataFrame:
        return store.stats(self.sources, self.entities, self.edges)

    def overview(self) -> dict[str, DataFrame]:
        return store.overview(self.sources, self.entities, self.edges, self.scope)

    def source(self, name: str) -> dict[str, DataFrame] | None:
        return store.source_overview(self.sources, self.entities, self.edges, name)

    def search(self, query: str, **how) -> DataFrame:
        return store.search_entities(self.entities, query, **how)

    def relationships(self, **how) -> DataFrame:
        return store.search_edges(self.edges, self.entities, **how)

    def neighbors(self, entity: str, **how) -> DataFrame:
        return traverse.neighbors(self.edges, entity, **how)

    def impact(self, entity: str, **how) -> dict[str, DataFrame]:
        return traverse.radius_report(self.edges, self.entities, entity, **how)

    def unresolved(self, source: str | None = None, edge_type: str | None = None) -> dict[str, DataFrame]:
        groups = reports.unresolved_groups(self.edges, source, edge_type)
        return {"summary": reports.unresolved_summary(self.edges), "classes": reports.unresolved_classes(self.edges), "sources": reports.unresolved_source_hotspots(self.edges), "targets": reports.unresolved_target_hotspots(self.edges), "items": groups}

    def interactions(self, **how) -> dict[str, DataFrame]:
        groups = reports.interaction_groups(reports.interaction_edges(self.edges, self.entities, **how))
        return {"summary": reports.interaction_summary(groups), "sources": reports.interaction_source_hotspots(groups), "targets": reports.interaction_target_hotspots(groups), "items": groups}

    def reconciliation(self) -> dict[str, DataFrame]:
        groups = reports.reconciliation_groups(self.edges, self.entities)
        return {"classes": reports.reconciliation_classes(groups), "sources": reports.reconciliation_source_hotspots(groups), "targets": reports.reconciliation_target_hotspots(groups), "items": groups}

    def coverage(self, source: str | None = None) -> DataFrame:
        return reports.coverage_warnings(self.edges, source)


def snapshot_of(spark: SparkSession, trees: dict[str, str]) -> DataFrame:
    """Hashes of the files of {source name: folder}."""
    return incremental.snapshot(files_of(spark, trees))


def show(parts: dict[str, DataFrame], names: Sequence[str] | None = None) -> None:
    for name, df in parts.items():
        if names is None or name in names:
            print(f"== {name}")
            df.show(50, truncate=False)


__all__ = ["Graph", "assembled", "files_of", "show", "snapshot_of"]

"""Database catalogs: reads of their tables as joins, and facts made of the rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.functions.exprs import metadata_value, normalize_key
from codeloom.sources.tables import cut

#: Most rows of one catalog.
ROW_BUDGET = 50_000
# Object types of the two engines, and dependency types that mean a call.
SQLSERVER_TYPES = {"U": "sql_table", "V": "sql_view", "P": "stored_procedure", "FN": "sql_function", "IF": "sql_function", "TF": "sql_function"}
POSTGRES_RELATIONS = {"r": "table", "p": "table", "v": "view", "m": "materialized_view"}
POSTGRES_ROUTINES = {"p": "procedure", "f": "function"}
GRAPH_TYPES = {
    "table": "sql_table", "view": "sql_view", "materialized_view": "sql_view", "procedure": "stored_procedure", "stored_procedure": "stored_procedure",
    "function": "sql_function", "trigger": "sql_trigger", **{k.lower(): v for k, v in SQLSERVER_TYPES.items()},
}
CALL_DEPENDENCIES = ["call", "calls_sql", "exec", "execute", "execution", "procedure_execution"]
SYSTEM_SCHEMAS = ["information_schema", "pg_catalog"]


def _named(kinds: dict[str, str], c: str | Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col(c) if isinstance(c, str) else c)


def in_schemas(c: str, schemas: Sequence[str] | None, user_only: bool = False) -> Column:
    """A29. Whether a schema is asked for; by default all but the system's."""
    if schemas:
        return F.col(c).isin(list(schemas))
    return ~(F.col(c).isin(SYSTEM_SCHEMAS) | F.col(c).startswith("pg_toast")) if user_only else F.lit(True)


def sqlserver_objects(objects: DataFrame, schemas: DataFrame, limit: int | None, only: Sequence[str] | None = None, types: Sequence[str] = tuple(SQLSERVER_TYPES)) -> DataFrame:
    """A20. objects(object_id, schema_id, name, type, is_ms_shipped), schemas(schema_id, name); all of them where limit is None."""
    s = schemas.select("schema_id", F.col("name").alias("schema_name"))
    rows = objects.where(~F.col("is_ms_shipped") & F.trim("type").isin(list(types))).join(s, "schema_id").where(in_schemas("schema_name", only))
    rows = rows.select("schema_name", F.col("name").alias("object_name"), F.trim("type").alias("object_type")).orderBy("schema_name", "object_name")
    return rows if limit is None else rows.limit(limit)


def foreign_keys(objects: DataFrame, schemas: DataFrame, keys: DataFrame, limit: int | None, only: Sequence[str] | None = None) -> DataFrame:
    """A21, A26. keys(name, parent_object_id, referenced_object_id); all of them where limit is None."""
    named = objects.join(schemas.select("schema_id", F.col("name").alias("schema")), "schema_id").select("object_id", F.col("name").alias("table"), "schema")
    child = named.select(F.col("object_id").alias("parent_object_id"), F.col("table").alias("table_name"), F.col("schema").alias("schema_name"))
    parent = named.select(F.col("object_id").alias("referenced_object_id"), F.col("table").alias("referenced_table_name"), F.col("schema").alias("referenced_schema_name"))
    rows = keys.join(child, "parent_object_id").join(parent, "referenced_object_id").where(in_schemas("schema_name", only))
    rows = rows.select("schema_name", "table_name", "referenced_schema_name", "referenced_table_name", F.col("name").alias("constraint_name")).orderBy("schema_name", "table_name", "constraint_name")
    return rows if limit is None else rows.limit(limit)


def sqlserver_triggers(rows: DataFrame) -> DataFrame:
    """A22. One row a trigger of rows(schema_name, trigger_name, table_schema_name, table_name, event_name, is_disabled), a row an event."""
    keys = ["schema_name", "trigger_name", "table_schema_name", "table_name"]
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.upper("event_name"))), ",").alias("events"), F.min_by("is_disabled", F.coalesce("event_name", F.lit(""))).alias("is_disabled"))


def sqlserver_trigger_rows(triggers: DataFrame, objects: DataFrame, schemas: DataFrame, events: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """A22. The rows of sqlserver_triggers() from triggers(object_id, name, parent_id, is_disabled), events(object_id, event_name), objects and schemas; triggers without events stay."""
    named = objects.join(schemas.select("schema_id", F.col("name").alias("table_schema_name")), "schema_id").select(F.col("object_id").alias("parent_id"), F.col("name").alias("table_name"), "table_schema_name")
    rows = triggers.join(named, "parent_id").join(events.select("object_id", "event_name"), "object_id", "left").where(in_schemas("table_schema_name", only))
    return rows.select(F.col("table_schema_name").alias("schema_name"), F.col("name").alias("trigger_name"), "table_schema_name", "table_name", "event_name", "is_disabled")


def sqlserver_dependencies(rows: DataFrame) -> DataFrame:
    """A23. A missing target schema is the origin's; every dependency is a reference of a module."""
    return rows.withColumn("to_schema_name", F.coalesce("to_schema_name", "from_schema_name")).withColumn("dependency_type", F.lit("module_reference"))


def sqlserver_dependency_rows(dependencies: DataFrame, objects: DataFrame, schemas: DataFrame) -> DataFrame:
    """A23. The rows of sqlserver_dependencies() from dependencies(referencing_id, referenced_id, referenced_schema_name, referenced_entity_name); a target outside of the catalog keeps the name that it is given."""
    named = objects.join(schemas.select("schema_id", F.col("name").alias("schema")), "schema_id").select("object_id", "schema", F.col("name").alias("object"), F.trim("type").alias("kind"))
    origin = named.select(F.col("object_id").alias("referencing_id"), F.col("schema").alias("from_schema_name"), F.col("object").alias("from_object_name"), F.col("kind").alias("from_object_type"))
    target = named.select(F.col("object_id").alias("referenced_id"), F.col("schema").alias("_schema"), F.col("object").alias("_object"), F.col("kind").alias("to_object_type"))
    rows = dependencies.join(origin, "referencing_id").join(target, "referenced_id", "left")
    return rows.select(
        "from_schema_name", "from_object_name", "from_object_type", F.coalesce("_schema", "referenced_schema_name").alias("to_schema_name"), F.coalesce("_object", "referenced_entity_name").alias("to_object_name"), "to_object_type", F.lit(None).cast("string").alias("dependency_name"),
    )


def postgres_objects(classes: DataFrame, namespaces: DataFrame, limit: int | None, only: Sequence[str] | None = None, kinds: dict[str, str] = POSTGRES_RELATIONS, kind_col: str = "relkind") -> DataFrame:
    """A24, A25. classes(oid, name, namespace, relkind or prokind), namespaces(oid, nspname)."""
    n = namespaces.select(F.col("oid").alias("namespace"), F.col("nspname").alias("schema_name"))
    rows = classes.where(F.col(kind_col).isin(list(kinds))).join(n, "namespace").where(in_schemas("schema_name", only, True))
    rows = rows.select("schema_name", F.col("name").alias("object_name"), _named(kinds, kind_col).alias("object_type")).orderBy("schema_name", "object_name")
    return rows if limit is None else rows.limit(limit)


def postgres_trigger_events(bits: str | Column = "tgtype") -> Column:
    """A27. INSERT, UPDATE, DELETE, TRUNCATE, from the bits 4, 16, 8 and 32."""
    b = F.col(bits) if isinstance(bits, str) else bits
    return F.filter(F.array(*[F.when(b.bitwiseAND(v) != 0, n) for n, v in (("INSERT", 4), ("UPDATE", 16), ("DELETE", 8), ("TRUNCATE", 32))]), lambda x: x.isNotNull())


def sequenced(reads: Mapping[str, Callable[[int], DataFrame]], budget: int = ROW_BUDGET, engine: str = "SQL Server") -> tuple[dict[str, DataFrame], list[str]]:
    """A09, A30. The reads one after another, each given what the ones before have left of the budget, as stored tables.

    A read that takes all that is left is an issue; the ones after it are not begun and are empty. Each read runs once: its rows
    are stored and counted where they are stored.
    """
    if budget < 1:
        raise ValueError("a row budget is a positive number")
    out, issues, left = {}, [], budget
    for name, read in reads.items():
        if left <= 0:
            out[name] = read(1).limit(0)
            continue
        out[name] = cut(read(left))
        n = out[name].count()
        if n >= left:
            issues.append(f"{engine} metadata row limit reached while reading {name}; increase the row budget to read more")
        left -= n
    return out, issues


def sqlserver_read(objects: DataFrame, schemas: DataFrame, keys: DataFrame, triggers: DataFrame, dependencies: DataFrame, budget: int = ROW_BUDGET, only: Sequence[str] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """A30. The SQL Server catalog's rows within one budget; triggers(rows of A22) and dependencies(rows of A23) in the order of their names."""
    return sequenced({
        "sys.objects": lambda n: sqlserver_objects(objects, schemas, n, only), "sys.foreign_keys": lambda n: foreign_keys(objects, schemas, keys, n, only),
        "sys.triggers": lambda n: triggers.orderBy("schema_name", "table_name", "trigger_name").limit(n),
        "sys.sql_expression_dependencies": lambda n: dependencies.orderBy("from_schema_name", "from_object_name", "to_schema_name", "to_object_name").limit(n),
    }, budget)


def graph_type(c: str | Column) -> Column:
    """B84. A graph entity type from a catalog's name of it."""
    return _named(GRAPH_TYPES, metadata_value(c))


def object_entities(rows: DataFrame, source: str, engine: str) -> DataFrame:
    """B80, B81. Entity facts of catalog objects, one an object."""
    full = F.concat_ws(".", "schema_name", "object_name")
    props = F.create_map(F.lit("schema"), F.col("schema_name"), F.lit("full_name"), full, F.lit("schema_state"), F.lit("current_database"), F.lit("database_engine"), F.lit(engine), F.lit("metadata_source"), F.lit("catalog"))
    return rows.select(graph_type("object_type").alias("entity_type"), F.col("object_name").alias("name"), F.lit(source).alias("source_name"), full.alias("file_path"), F.lit(None).cast("int").alias("line_number"), F.array(full).alias("aliases"), props.alias("properties")).where("entity_type is not null").dropDuplicates(["entity_type", "name", "file_path"])


def index(entities: DataFrame) -> DataFrame:
    """B82. (kind, key, n, name): how many entities a name means; kind is null for any type."""
    keys = F.array_distinct(F.array(normalize_key("name"), normalize_key(F.col("properties")["full_name"])))
    rows = entities.select("entity_type", "file_path", F.explode(keys).alias("key"))
    typed = rows.groupBy(F.col("entity_type").alias("kind"), "key").agg(F.count_distinct("file_path").alias("n"), F.min("file_path").alias("name"))
    untyped = rows.groupBy("key").agg(F.count_distinct("entity_type", "file_path").alias("n"), F.min("file_path").alias("name")).select(F.lit(None).cast("string").alias("kind"), "key", "n", "name")
    return typed.unionByName(untyped)


def _ends(rows: DataFrame, known: DataFrame, own: Column, other: Column, own_kind: str | Column, other_kind: str | Column) -> DataFrame:
    """rows with own, other (full names) and how many entities of the given kind each means (own_n, other_n); a null kind is any."""
    kind = lambda k: F.lit(k) if isinstance(k, str) else k
    names = index(known)
    keyed = rows.withColumns({"own": F.lower(own), "other": F.lower(other), "own_kind": kind(own_kind), "other_kind": kind(other_kind)})
    for side in ("own", "other"):
        found = names.select(F.col("kind").alias(f"_{side}_kind"), F.col("key").alias(f"_{side}"), F.col("n").alias(f"{side}_n"))
        keyed = keyed.join(found, (F.col(side) == F.col(f"_{side}")) & F.col(f"{side}_kind").eqNullSafe(F.col(f"_{side}_kind")), "left").drop(f"_{side}", f"_{side}_kind").fillna(0, [f"{side}_n"])
    return keyed


def _edges_and_issues(met: DataFrame, edge_type: str | Column, identity: Column, source: str, parser: str, what: str) -> tuple[DataFrame, DataFrame]:
    """B83. Edges of rows whose own object is known and single; an issue for each other row. A target with several meanings is ambiguous."""
    edges = met.where("own_n = 1").select(
        F.col("own").alias("from_name"), F.col("other").alias("to_name"), (F.lit(edge_type) if isinstance(edge_type, str) else edge_type).alias("edge_type"), F.col("other_kind").alias("to_type"), (F.col("other_n") == 1).alias("resolved"),
        F.when(F.col("other_n") > 1, "ambiguous").alias("resolution_status"), identity.alias("identity_key"), F.lit(source).alias("source_name"), F.lit(parser).alias("parser"),
    )
    issues = met.where("own_n <> 1").select(F.concat(F.lit(what), F.when(F.col("own_n") > 1, " of an ambiguous object: ").otherwise(" of an unknown object: "), F.col("own")).alias("message"))
    return edges, issues


def _full(schema: str, name: str) -> Column:
    return F.concat_ws(".", schema, name)


def foreign_key_edges(rows: DataFrame, source: str, known: DataFrame, parser: str = "sqlserver_metadata") -> tuple[DataFrame, DataFrame]:
    """B83. Edges of foreign keys, and issues of those whose own table is missing or ambiguous."""
    met = _ends(rows, known, _full("schema_name", "table_name"), _full("referenced_schema_name", "referenced_table_name"), "sql_table", "sql_table")
    return _edges_and_issues(met, "REFERENCES_SQL_OBJECT", F.concat_ws("|", F.lit("foreign_key"), "own", "other", "constraint_name"), source, parser, "foreign key")


def trigger_edges(rows: DataFrame, source: str, known: DataFrame, parser: str = "sqlserver_metadata") -> tuple[DataFrame, DataFrame]:
    """B83. Edges from triggers, among the known entities, to their tables."""
    met = _ends(rows, known, _full("schema_name", "trigger_name"), _full("table_schema_name", "table_name"), "sql_trigger", "sql_table")
    return _edges_and_issues(met, "TRIGGERS_ON_SQL_OBJECT", F.concat_ws("|", F.lit("trigger"), "own", "other"), source, parser, "trigger")


def dependency_edges(rows: DataFrame, source: str, known: DataFrame, parser: str = "sqlserver_metadata") -> tuple[DataFrame, DataFrame]:
    """B83. Edges of rows(from_schema_name, from_object_name, from_object_type, to_schema_name, to_object_name, to_object_type, dependency_name, dependency_type): calls of procedures, references of others."""
    calls = F.coalesce(metadata_value("dependency_type").isin(CALL_DEPENDENCIES), F.lit(False))
    met = _ends(rows, known, _full("from_schema_name", "from_object_name"), _full("to_schema_name", "to_object_name"), graph_type("from_object_type"), graph_type("to_object_type"))
    return _edges_and_issues(met, F.when(calls, "CALLS_SQL").otherwise("REFERENCES_SQL_OBJECT"), F.concat_ws("|", F.lit("dependency"), "own", "other", "dependency_name"), source, parser, "dependency")


def trigger_entities(rows: DataFrame, source: str, engine: str) -> DataFrame:
    """B81. Entity facts of triggers, one a trigger, with their table, events and whether they are enabled."""
    full = _full("schema_name", "trigger_name")
    props = F.create_map(
        F.lit("schema"), F.col("schema_name"), F.lit("full_name"), full, F.lit("schema_state"), F.lit("current_database"), F.lit("database_engine"), F.lit(engine), F.lit("metadata_source"), F.lit("catalog"),
        F.lit("table"), _full("table_schema_name", "table_name"), F.lit("trigger_events"), F.col("events"), F.lit("trigger_enabled"), (~F.col("is_disabled")).cast("string"),
    )
    return rows.select(F.lit("sql_trigger").alias("entity_type"), F.col("trigger_name").alias("name"), F.lit(source).alias("source_name"), full.alias("file_path"), F.lit(None).cast("int").alias("line_number"), F.array(full).alias("aliases"), F.map_filter(props, lambda k, v: v.isNotNull()).alias("properties")).dropDuplicates(["name", "file_path"])


def scan_catalog(source: str, engine: str, objects: DataFrame, keys: DataFrame, triggers: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """B80. (entities, edges, issues) of a catalog's rows."""
    known = object_entities(objects, source, engine).unionByName(trigger_entities(triggers, source, engine))
    parser = f"{engine}_metadata"
    parts = [f(rows, source, known, parser) for f, rows in ((foreign_key_edges, keys), (trigger_edges, triggers), (dependency_edges, dependencies))]
    edges, issues = parts[0]
    for more, other in parts[1:]:
        edges, issues = edges.unionByName(more), issues.unionByName(other)
    return known, edges, issues


def dependency_edge_type(c: str = "dependency_type") -> Column:
    return F.when(metadata_value(c).isin(CALL_DEPENDENCIES), "CALLS_SQL").otherwise("READS_SQL_OBJECT")


def fixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A catalog of objects and schemas made of the part table."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("U ", "V ", "P ", "FN")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    objects = part.select(F.col("p_partkey").alias("object_id"), (F.col("p_partkey") % 3).alias("schema_id"), F.concat(F.lit("obj_"), F.col("p_partkey").cast("string")).alias("name"), kind.alias("type"), (F.col("p_partkey") % 5 == 0).alias("is_ms_shipped"))
    return objects, spark.range(3).select(F.col("id").alias("schema_id"), F.concat(F.lit("schema_"), F.col("id").cast("string")).alias("name"))


def fixture_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    objects, schemas = fixture(spark, sf_dir)
    return objects, schemas, objects.select(F.concat(F.lit("fk_"), F.col("object_id").cast("string")).alias("name"), F.col("object_id").alias("parent_object_id"), F.expr("object_id div 2").alias("referenced_object_id"))

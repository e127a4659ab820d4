"""The PostgreSQL catalog: its tables as DataFrames, joined to what it says of objects, keys, triggers and dependencies.

Tables and the columns read of them: pg_namespace(oid, nspname), pg_class(oid, relname,
relnamespace, relkind), pg_proc(oid, proname, pronamespace, prokind), pg_constraint(conname,
contype, conrelid, confrelid), pg_trigger(tgname, tgrelid, tgfoid, tgtype, tgenabled,
tgisinternal), pg_rewrite(oid, ev_class) and pg_depend(classid, objid, refclassid, refobjid,
deptype), the two class ids as names. Object ids may be shared between catalogs, so every join
says which one it means.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.operators import catalog

Tables = Mapping[str, DataFrame]
#: Kinds of relations that have a rewrite rule of their own, and of dependencies that a definition makes.
VIEW_KINDS, DEFINING = ["m", "v"], ["a", "n"]


def _relations(t: Tables, prefix: str) -> DataFrame:
    """Every relation: id, schema, name and kind, their columns with a prefix."""
    named = t["pg_class"].alias("c").join(t["pg_namespace"].alias("n"), F.col("n.oid") == F.col("c.relnamespace"))
    return named.select(F.col("c.oid").alias(f"{prefix}_oid"), F.col("nspname").alias(f"{prefix}_schema_name"), F.col("relname").alias(f"{prefix}_object_name"), F.col("relkind").alias(f"{prefix}_kind"))


def _routines(t: Tables, prefix: str) -> DataFrame:
    """Every routine, as _relations()."""
    named = t["pg_proc"].alias("p").join(t["pg_namespace"].alias("n"), F.col("n.oid") == F.col("p.pronamespace"))
    return named.select(F.col("p.oid").alias(f"{prefix}_oid"), F.col("nspname").alias(f"{prefix}_schema_name"), F.col("proname").alias(f"{prefix}_object_name"), F.col("prokind").alias(f"{prefix}_kind"))


def _relation_type(kind: str) -> Column:
    return F.when(F.col(kind) == "m", "materialized_view").when(F.col(kind) == "v", "view").otherwise("table")


def _routine_type(kind: str) -> Column:
    return F.when(F.col(kind) == "p", "procedure").otherwise("function")


def _first(rows: DataFrame, order: Sequence[str], limit: int | None) -> DataFrame:
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def objects(t: Tables, limit: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """A24, A25. Tables, views and routines of the schemas asked for, by default all but the system's."""
    kinds = {"pg_class": ("relname", "relnamespace", "relkind", catalog.POSTGRES_RELATIONS), "pg_proc": ("proname", "pronamespace", "prokind", catalog.POSTGRES_ROUTINES)}
    parts = [
        catalog.postgres_objects(t[table].select(F.col(name).alias("name"), F.col(space).alias("namespace"), kind), t["pg_namespace"], None, only, known, kind)
        for table, (name, space, kind, known) in kinds.items()
    ]
    return _first(parts[0].unionByName(parts[1]), ["schema_name", "object_name", "object_type"], limit)


def foreign_keys(t: Tables, limit: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """A26. Foreign keys with the tables at both ends; the schemas are those of the referring table."""
    keys = t["pg_constraint"].where("contype = 'f'")
    met = keys.join(_relations(t, "own"), F.col("conrelid") == F.col("own_oid")).join(_relations(t, "far"), F.col("confrelid") == F.col("far_oid"))
    rows = met.where(catalog.in_schemas("own_schema_name", only, True)).select(
        F.col("own_schema_name").alias("schema_name"), F.col("own_object_name").alias("table_name"), F.col("far_schema_name").alias("referenced_schema_name"),
        F.col("far_object_name").alias("referenced_table_name"), F.col("conname").alias("constraint_name"),
    )
    return _first(rows, ["schema_name", "table_name", "constraint_name"], limit)


def triggers(t: Tables, limit: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """A27. Triggers that users made, with their table, events, state and function."""
    own = t["pg_trigger"].where(~F.col("tgisinternal"))
    met = own.join(_relations(t, "own"), F.col("tgrelid") == F.col("own_oid")).join(_routines(t, "far"), F.col("tgfoid") == F.col("far_oid"))
    rows = met.where(catalog.in_schemas("own_schema_name", only, True)).select(
        F.col("own_schema_name").alias("schema_name"), F.col("tgname").alias("trigger_name"), F.col("own_schema_name").alias("table_schema_name"), F.col("own_object_name").alias("table_name"),
        F.array_join(catalog.postgres_trigger_events(F.col("tgtype").cast("int")), ",").alias("events"), (F.col("tgenabled") == "D").alias("is_disabled"),
        F.col("far_schema_name").alias("function_schema_name"), F.col("far_object_name").alias("function_name"),
    )
    return _first(rows, ["schema_name", "table_name", "trigger_name"], limit)


def dependencies(t: Tables, limit: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """A28. What views read, by their rewrite rules, and what routines use of each other; never an object's use of itself, nor the system's objects."""
    uses = t["pg_depend"].where(F.col("deptype").isin(DEFINING))
    rules = t["pg_rewrite"].select(F.col("oid").alias("rule"), F.col("ev_class").alias("rule_of"))

    def made(met: DataFrame, kind) -> DataFrame:
        kept = met.where((F.col("own_oid") != F.col("far_oid")) & catalog.in_schemas("own_schema_name", only, True) & catalog.in_schemas("far_schema_name", None, True))
        return kept.select(
            F.col("own_schema_name").alias("from_schema_name"), F.col("own_object_name").alias("from_object_name"), kind("own_kind").alias("from_object_type"),
            F.col("far_schema_name").alias("to_schema_name"), F.col("far_object_name").alias("to_object_name"), kind("far_kind").alias("to_object_type"),
            F.col("deptype").alias("dependency_name"), F.lit("object_dependency").alias("dependency_type"),
        )

    of_rules = uses.where("classid = 'pg_rewrite' AND refclassid = 'pg_class'").join(rules, F.col("objid") == F.col("rule"))
    views = of_rules.join(_relations(t, "own").where(F.col("own_kind").isin(VIEW_KINDS)), F.col("rule_of") == F.col("own_oid")).join(_relations(t, "far"), F.col("refobjid") == F.col("far_oid"))
    routines = uses.where("classid = 'pg_proc' AND refclassid = 'pg_proc'").join(_routines(t, "own"), F.col("objid") == F.col("own_oid")).join(_routines(t, "far"), F.col("refobjid") == F.col("far_oid"))
    rows = made(views, _relation_type).unionByName(made(routines, _routine_type))
    return _first(rows, ["from_schema_name", "from_object_name", "to_schema_name", "to_object_name", "dependency_name"], limit)


def read(t: Tables, budget: int = catalog.ROW_BUDGET, only: Sequence[str] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """A30. The catalog's rows, read one table after another within one budget, and the issues of what met it."""
    return catalog.sequenced({
        "pg_class": lambda n: objects(t, n, only), "pg_constraint": lambda n: foreign_keys(t, n, only), "pg_trigger": lambda n: triggers(t, n, only), "pg_depend": lambda n: dependencies(t, n, only),
    }, budget, "PostgreSQL")


def scan(source: str, found: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """B80, B83. (entities, edges, issues) of what read() gives."""
    return catalog.scan_catalog(source, "postgresql", found["pg_class"], found["pg_constraint"], found["pg_trigger"], found["pg_depend"])

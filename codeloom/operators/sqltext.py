"""SQL in text files and in code: definitions, and references with the object that they stand in.

Input: files(source_name, rel_path, content). Native functions only: lines are cut once, carry the SQL
object whose definition they stand in, and give all their references in one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions.exprs import schema_of, short_name, sql_name


def _name(quoted: str) -> str:
    """A dotted name, taken whole: what follows it never takes a part of it back."""
    part = rf"(?:{quoted}|\w++)"
    return rf"({part}(?:\s*+\.\s*+{part})*+)"


#: Names in SQL files, and in code, where double quotes and backticks end the text that holds the SQL.
_IN_SQL, _IN_CODE = _name(r"\[[^\]]++\]|\"[^\"]++\"|`[^`]++`"), _name(r"\[[^\]]++\]")
_DEFINED = r"(?i)\bCREATE\s+(?:OR\s+ALTER\s+)?(PROCEDURE|PROC|TABLE|VIEW|FUNCTION)\s+"
DEFINITION = _DEFINED + _IN_SQL
#: Fixed values: (edge type, operation, object type, what stands before a name, what may not stand behind it).
STATEMENTS = [
    ("CALLS_SQL", "execute", "stored_procedure", r"\bEXEC(?:UTE)?\s+", ""),
    ("READS_SQL_OBJECT", "from", "sql_object", r"\bFROM\s+", r"(?!\s+import\b)"),
    ("READS_SQL_OBJECT", "join", "sql_object", r"\bJOIN\s+", r"(?!\s+import\b)"),
    ("WRITES_SQL_OBJECT", "insert", "sql_object", r"\bINSERT\s+(?:INTO\s+)?+", ""),
    ("WRITES_SQL_OBJECT", "update", "sql_object", r"\bUPDATE\s+", ""),
    ("WRITES_SQL_OBJECT", "delete", "sql_object", r"\bDELETE\s+FROM\s+", ""),
    ("WRITES_SQL_OBJECT", "merge", "sql_object", r"\bMERGE\s+(?:INTO\s+)?+", ""),
    ("WRITES_SQL_OBJECT", "truncate", "sql_object", r"\bTRUNCATE\s+TABLE\s+", ""),
    ("WRITES_SQL_OBJECT", "select_into", "sql_object", r"\bSELECT\b.*?\bINTO\s+", ""),
    ("REFERENCES_SQL_OBJECT", "references", "sql_object", r"\bREFERENCES\s+", ""),
]
#: Words that cannot be the target of a write or a schema reference.
STOP_WORDS = [
    "action", "as", "cascade", "default", "from", "into", "join", "no", "null", "on", "or", "output", "references", "select", "set", "table", "then", "update", "using",
    "values", "when", "where",
]
OBJECT_TYPES = {"PROCEDURE": "stored_procedure", "PROC": "stored_procedure", "TABLE": "sql_table", "VIEW": "sql_view", "FUNCTION": "sql_function"}
#: Folders of files whose SQL is history, files that hold the present schema, and a line that ends a batch.
HISTORICAL_DIRECTORIES = ["migration", "migrations", "revision", "revisions", "rev", "revs", "alembic", "flyway", "liquibase"]
SCHEMA_FILES = [f"{x}.sql" for x in ("schema", "tables", "views", "functions", "procedures")]
BATCH_END = r"(?i)^\s*GO(\s+\d+)?\s*;?\s*$"


def lines(files: DataFrame) -> DataFrame:
    """source_name, rel_path, line_number, line."""
    return files.select("source_name", "rel_path", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("_i", "line")).select("source_name", "rel_path", (F.col("_i") + 1).alias("line_number"), "line")


def _defined() -> tuple[Column, Column]:
    """(entity type, full name) of the first definition of a line, NULL without one."""
    has = F.col("line").rlike(DEFINITION)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in OBJECT_TYPES.items() for x in kv]), F.upper(F.regexp_extract("line", DEFINITION, 1)))
    return F.when(has, kind), F.when(has, sql_name(F.regexp_extract("line", DEFINITION, 2)))


def definitions(files: DataFrame) -> DataFrame:
    """B70. The first definition of each line: type, full name, schema, short name."""
    kind, full = _defined()
    rows = lines(files).withColumns({"entity_type": kind, "full_name": full}).where("full_name IS NOT NULL").drop("line")
    return rows.withColumn("schema", schema_of("full_name")).withColumn("name", short_name("full_name"))


def _found(edge_types: Sequence[str], names: str) -> Column:
    """All references of a line of the given edge types, as an array of structs."""
    def of(edge_type: str, operation: str, kind: str, before: str, behind: str) -> Column:
        targets = F.regexp_extract_all("line", F.lit("(?i)" + before + names + behind), F.lit(1))
        return F.transform(targets, lambda t: F.struct(F.lit(edge_type).alias("edge_type"), F.lit(operation).alias("sql_operation"), F.lit(kind).alias("to_type"), t.alias("raw_target")))
    return F.concat(*[of(*x) for x in STATEMENTS if x[0] in edge_types])


def references(rows: DataFrame, edge_types: Sequence[str] = ("CALLS_SQL", "READS_SQL_OBJECT", "WRITES_SQL_OBJECT", "REFERENCES_SQL_OBJECT")) -> DataFrame:
    """rows(rel_path, line, ...) with a row a reference: edge_type, sql_operation, to_type, raw_target, to_name, in place of the line.

    Names in double quotes or backticks count in .sql files only.
    """
    some = reduce(lambda a, b: a | b, [F.col("line").rlike("(?i)" + x[3]) for x in STATEMENTS if x[0] in edge_types])
    found = F.when(F.lower("rel_path").endswith(".sql"), _found(edge_types, _IN_SQL)).otherwise(_found(edge_types, _IN_CODE))
    out = rows.where(some).withColumn("_r", F.explode(found)).select(*[c for c in rows.columns if c != "line"], "_r.*").withColumn("to_name", sql_name("raw_target"))
    checked = F.col("edge_type").isin("WRITES_SQL_OBJECT", "REFERENCES_SQL_OBJECT") & F.lower("to_name").isin(STOP_WORDS)
    return out.where(~checked & (F.col("to_name") != ""))


def calls(files: DataFrame) -> DataFrame:
    """B71."""
    return references(lines(files), ["CALLS_SQL"])


def reads(files: DataFrame) -> DataFrame:
    """B72. FROM and JOIN targets; no word is excluded, but Python's ``from x import`` is."""
    return references(lines(files), ["READS_SQL_OBJECT"])


def writes(files: DataFrame) -> DataFrame:
    """B73. Targets of six kinds of statements, without stop words."""
    return references(lines(files), ["WRITES_SQL_OBJECT"])


def schema_references(files: DataFrame) -> DataFrame:
    """B74. Targets of REFERENCES, without stop words."""
    return references(lines(files), ["REFERENCES_SQL_OBJECT"])


def scopes(files: DataFrame) -> DataFrame:
    """B75. Lines with the SQL object whose definition they stand in (scope, scope_type): the last one since the last GO."""
    kind, full = _defined()
    rows = lines(files).withColumn("_d", F.when(full.isNotNull(), F.struct(full.alias("name"), kind.alias("type"))))
    batch = Window.partitionBy("source_name", "rel_path").orderBy("line_number")
    numbered = rows.withColumn("batch", F.sum(F.col("line").rlike(BATCH_END).cast("int")).over(batch))
    within = Window.partitionBy("source_name", "rel_path", "batch").orderBy("line_number")
    carried = numbered.withColumn("_s", F.last("_d", ignorenulls=True).over(within))
    return carried.select("source_name", "rel_path", "line_number", "line", "batch", F.col("_s.name").alias("scope"), F.col("_s.type").alias("scope_type"))


def provenance(path: str | Column = "rel_path") -> tuple[Column, Column]:
    """B77. (schema_state, kind) from a path's parts and file name."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    parts, name = F.split(p, "/"), F.element_at(F.split(p, "/"), -1)
    old = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in HISTORICAL_DIRECTORIES])) | name.rlike(r"^v[0-9]+__")
    state = F.when(old, "historical").when(name.isin(SCHEMA_FILES), "current_schema").otherwise("unknown")
    return state, F.when(old, "migration_file").when(name.isin(SCHEMA_FILES), "schema_file").otherwise("sql_file")


def evidence() -> dict[str, Column]:
    """B78. What tells an interaction with a database from others, for rows of references()."""
    schema = F.col("edge_type") == "REFERENCES_SQL_OBJECT"
    return {
        "target_boundary": F.lit("database"), "dependency_scope": F.when(schema, "schema").otherwise("runtime"), "interaction_kind": F.when(schema, "sql_schema_reference").otherwise("sql_reference"),
        "protocol": F.lit("sql"), "normalized_target": F.col("to_name"), "operation": F.upper("sql_operation"), "database_object_type": F.col("to_type"),
    }


def scan(files: DataFrame) -> DataFrame:
    """B75, B76, B78. All references of SQL files, with the object that they stand in (origin, origin_type; the file outside of any) and the evidence of an interaction."""
    rows = scopes(files).select("source_name", "rel_path", "line_number", "line", "scope", F.coalesce("scope", "rel_path").alias("origin"), F.coalesce("scope_type", F.lit("file")).alias("origin_type"))
    return references(rows).withColumns(evidence())


def embedded(files: DataFrame) -> DataFrame:
    """B76. References of SQL in code, from the file."""
    rows = lines(files).withColumns({"origin": F.col("rel_path"), "origin_type": F.lit("file")})
    return references(rows).withColumns(evidence())

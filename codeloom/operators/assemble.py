"""Assembly: upserts of entity and edge facts, graph summary, merging of graphs, dependency filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions.exprs import edge_id, entity_id, package_root, python_package, string_value
from codeloom.sources.tables import SMALL_IDS, cut
from codeloom.vocabulary import INTERACTION_DEPENDENCY_SCOPES, INTERACTION_EDGE_TYPES, INTERACTION_EVIDENCE_KEYS, INTERACTION_KINDS, INTERACTION_TARGET_BOUNDARIES


def upsert_entities(facts: DataFrame) -> DataFrame:
    """C01. One row an entity: the first fact (by seq) fixes name, path and line; aliases are united; of each property the last non-null value stays."""
    facts = facts.withColumn("entity_id", entity_id())
    firsts = F.min_by(F.struct("entity_type", "name", "source_name", "file_path", "line_number"), "seq")
    rows = facts.groupBy("entity_id").agg(firsts.alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"), F.min("seq").alias("seq"))
    values = facts.select("entity_id", "seq", F.explode("properties").alias("k", "v")).where("v is not null")
    merged = values.groupBy("entity_id", "k").agg(F.max_by("v", "seq").alias("v")).groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    return rows.join(merged, "entity_id", "left").select(
        "entity_id", "f.*", "aliases", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"), "seq"
    )


def _last_facts(facts: DataFrame) -> DataFrame:
    """The last fact by seq of each edge_id, whole."""
    names = [c for c in facts.columns if c != "edge_id"]
    return facts.groupBy("edge_id").agg(F.max_by(F.struct(*names), "seq").alias("l")).select("edge_id", "l.*")


def upsert_edges(facts: DataFrame) -> DataFrame:
    """C02. One row an edge: the last fact by seq, whole.

    Hashes of ids tell which edges may have several facts. If these are few, they go to the facts, and only their facts are shuffled.
    """
    facts = facts.select(edge_id().alias("edge_id"), *[c for c in facts.columns if c != "edge_id"])
    hashed = facts.withColumn("_hash", F.xxhash64("edge_id"))
    turn = F.row_number().over(Window.partitionBy("_hash").orderBy("_hash"))
    repeated = cut(hashed.select("_hash", turn.alias("turn")).where("turn = 2").select("_hash"))
    if repeated.count() > SMALL_IDS:
        return _last_facts(facts)
    once, several = (hashed.join(F.broadcast(repeated), "_hash", how).drop("_hash") for how in ("left_anti", "left_semi"))
    return once.unionByName(_last_facts(several))


def reference_id(ref: str) -> Column:
    """C03. The id of an entity reference struct: its own id, else that of its source, type, name and path; NULL without a source."""
    own = F.when(F.col(f"{ref}.source_name").isNotNull(), entity_id(f"{ref}.source_name", f"{ref}.entity_type", f"{ref}.name", f"{ref}.file_path"))
    return F.coalesce(F.col(f"{ref}.entity_id"), own)


def edges_from_facts(facts: DataFrame) -> DataFrame:
    """C03. Edge facts with ids from relationship facts; a fact without a known origin raises when the rows are read."""
    start = reference_id("from_ref")
    known = F.when(start.isNotNull(), start).otherwise(F.raise_error(F.concat(F.lit("no origin: "), F.coalesce("from_ref.name", F.lit("?")))))
    end = F.coalesce(F.col("to_ref.entity_id"), F.when(F.coalesce("resolved", F.lit(True)) & F.col("to_ref.source_name").isNotNull(), reference_id("to_ref")))
    return facts.select(
        "seq", known.alias("from_entity_id"), F.col("from_ref.name").alias("from_name"), F.col("from_ref.entity_type").alias("from_type"),
        F.col("to_ref.name").alias("to_name"), F.col("to_ref.entity_type").alias("to_type"), end.alias("to_entity_id"), "edge_type",
        F.coalesce("resolved", end.isNotNull()).alias("resolved"), "source_name", "file_path", "line_number", "identity_key", "confidence", "parser", "properties",
    )


def merge_graphs(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """C13. Entities and edges of several graphs, upserted in the order given."""
    def numbered(which: int) -> DataFrame:
        out = None
        for i, g in enumerate(graphs):
            part = g[which].withColumn("seq", F.struct(F.lit(i).alias("graph"), F.col("entity_id" if which == 0 else "edge_id").alias("id")))
            out = part if out is None else out.unionByName(part)
        return out.drop("entity_id" if which == 0 else "edge_id")

    # Graphs that are merged may share most edges, so that few hashes would not tell them.
    return upsert_entities(numbered(0)), _last_facts(numbered(1).withColumn("edge_id", edge_id()))


def summary(sources: DataFrame, entities: DataFrame, edges: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """C12. metric, key, count: totals, entities and edges by type, resolved and unresolved edges, errors."""
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "count")
    out = total(sources, "sources").unionByName(total(entities, "entities")).unionByName(total(edges, "edges"))
    out = out.unionByName(total(edges.where("resolved"), "resolved_edges")).unionByName(total(edges.where("not resolved"), "unresolved_edges"))
    out = out.unionByName(entities.groupBy(F.col("entity_type").alias("key")).count().select(F.lit("entity_type").alias("metric"), "key", "count"))
    out = out.unionByName(edges.groupBy(F.col("edge_type").alias("key")).count().select(F.lit("edge_type").alias("metric"), "key", "count"))
    return out.unionByName(total(issues, "errors")) if issues is not None else out


def require_no_issues(issues: DataFrame) -> None:
    """C14. Strict mode: raises where there is an issue."""
    found = issues.select("message").limit(1).collect()
    if found:
        raise ValueError(f"strict build: {found[0]['message']}")


def fact_issues(facts: DataFrame) -> DataFrame:
    """B05. One row for each violation of the evidence rules of interaction edges."""
    allowed = dict(zip(INTERACTION_EVIDENCE_KEYS, (INTERACTION_TARGET_BOUNDARIES, INTERACTION_DEPENDENCY_SCOPES, INTERACTION_KINDS)))

    def fault(key: str, values: list[str]) -> Column:
        value = string_value(F.col("properties")[key])
        return F.when(value.isNull(), F.concat(F.lit(f"missing {key}"))).when(~value.isin(values), F.concat(F.lit(f"unknown {key}: "), value))

    faults = F.filter(F.array(*[fault(k, v) for k, v in allowed.items()]), lambda x: x.isNotNull())
    return facts.where(F.col("edge_type").isin(INTERACTION_EDGE_TYPES)).select("*", F.explode(faults).alias("message"))


def keep_dependency(include: list[str] = (), exclude: list[str] = (), include_resolved: bool = True, relative_imports: bool = True) -> Column:
    """C11. Whether a package dependency or import edge stays: exclusion beats being resolved, which beats inclusion; other edges stay."""
    names = F.array_distinct(F.filter(F.array(F.col("to_name"), F.col("properties")["raw_target"], F.col("properties")["normalized_target"]), lambda x: x.isNotNull()))
    both = F.array_union(names, F.array_union(F.transform(names, package_root), F.transform(names, python_package)))
    any_of = lambda patterns: F.exists(both, lambda x: F.expr("false") if not patterns else x.rlike("^(?:" + "|".join(patterns) + ")$"))
    relative = F.coalesce(F.col("properties")["import_kind"] == "relative", F.lit(False)) | F.coalesce(F.col("properties")["raw_target"].startswith("."), F.lit(False))
    keep = F.when(any_of(list(exclude)), False).when(relative, relative_imports).when(F.lit(include_resolved) & F.col("resolved"), True)
    keep = keep.otherwise(any_of(list(include)) if include else F.lit(True))
    return F.when(F.col("edge_type").isin("IMPORTS", "DEPENDS_ON_PACKAGE"), keep).otherwise(F.lit(True))

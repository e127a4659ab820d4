"""Resolution of textual references to entities, without expanding edges into candidates.

Entities are first counted per lookup key; an edge joins these counts, so a name
that thousands of entities share costs each edge one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions.exprs import entity_id, normalize_key
from codeloom.sources.tables import cut, small
from codeloom.vocabulary import CACHE_ENTITY_TYPES, EXTERNAL_ENTITY_TYPES, EXTERNAL_SOURCE, MESSAGE_ENTITY_TYPES, SQL_ENTITY_TYPES, STORAGE_ENTITY_TYPES

ANY, SQL_OBJECT = "*", "sql_object"
CANDIDATES = 25


def external_resources(edges: DataFrame) -> DataFrame:
    """C04. One shared entity for each (type, name) of message, storage and cache targets that no edge binds."""
    wanted = edges.where(F.col("to_entity_id").isNull() & F.col("to_type").isin(EXTERNAL_ENTITY_TYPES) & (F.col("to_name") != "")).select("to_type", "to_name").distinct()
    boundary = F.when(F.col("to_type").isin(MESSAGE_ENTITY_TYPES), "messaging").when(F.col("to_type").isin(STORAGE_ENTITY_TYPES), "storage").when(F.col("to_type").isin(CACHE_ENTITY_TYPES), "cache")
    named = wanted.select(
        F.col("to_type").alias("entity_type"), F.col("to_name").alias("name"), F.lit(EXTERNAL_SOURCE).alias("source_name"), F.lit(None).cast("string").alias("file_path"),
        F.lit(None).cast("int").alias("line_number"), F.array(normalize_key("to_name")).alias("aliases"),
        F.create_map(F.lit("resource_boundary"), boundary, F.lit("canonical_external_resource"), F.lit("true")).alias("properties"),
    )
    return named.select(entity_id().alias("entity_id"), "*")


def _is_candidate() -> Column:
    sql = F.col("entity_type").startswith("sql_") | (F.col("entity_type") == "stored_procedure")
    return ~(sql & (F.coalesce(F.col("properties")["schema_state"], F.lit("")) == "historical"))


def lookup(entities: DataFrame) -> DataFrame:
    """C05. (group, key, entity_id, entity_type, name, source_name): group is a type, sql_object or *."""
    p = F.col("properties")
    qualified = F.when(F.coalesce(p["schema"], F.lit("")) != "", F.concat_ws(".", p["schema"], F.col("name")))
    keys = F.array_union(F.array(F.col("name"), p["full_name"], qualified), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = F.array_distinct(F.transform(F.filter(keys, lambda k: k.isNotNull()), normalize_key))
    groups = F.when(F.col("entity_type").isin(SQL_ENTITY_TYPES), F.array(F.col("entity_type"), F.lit(SQL_OBJECT), F.lit(ANY))).otherwise(F.array(F.col("entity_type"), F.lit(ANY)))
    rows = entities.where(_is_candidate()).select("entity_id", "entity_type", "name", "source_name", F.explode(keys).alias("key"), groups.alias("groups"))
    return rows.select(F.explode("groups").alias("group"), "key", "entity_id", "entity_type", "name", "source_name")


def tiers(to_type: str | Column = "to_type") -> Column:
    """C07. The groups tried one after another for a target type."""
    t = F.col(to_type) if isinstance(to_type, str) else to_type
    service = F.array(*[F.lit(x) for x in ("service", "project", "repository", ANY)])
    return F.when(t == "service", service).when(F.coalesce(t, F.lit("")) != "", F.array(t, F.lit(ANY))).otherwise(F.array(F.lit(ANY)))


def _is_external() -> Column:
    return F.col("to_type").isin(EXTERNAL_ENTITY_TYPES) & (F.col("to_name") != "")


def settle(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What resolution has to know, of different references instead of edges, each table stored.

    external: resources without an entity; choices: (to_type, to_name, source_name) with what they resolve to; missing: given target ids without an entity.
    """
    refs = cut(edges.where("to_entity_id is null").select("to_type", "to_name", "source_name").distinct())
    shared = cut(_new_resources(entities, external_resources(refs.withColumn("to_entity_id", F.lit(None).cast("string")))))
    whole = entities.unionByName(shared.select(*entities.columns))

    open_ = refs.where(~F.coalesce(_is_external(), F.lit(False))).withColumn("key", normalize_key("to_name"))
    tried = open_.select(F.col("to_type").alias("ref_type"), F.col("key").alias("ref_key")).distinct().select("ref_type", "ref_key", F.posexplode(tiers("ref_type")).alias("tier", "group"))
    wanted = cut(tried.select("group", F.col("ref_key").alias("key")).where("key is not null").distinct())
    found = lookup(whole).join(small(wanted), ["group", "key"], "left_semi").select("group", "key", "entity_id", "entity_type", "source_name").distinct()
    one = F.min(F.struct("entity_id", "entity_type", "source_name"))
    by_source = found.groupBy("group", "key", F.col("source_name").alias("source")).agg(F.count(F.lit(1)).alias("same"), one.alias("own"))
    by_source = cut(by_source)
    by_key = by_source.groupBy("group", "key").agg(F.sum("same").alias("n"), F.min("own").alias("one"))
    hits = tried.join(by_key, (tried["group"] == by_key["group"]) & (tried["ref_key"] == by_key["key"])).select("ref_type", "ref_key", "tier", tried["group"], "n", "one")
    first = hits.groupBy("ref_type", "ref_key").agg(F.min(F.struct("tier", "group", "n", "one")).alias("h")).select("ref_type", "ref_key", F.col("h.group").alias("hit_group"), F.col("h.n").alias("n"), F.col("h.one").alias("one"))
    met = open_.join(first, open_["to_type"].eqNullSafe(first["ref_type"]) & (open_["key"] == first["ref_key"]))
    met = met.join(by_source, (met["hit_group"] == by_source["group"]) & (met["ref_key"] == by_source["key"]) & (met["source_name"] == by_source["source"]), "left")
    choice = F.when(F.col("same") == 1, F.col("own")).when(F.coalesce("same", F.lit(0)) > 1, F.lit(None)).when(F.col("n") == 1, F.col("one"))
    choices = cut(met.select(F.col("to_type").alias("_type"), F.col("to_name").alias("_name"), F.col("source_name").alias("_source"), "hit_group", "n", choice.alias("choice")))

    given = edges.where("to_entity_id is not null").select(F.col("to_entity_id").alias("_missing")).distinct()
    ids = whole.select(F.col("entity_id").alias("_missing"))
    return shared, choices, cut(given.join(ids, "_missing", "left_anti"))


def _new_resources(entities: DataFrame, shared: DataFrame) -> DataFrame:
    known = entities.select("entity_id").join(shared.select("entity_id"), "entity_id", "left_semi").distinct()
    return shared.join(known, "entity_id", "left_anti").select(*entities.columns)


def resolve(entities: DataFrame, edges: DataFrame, mark_bound: bool = False) -> tuple[DataFrame, DataFrame]:
    """C04 to C10. Entities with external resources, and edges with to_entity_id, to_type, resolved, status and candidates.

    Bound edges are resolved if their target exists. Of the candidates of the first
    tier that has any, the only one of the edge's source wins; several of the source
    make it ambiguous; without one of the source the only candidate wins.

    Edges are not shuffled: settle() works on their different references, whose results the edges look up.
    Where edges carry target_source, that of a given target, the resolved ones carry it too.
    With mark_bound they say in bound whether their target was given.
    """
    shared, choices, missing = settle(entities, edges)
    external, bound = F.coalesce(_is_external(), F.lit(False)), F.col("to_entity_id").isNotNull()
    refers = ~bound & ~external & F.col("to_type").eqNullSafe(F.col("_type")) & F.col("to_name").eqNullSafe(F.col("_name")) & F.col("source_name").eqNullSafe(F.col("_source"))
    met = edges.join(small(choices), refers, "left").join(small(missing), F.col("to_entity_id") == F.col("_missing"), "left")
    resource = ~bound & external
    names = [c for c in edges.columns if c not in ("to_entity_id", "to_type", "resolved", "target_source")]
    chosen, met_n = F.col("choice").isNotNull(), F.col("n").isNotNull()
    target = F.when(resource, entity_id(F.lit(EXTERNAL_SOURCE), "to_type", "to_name", F.lit(None))).otherwise(F.coalesce("to_entity_id", "choice.entity_id"))
    place = [F.when(resource, F.lit(EXTERNAL_SOURCE)).when(bound, F.when(F.col("_missing").isNull(), F.col("target_source"))).otherwise(F.col("choice.source_name")).alias("target_source")] if "target_source" in edges.columns else []
    settled = met.select(
        *names, target.alias("to_entity_id"), F.coalesce("choice.entity_type", "to_type").alias("to_type"), F.when(bound, F.col("_missing").isNull()).otherwise(resource | chosen).alias("resolved"),
        F.when(~chosen & met_n, "ambiguous").alias("resolution_status"), F.col("hit_group").alias("candidate_group"), F.when(chosen, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("candidate_count"), *place, *([bound.alias("bound")] if mark_bound else []),
    )
    return entities.unionByName(shared), settled


def candidates(entities: DataFrame, edges: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """C09. (to_type, key, place, entity_id, entity_type, name, source_name): the first candidates of each ambiguous reference.

    Candidates are ordered by their type's place among the SQL types, then by id.
    """
    refs = edges.where("resolution_status = 'ambiguous'").select("to_type", normalize_key("to_name").alias("key"), F.col("candidate_group").alias("group")).distinct()
    found = lookup(entities).join(refs, ["group", "key"])
    place = F.array_position(F.array(*[F.lit(t) for t in SQL_ENTITY_TYPES]), F.col("entity_type"))
    rank = F.row_number().over(Window.partitionBy("to_type", "key").orderBy(place, "entity_id"))
    return found.withColumn("place", rank).where(F.col("place") <= most).select("to_type", "key", "place", "entity_id", "entity_type", "name", "source_name")

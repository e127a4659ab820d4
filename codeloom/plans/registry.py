"""Queries over the driver tables, one per operator, with their SQL oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.api import Graph
from codeloom.functions.exprs import id_number, id_text
from codeloom.operators import assemble, payloads, reports, resolve, store, traverse
from codeloom.plans import graph_view, oracle_text as o
from codeloom.sources.tables import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


class View:
    """The graph of the driver tables: what tells its rows apart, and what its references resolve to, are stored once a session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def sources(self) -> DataFrame:
        return graph_view.sources(self.spark, self.sf_dir)

    @cached_property
    def raw_entities(self) -> DataFrame:
        return graph_view.entities(self.spark, self.sf_dir)

    @cached_property
    def raw_edges(self) -> DataFrame:
        return graph_view.edges(self.spark, self.sf_dir)

    @property
    def entities(self) -> DataFrame:
        return self._resolved[0]

    @property
    def edges(self) -> DataFrame:
        return self._resolved[1].drop("bound")

    @property
    def marked_edges(self) -> DataFrame:
        """The edges, with bound: whether their target was given."""
        return self._resolved[1]

    @property
    def _resolved(self) -> tuple[DataFrame, DataFrame]:
        """The graph as plans over what tells its rows apart and what its references resolve to, both stored once a session."""
        at = (self.spark.sparkContext.applicationId, self.sf_dir)
        if at not in _GRAPHS:
            _GRAPHS[at] = resolve.resolve(self.raw_entities, self.raw_edges, mark_bound=True)
        return _GRAPHS[at]


#: The resolved graphs of a session, by its tables' folder: plans, not rows.
_GRAPHS: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of a View under a name, with its SQL."""
    def register(f):
        _QUERIES[name] = lambda spark, sf_dir: f(View(spark, sf_dir))
        if oracle is not None:
            _ORACLES[name] = oracle
        return f
    return register


def queries() -> dict[str, Query]:
    from codeloom.plans import code_queries, more_queries

    return _QUERIES | more_queries.queries() | code_queries.queries()


def oracle_sql() -> dict[str, str]:
    from codeloom.plans import code_queries, more_queries

    return _ORACLES | more_queries.oracle_sql() | code_queries.oracle_sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge types with resolved and unresolved counts, after resolution of the whole graph."""
    _, edges = resolve.resolve(graph_view.entities(spark, sf_dir), graph_view.edges(spark, sf_dir))
    return store.edge_type_counts(edges)


_FLAT_EDGE = ["edge_id", "from_entity_id", "from_name", "edge_type", "to_name", "to_type", "to_entity_id", "resolved", "source_name", "line_number", "parser"]
_FLAT_ENTITY = ["entity_id", "entity_type", "name", "source_name", "file_path"]


def _count(x: str) -> F.Column:
    return F.col(x).cast("long").alias(x)


# Assembly and resolution

@query("c02_edge_upsert", o.graph("SELECT edge_type, source_name, count(DISTINCT edge_id) AS edges, min(edge_id) AS first_id, max(edge_id) AS last_id FROM edges GROUP BY ALL"))
def c02(v: View) -> DataFrame:
    facts = v.raw_edges.drop("edge_id").withColumn("seq", F.xxhash64("from_entity_id", "to_name"))
    edges = assemble.upsert_edges(facts).select("edge_type", "source_name", id_number("edge_id").alias("n"))
    found = edges.groupBy("edge_type", "source_name").agg(F.count(F.lit(1)).alias("edges"), F.min("n").alias("first"), F.max("n").alias("last"))
    return found.select("edge_type", "source_name", "edges", id_text("first").alias("first_id"), id_text("last").alias("last_id"))


@query("c01_entity_upsert", o.graph("SELECT entity_type, count(*) AS entities, count(alias) AS with_alias, count(schema_state) AS with_state, min(entity_id) AS first_id FROM entities GROUP BY entity_type"))
def c01(v: View) -> DataFrame:
    facts = v.raw_entities.drop("entity_id").withColumn("seq", F.lit(1)).unionByName(v.raw_entities.drop("entity_id").withColumn("seq", F.lit(2)))
    got = assemble.upsert_entities(facts)
    return got.groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.size("aliases") > 0).alias("with_alias"), F.count(F.col("properties")["schema_state"]).alias("with_state"), F.min("entity_id").alias("first_id"))


@query("c04_external_resources", o.graph("SELECT entity_id, entity_type, name, source_name FROM external"))
def c04(v: View) -> DataFrame:
    return resolve.external_resources(v.raw_edges).select("entity_id", "entity_type", "name", "source_name")


@query("c05_lookup_keys", o.graph("SELECT grp AS \"group\", key, count(*) AS entities, min(entity_id) AS first_id FROM lookup GROUP BY grp, key"))
def c05(v: View) -> DataFrame:
    return resolve.lookup(v.entities).groupBy("group", "key").agg(F.count(F.lit(1)).alias("entities"), F.min("entity_id").alias("first_id"))


@query("c08_resolved_edges", o.graph("SELECT edge_id, to_entity_id, to_type, resolved, status AS resolution_status, candidates AS candidate_count FROM resolved"))
def c08(v: View) -> DataFrame:
    return v.edges.select("edge_id", "to_entity_id", "to_type", "resolved", "resolution_status", "candidate_count")


@query("c09_ambiguity_candidates", o.graph(o.CANDIDATES))
def c09(v: View) -> DataFrame:
    return resolve.candidates(v.entities, v.edges).select("to_type", "key", F.col("place").cast("long").alias("place"), "entity_id", "entity_type", "source_name")


@query("c10_bound_edges", o.graph("SELECT edge_type, count(*) AS edges, count(*) FILTER (resolved) AS resolved FROM resolved WHERE edge_id IN (SELECT edge_id FROM edges WHERE to_entity_id IS NOT NULL) GROUP BY edge_type"))
def c10(v: View) -> DataFrame:
    return v.marked_edges.where("bound").groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.count_if("resolved").alias("resolved"))


@query("c11_dependency_filter", o.graph("SELECT edge_type, count(*) AS edges FROM resolved WHERE edge_type NOT IN ('IMPORTS', 'DEPENDS_ON_PACKAGE') OR (NOT regexp_full_match(to_name, '.*0') AND (resolved OR regexp_full_match(to_name, '.*[1-5]'))) GROUP BY edge_type", renamed=True))
def c11(v: View) -> DataFrame:
    edges = v.edges.withColumn("edge_type", F.when(F.col("edge_type") == "DEPENDS_ON_PROJECT", "DEPENDS_ON_PACKAGE").when(F.col("edge_type") == "CONFIGURES_SERVICE", "IMPORTS").otherwise(F.col("edge_type")))
    kept = edges.where(assemble.keep_dependency(include=[".*[1-5]"], exclude=[".*0"]))
    return kept.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"))


@query("c12_graph_summary", o.graph(o.SUMMARY))
def c12(v: View) -> DataFrame:
    return assemble.summary(v.sources, v.entities, v.edges)


@query("c13_merge_graphs", o.graph("SELECT 'entities' AS kind, count(DISTINCT entity_id) AS n, min(entity_id) AS first_id FROM entities UNION ALL SELECT 'edges', count(DISTINCT edge_id), min(edge_id) FROM edges"))
def c13(v: View) -> DataFrame:
    halves = [(v.raw_entities.where(c), v.raw_edges.where(c)) for c in ("source_name < 'NATION_2'", "source_name >= 'NATION_15'")]
    rest = (v.raw_entities.where("source_name >= 'NATION_2'"), v.raw_edges.where("source_name >= 'NATION_2'"))
    entities, edges = assemble.merge_graphs(halves[0], rest, halves[1])
    tally = lambda df, kind, c: df.agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("first_id")).select(F.lit(kind).alias("kind"), "n", "first_id")
    return tally(entities, "entities", "entity_id").unionByName(tally(edges, "edges", "edge_id"))


@query("b05_fact_validation", o.graph("SELECT edge_type, 'missing ' || k AS message, count(*) AS issues FROM edges, (VALUES ('target_boundary'), ('dependency_scope'), ('interaction_kind')) AS t(k) WHERE edge_type = 'CALLS_SQL' AND line_number = 1 GROUP BY ALL"))
def b05(v: View) -> DataFrame:
    broken = v.raw_edges.withColumn("properties", F.when((F.col("edge_type") == "CALLS_SQL") & (F.col("line_number") == 1), F.create_map().cast("map<string,string>")).otherwise(F.col("properties")))
    return assemble.fact_issues(broken).groupBy("edge_type", "message").agg(F.count(F.lit(1)).alias("issues"))


# Store writes

@query("d01_edge_records", o.graph("SELECT edge_type AS relationship_type, resolved, count(*) AS edges, count(DISTINCT CASE WHEN NOT resolved THEN source_name || '|' || to_type || '|' || to_name END) AS targets FROM resolved GROUP BY ALL"))
def d01(v: View) -> DataFrame:
    return store.edge_records(v.edges).groupBy("relationship_type", "resolved").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("target_id").alias("targets"))


@query("d01_target_records", o.graph("SELECT DISTINCT substr(sha256('unresolved|' || source_name || '|' || to_type || '|' || to_name), 1, 24) AS target_id, source_name, to_type AS target_type, to_name AS name FROM resolved WHERE NOT resolved"))
def d01_targets(v: View) -> DataFrame:
    return store.target_records(v.edges)


@query("d04_merge_records", o.graph("SELECT entity_id, name || CASE WHEN entity_type = 'service' THEN '!' ELSE '' END AS name, source_name FROM entities WHERE entity_type IN ('service', 'project')"))
def d04(v: View) -> DataFrame:
    old = v.raw_entities.where("entity_type in ('service', 'project')").select("entity_id", "name", "source_name")
    new = v.raw_entities.where("entity_type = 'service'").select("entity_id", F.concat("name", F.lit("!")).alias("name"), F.lit(None).cast("string").alias("source_name"))
    return store.merge(old, new, "entity_id")


@query("d05_linked_edges", o.graph("SELECT edge_type, count(*) AS edges FROM resolved WHERE from_entity_id IN (SELECT entity_id FROM entities WHERE source_name <> 'NATION_3') AND (NOT resolved OR to_entity_id IN (SELECT entity_id FROM all_entities WHERE source_name <> 'NATION_3')) GROUP BY edge_type"))
def d05(v: View) -> DataFrame:
    return store.linked_edges(v.edges, v.entities.where("source_name <> 'NATION_3'")).groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"))


@query("d06_replace_sources", o.graph("""SELECT 'entities' AS kind, count(*) AS n FROM all_entities WHERE source_name <> 'NATION_3' OR entity_type <> 'service' UNION ALL
SELECT 'edges', count(*) FROM resolved WHERE source_name = 'NATION_3' AND edge_type = 'CALLS_SQL' OR source_name <> 'NATION_3' AND coalesce(to_entity_id, '') NOT IN (SELECT entity_id FROM entities WHERE source_name = 'NATION_3')"""))
def d06(v: View) -> DataFrame:
    new = (v.entities.where("source_name = 'NATION_3' and entity_type <> 'service'"), v.edges.where("source_name = 'NATION_3' and edge_type = 'CALLS_SQL'"))
    entities, edges = store.replace_sources((v.entities, v.edges), new, ["NATION_3"])
    tally = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return tally(entities, "entities").unionByName(tally(edges, "edges"))


@query("d07_orphans", o.graph("SELECT entity_type, count(*) AS entities FROM all_entities WHERE source_name <> 'external-resources' OR entity_id IN (SELECT to_entity_id FROM resolved WHERE to_name <> 'error') GROUP BY entity_type"))
def d07(v: View) -> DataFrame:
    return store.without_orphans(v.entities, v.edges.where("to_name <> 'error'")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"))


@query("d07_orphan_targets", o.graph("SELECT DISTINCT substr(sha256('unresolved|' || source_name || '|' || to_type || '|' || to_name), 1, 24) AS target_id, to_name AS name FROM resolved WHERE NOT resolved AND edge_type <> 'CALLS_SQL'"))
def d07_targets(v: View) -> DataFrame:
    return store.without_orphan_targets(store.target_records(v.edges), v.edges.where("edge_type <> 'CALLS_SQL'")).select("target_id", "name")


@query("d02_unique_keys", o.graph("SELECT entity_type, count(*) AS entities, count(*) AS names FROM all_entities GROUP BY entity_type"))
def d02(v: View) -> DataFrame:
    twice = v.entities.select("entity_id", "entity_type", "name").unionByName(v.entities.select("entity_id", "entity_type", F.concat(F.lit("~"), "name").alias("name")))
    return store.unique(twice, "entity_id").groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.startswith("name", F.lit("~"))).alias("names"))


@query("d08_load_summary", o.graph("SELECT (SELECT count(*) FROM nation) AS sources, (SELECT count(*) FROM all_entities) AS entities, (SELECT count(*) FROM resolved) AS edges, (SELECT count(DISTINCT source_name || '|' || to_type || '|' || to_name) FROM resolved WHERE NOT resolved) AS targets"))
def d08(v: View) -> DataFrame:
    return store.load_summary(v.sources, v.entities, v.edges)


# Store reads

@query("e01_search_entities", o.graph("SELECT entity_id, entity_type, name, source_name FROM all_entities WHERE contains(lower(name), 'blue') OR contains(lower(coalesce(full_name, '')), 'blue') OR contains(lower(coalesce(alias, '')), 'blue') OR contains(lower(coalesce(file_path, '')), 'blue') ORDER BY entity_type, source_name, name, entity_id LIMIT 100"))
def e01(v: View) -> DataFrame:
    return store.search_entities(v.entities, "Blue", limit=100).select("entity_id", "entity_type", "name", "source_name")


@query("e02_entities_by_types", o.graph("SELECT entity_id, entity_type, name, source_name, file_path FROM all_entities WHERE entity_type IN ('service', 'repository') ORDER BY entity_type, source_name, name, entity_id LIMIT 1000"))
def e02(v: View) -> DataFrame:
    return store.entities_by_types(v.entities, ["service", "repository"]).select(*_FLAT_ENTITY)


@query("e03_entity", o.graph(f"SELECT entity_id, entity_type, name, source_name, file_path FROM all_entities WHERE entity_id = {o.ROOT}"))
def e03(v: View) -> DataFrame:
    return store.entity(v.entities, o.ROOT_ID).select(*_FLAT_ENTITY)


@query("e04_search_relationships", o.graph("SELECT edge_id, edge_type, to_name, source_name, target_source FROM targeted WHERE source_name = 'NATION_1' AND from_type = 'api_route' AND resolved ORDER BY source_name, edge_type, to_name, edge_id LIMIT 100"))
def e04(v: View) -> DataFrame:
    return store.search_edges(v.edges, v.entities, from_source="NATION_1", from_type="api_route", resolved=True).select("edge_id", "edge_type", "to_name", "source_name", "target_source")


@query("e05_relationships_by_types", o.graph("SELECT edge_id, edge_type, to_name, source_name, target_source FROM targeted WHERE target_source = 'NATION_2' AND edge_type IN ('CALLS_SERVICE', 'CONFIGURES_SERVICE') ORDER BY source_name, edge_type, to_name, edge_id LIMIT 1000"))
def e05(v: View) -> DataFrame:
    return store.search_edges(v.edges, v.entities, to_source="NATION_2", edge_types=["CALLS_SERVICE", "CONFIGURES_SERVICE"], limit=1000).select("edge_id", "edge_type", "to_name", "source_name", "target_source")


def _trails(v: View, direction: str) -> DataFrame:
    start = v.entities.where("entity_type = 'service'").select(F.col("entity_id").alias("root"))
    got = traverse.trails(v.edges, start, direction, 2, ["CALLS_SERVICE", "CONFIGURES_SERVICE", "DEPENDS_ON_PROJECT", "CONSUMES_MESSAGE"])
    return got.groupBy("root", "depth", "edge_type").agg(F.count(F.lit(1)).alias("trails"), F.count_distinct("neighbor_id").alias("nodes"), F.min(F.array_join("path", "|")).alias("first_path"))


@query("e06_out_neighbors", o.graph(o.trails("out")))
def e06(v: View) -> DataFrame:
    return _trails(v, "out")


@query("e07_in_neighbors", o.graph(o.trails("in")))
def e07(v: View) -> DataFrame:
    return _trails(v, "in")


@query("e08_both_neighbors", o.graph(o.NEIGHBORS))
def e08(v: View) -> DataFrame:
    return traverse.neighbors(v.edges, o.ROOT_ID, "both", 1, limit=200).select("direction", _count("depth"), "edge_id", "edge_type", "neighbor_id")


@query("e09_unresolved_edges", o.graph("SELECT edge_id, edge_type, to_name, source_name FROM resolved WHERE NOT resolved AND edge_type = 'CALLS_HTTP' ORDER BY source_name, edge_type, to_name, edge_id LIMIT 1000"))
def e09(v: View) -> DataFrame:
    return store.unresolved_edges(v.edges, edge_type="CALLS_HTTP", limit=1000).select("edge_id", "edge_type", "to_name", "source_name")


@query("e10_stats", o.graph("SELECT (SELECT count(*) FROM nation) AS sources, (SELECT count(*) FROM all_entities) AS entities, count(*) AS edges, count(*) FILTER (resolved) AS resolved_edges, count(*) FILTER (NOT resolved) AS unresolved_edges FROM resolved"))
def e10(v: View) -> DataFrame:
    return store.stats(v.sources, v.entities, v.edges)


@query("e11_scope", "SELECT 'tpch' AS scope_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS source_names FROM nation")
def e11(v: View) -> DataFrame:
    return store.scope(v.sources, "tpch").withColumn("source_names", F.array_join("source_names", ","))


@query("e12_entity_type_counts", o.graph("SELECT entity_type, count(*) AS count FROM all_entities GROUP BY entity_type"))
def e12(v: View) -> DataFrame:
    return store.entity_type_counts(v.entities)


@query("e13_edge_type_counts", o.graph("SELECT edge_type, count(*) AS count, count(*) FILTER (resolved) AS resolved_count, count(*) FILTER (NOT resolved) AS unresolved_count FROM resolved GROUP BY edge_type"))
def e13(v: View) -> DataFrame:
    return store.edge_type_counts(v.edges)


@query("e14_source_metadata", "SELECT n_nationkey::BIGINT AS index, n_name AS name, 'local_path' AS type, '/src/' || lower(n_name) AS path FROM nation")
def e14(v: View) -> DataFrame:
    return v.sources


@query("e16_source_activity", o.graph("SELECT n_name AS name, coalesce((SELECT count(*) FROM all_entities WHERE source_name = n_name), 0) AS entity_count, coalesce((SELECT count(*) FROM resolved WHERE source_name = n_name), 0) AS edge_count FROM nation"))
def e16(v: View) -> DataFrame:
    return store.source_activity(v.sources, v.entities, v.edges).select("name", "entity_count", "edge_count")


@query("e17_cross_source", o.graph("SELECT source_name AS from_source, target_source AS to_source, edge_type, count(*) AS count FROM targeted WHERE resolved AND source_name <> target_source GROUP BY ALL"))
def e17(v: View) -> DataFrame:
    return store.cross_source(v.edges, v.entities)


@query("e19_source_summary", o.graph("SELECT (SELECT count(*) FROM all_entities WHERE source_name = 'NATION_7') AS entities, count(*) AS edges, count(*) FILTER (resolved) AS resolved_edges FROM resolved WHERE source_name = 'NATION_7'"))
def e19(v: View) -> DataFrame:
    return store.source_summary(v.entities, v.edges, "NATION_7")


@query("e20_source_type_counts", o.graph("SELECT source_name, edge_type, count(*) AS count, count(*) FILTER (resolved) AS resolved_count, count(*) FILTER (NOT resolved) AS unresolved_count FROM resolved GROUP BY ALL"))
def e20(v: View) -> DataFrame:
    return store.edge_type_counts(v.edges, by_source=True)


@query("e21_owned_surface", o.graph("SELECT entity_id, entity_type, name, source_name, file_path FROM all_entities WHERE source_name = 'NATION_7' AND entity_type IN ('api_route', 'project', 'service', 'sql_table') ORDER BY entity_type, source_name, name, entity_id LIMIT 1000"))
def e21(v: View) -> DataFrame:
    return store.owned_surface(v.entities, "NATION_7").select(*_FLAT_ENTITY)


@query("e22_source_uses", o.graph("SELECT edge_type, to_type, to_name, target_source, count(*) AS count, count(*) FILTER (resolved) AS resolved_count, arg_min(file_path, edge_id) AS file_path, arg_min(line_number, edge_id) AS line_number FROM targeted WHERE source_name = 'NATION_7' GROUP BY ALL"))
def e22(v: View) -> DataFrame:
    return store.source_uses(v.edges, v.entities, "NATION_7")


@query("e23_incoming_cross_source", o.graph("SELECT source_name AS from_source, target_source AS to_source, edge_type, count(*) AS count FROM targeted WHERE resolved AND source_name <> target_source AND target_source = 'NATION_7' GROUP BY ALL"))
def e23(v: View) -> DataFrame:
    return store.cross_source(v.edges, v.entities, "NATION_7", "in")


@query("e25_payload", o.graph(o.PAYLOADS))
def e25(v: View) -> DataFrame:
    return store.payload(v.entities.select(*_FLAT_ENTITY))


_AT = lambda path, name: F.get_json_object("json", path).alias(name)


@query("e25_neighbor_payloads", o.graph(f"SELECT n.direction, n.neighbor_id, n.edge_id, e.edge_type, e.from_name, e.to_name, x.name AS neighbor_name, x.entity_type AS neighbor_type, '1' AS depth, e.from_entity_id AS step_from, e.to_entity_id AS step_to, false AS has_null FROM ({o.NEIGHBORS}) n JOIN resolved e ON e.edge_id = n.edge_id JOIN all_entities x ON x.entity_id = n.neighbor_id"))
def e25_neighbors(v: View) -> DataFrame:
    """Read back from the JSON: edge, neighbour and the one step of each path."""
    items = payloads.neighbors(traverse.neighbors(v.edges, o.ROOT_ID, "both", 1, limit=200), v.edges, v.entities).select(payloads.as_json("payload").alias("json"))
    return items.select(
        _AT("$.direction", "direction"), _AT("$.neighbor.entity_id", "neighbor_id"), _AT("$.path.edge_ids[0]", "edge_id"), _AT("$.edge.edge_type", "edge_type"), _AT("$.edge.from_name", "from_name"), _AT("$.path.edges[0].to_name", "to_name"),
        _AT("$.neighbor.name", "neighbor_name"), _AT("$.neighbor.entity_type", "neighbor_type"), _AT("$.depth", "depth"), _AT("$.path.steps[0].from.entity_id", "step_from"), _AT("$.path.nodes[1].entity_id", "step_to"), F.col("json").contains(":null").alias("has_null"),
    )


@query("g04_radius_payloads", o.graph(o.BLAST_PATHS))
def g04(v: View) -> DataFrame:
    """The nodes of each path, read back from the JSON, and whether its steps hang together."""
    items = payloads.radius(_blast(v), v.edges, v.entities)
    path = F.col("payload.path")
    whole = F.forall(F.sequence(F.lit(1), F.size(path["steps"])), lambda i: (F.get(path["steps"], i - 1)["from"]["entity_id"] == F.get(path["node_ids"], i - 1)) & (F.get(path["steps"], i - 1)["to"]["entity_id"] == F.get(path["node_ids"], i)))
    return items.select("next_id", F.get_json_object(payloads.as_json("payload"), "$.depth").cast("long").alias("depth"), F.size(path["nodes"]).cast("long").alias("nodes"), F.get(path["node_ids"], 0).alias("first"), F.element_at(path["node_ids"], -1).alias("last"), whole.alias("whole"), "truncated")


@query("g43_neighbor_groups", o.graph(o.NEIGHBOR_EVIDENCE))
def g43(v: View) -> DataFrame:
    found = payloads.groups(payloads.neighbors(traverse.neighbors(v.edges, o.ROOT_ID, "both", 1, limit=200), v.edges, v.entities))
    return found.select("direction", "edge_type", "source_name", "neighbor_type", "count", _count("min_depth"), F.get_json_object(F.get("examples", 0), "$.edge.edge_id").alias("first_edge"), F.size("examples").cast("long").alias("examples"))


# Reports

def _blast(v: View) -> DataFrame:
    """All that depends on the root within two steps, over all sources' edges."""
    return traverse.blast_radius(v.edges, v.entities, o.ROOT_ID, "in", 2, None, traverse.profile_types("impact"))


@query("g01_blast_radius", o.graph(o.BLAST))
def g01(v: View) -> DataFrame:
    return _blast(v).select("next_id", _count("depth"))


@query("g05_affected_sources", o.graph(o.BLAST_SOURCES))
def g05(v: View) -> DataFrame:
    return traverse.affected_sources(_blast(v)).select("source", "count", _count("min_depth"))


# The same under the names that they had while g01 and g05 read one source's edges.
g01_all, g05_all = query("g01_blast_radius_all_sources", o.graph(o.BLAST))(g01), query("g05_affected_sources_all_sources", o.graph(o.BLAST_SOURCES))(g05)


@query("g06_path_groups", o.graph(o.PATH_GROUPS))
def g06(v: View) -> DataFrame:
    return traverse.path_groups(traverse.blast_radius(v.edges, v.entities, o.ROOT_ID, "both", 2, None, None))


@query("g07_radius_summary", o.graph(o.RADIUS_SUMMARY))
def g07(v: View) -> DataFrame:
    return traverse.radius_summary(traverse.blast_radius(v.edges, v.entities, o.ROOT_ID, "both", 3, None, None))


@query("g11_interaction_groups", o.graph(o.INTERACTIONS + " SELECT * FROM inter"))
def g11(v: View) -> DataFrame:
    return reports.interaction_groups(reports.interaction_edges(v.edges, v.entities))


@query("g12_interaction_sources", o.graph(o.INTERACTIONS + " SELECT from_source AS source_name, sum(count)::BIGINT AS count, count(*) AS group_count, string_agg(DISTINCT target_source, ',' ORDER BY target_source) AS target_sources, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS edge_types FROM inter GROUP BY from_source ORDER BY count DESC, source_name LIMIT 10"))
def g12(v: View) -> DataFrame:
    return reports.interaction_source_hotspots(reports.interaction_groups(reports.interaction_edges(v.edges, v.entities), examples=0))


@query("g13_interaction_targets", o.graph(o.INTERACTIONS + " SELECT target_source, to_type, to_name, sum(count)::BIGINT AS count, count(*) AS group_count, string_agg(DISTINCT from_source, ',' ORDER BY from_source) AS from_sources, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS edge_types FROM inter GROUP BY target_source, to_type, to_name ORDER BY count DESC, coalesce(target_source, ''), to_type, to_name LIMIT 10"))
def g13(v: View) -> DataFrame:
    return reports.interaction_target_hotspots(reports.interaction_groups(reports.interaction_edges(v.edges, v.entities), examples=0))


@query("g14_interaction_summary", o.graph(o.INTERACTIONS + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS key, sum(count)::BIGINT AS count FROM inter GROUP BY {m}" for m in ("target_boundary", "dependency_scope", "interaction_kind", "edge_type"))))
def g14(v: View) -> DataFrame:
    return reports.interaction_summary(reports.interaction_groups(reports.interaction_edges(v.edges, v.entities), examples=0))


@query("g21_unresolved_groups", o.graph(o.UNRESOLVED + " SELECT * FROM unres"))
def g21(v: View) -> DataFrame:
    return reports.unresolved_groups(v.edges)


@query("g22_unresolved_sources", o.graph(o.UNRESOLVED + " SELECT source_name, count(*) AS count, count(DISTINCT edge_type || '|' || to_type || '|' || to_name || '|' || classification) AS group_count, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS edge_types FROM classed GROUP BY source_name ORDER BY count DESC, source_name LIMIT 10"))
def g22(v: View) -> DataFrame:
    return reports.unresolved_source_hotspots(v.edges).drop("classifications")


@query("g23_unresolved_targets", o.graph(o.UNRESOLVED + " SELECT to_type, to_name, count(*) AS count, count(DISTINCT edge_type || '|' || classification) AS group_count, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS edge_types, string_agg(DISTINCT source_name, ',' ORDER BY source_name) AS source_names FROM classed GROUP BY to_type, to_name ORDER BY count DESC, to_type, to_name LIMIT 10"))
def g23(v: View) -> DataFrame:
    return reports.unresolved_target_hotspots(v.edges).drop("classifications")


@query("g24_unresolved_classes", o.graph(o.UNRESOLVED + " SELECT classification, sum(count)::BIGINT AS count, count(*) AS group_count, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS edge_types FROM unres GROUP BY classification"))
def g24(v: View) -> DataFrame:
    return reports.unresolved_classes(v.edges).drop("rank")


@query("g25_unresolved_summary", o.graph(o.UNRESOLVED + " SELECT count(*) AS edges, (SELECT count(*) FROM unres) AS groups, count(DISTINCT source_name) AS sources, count(*) FILTER (classification = 'likely_missing_source') AS likely_missing_source, count(*) FILTER (classification = 'likely_parser_gap') AS likely_parser_gap, count(*) FILTER (classification = 'ambiguous_target') AS ambiguous_target, count(*) FILTER (classification = 'needs_review') AS needs_review FROM classed"))
def g25(v: View) -> DataFrame:
    return reports.unresolved_summary(v.edges)


@query("g37_reconciliation_groups", o.graph(o.RECONCILIATION + " SELECT * FROM recon"))
def g37(v: View) -> DataFrame:
    return reports.reconciliation_groups(v.edges, v.entities).drop("rank")


@query("g37_reconciliation_classes", o.graph(o.RECONCILIATION + " SELECT classification, sum(count)::BIGINT AS count, count(*) AS group_count FROM recon GROUP BY classification"))
def g37_classes(v: View) -> DataFrame:
    return reports.reconciliation_classes(reports.reconciliation_groups(v.edges, v.entities)).drop("rank")


@query("g38_reconciliation_sources", o.graph(o.RECONCILIATION + " SELECT s AS source_name, sum(count)::BIGINT AS count, count(*) AS group_count FROM (SELECT *, unnest(string_split(concat_ws(',', nullif(source_names, ''), nullif(database_sources, '')), ',')) AS s FROM recon) GROUP BY s ORDER BY count DESC, source_name LIMIT 10"))
def g38(v: View) -> DataFrame:
    return reports.reconciliation_source_hotspots(reports.reconciliation_groups(v.edges, v.entities)).drop("classifications")


@query("g40_coverage_warnings", o.graph(o.COVERAGE))
def g40(v: View) -> DataFrame:
    return reports.coverage_warnings(v.edges)


@query("g41_relationship_groups", o.graph(o.NEIGHBOR_GROUPS))
def g41(v: View) -> DataFrame:
    found = traverse.neighbors(v.edges, o.ROOT_ID, "both", 1, limit=1000)
    return reports.relationship_groups(found, v.entities).select("direction", "edge_type", "neighbor_source", "neighbor_type", "count", _count("min_depth"))


@query("g42_evidence_groups", o.graph("SELECT source_name, target_source, edge_type, to_type, parser, confidence, count(*) AS count, count(*) FILTER (resolved) AS resolved_count FROM targeted GROUP BY ALL"))
def g42(v: View) -> DataFrame:
    return reports.evidence_groups(v.edges, v.entities, examples=0).drop("examples")


@query("d03_stored_graph", o.graph("SELECT source_name, edge_type, count(*) AS count, count(*) FILTER (resolved) AS resolved_count, count(*) FILTER (NOT resolved) AS unresolved_count FROM resolved GROUP BY ALL"))
def d03(v: View) -> DataFrame:
    folder = f"{shared_dir(v.spark)}/graph/{uuid.uuid4().hex}"
    Graph("tpch", v.sources, v.entities, v.edges).write(folder)
    return store.edge_type_counts(Graph.read(v.spark, folder, "tpch").edges, by_source=True)


def _sizes(parts: dict[str, DataFrame]) -> DataFrame:
    """part, rows of each part of a report."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("e18_overview", o.graph("SELECT 'scope' AS part, 1::BIGINT AS rows UNION ALL SELECT 'entity_types', count(DISTINCT entity_type) FROM all_entities UNION ALL SELECT 'edge_types', count(DISTINCT edge_type) FROM resolved UNION ALL SELECT 'activity', (SELECT least(50, count(*)) FROM nation) UNION ALL SELECT 'cross_source', (SELECT count(*) FROM (SELECT DISTINCT source_name, target_source, edge_type FROM targeted WHERE resolved AND source_name <> target_source))"))
def e18(v: View) -> DataFrame:
    return _sizes(store.overview(v.sources, v.entities, v.edges, "tpch"))


@query("e24_source_overview", o.graph("""SELECT 'summary' AS part, 1::BIGINT AS rows UNION ALL SELECT 'entity_types', count(DISTINCT entity_type) FROM all_entities WHERE source_name = 'NATION_7' UNION ALL SELECT 'edge_types', count(DISTINCT edge_type) FROM resolved WHERE source_name = 'NATION_7'
UNION ALL SELECT 'owned', least(50, count(*)) FROM all_entities WHERE source_name = 'NATION_7' AND entity_type IN ('api_route', 'project', 'service', 'sql_table') UNION ALL SELECT 'uses', (SELECT count(*) FROM (SELECT DISTINCT edge_type, to_type, to_name, target_source FROM targeted WHERE source_name = 'NATION_7'))
UNION ALL SELECT 'outgoing', (SELECT count(*) FROM (SELECT DISTINCT target_source, edge_type FROM targeted WHERE resolved AND source_name <> target_source AND source_name = 'NATION_7')) UNION ALL SELECT 'incoming', (SELECT count(*) FROM (SELECT DISTINCT source_name, edge_type FROM targeted WHERE resolved AND source_name <> target_source AND target_source = 'NATION_7'))"""))
def e24(v: View) -> DataFrame:
    return _sizes(store.source_overview(v.sources, v.entities, v.edges, "NATION_7"))


@query("c03_edges_of_facts", o.graph("SELECT edge_type, to_entity_id IS NOT NULL AS bound, count(*) AS edges, min(from_entity_id) AS first_from FROM edges GROUP BY ALL"))
def c03(v: View) -> DataFrame:
    ref = lambda kind, name, source, ident: F.struct(F.col(kind).alias("entity_type"), F.col(name).alias("name"), source.alias("source_name"), F.lit(None).cast("string").alias("file_path"), ident.alias("entity_id"))
    none = F.lit(None).cast("string")
    origin = F.when(F.col("edge_type").isin("DEPENDS_ON_PROJECT", "CALLS_HTTP"), F.col("source_name"))
    rows = v.raw_edges.withColumns({"from_ref": ref("from_type", "from_name", origin, F.when(origin.isNull(), F.col("from_entity_id"))), "to_ref": ref("to_type", "to_name", none, F.col("to_entity_id")), "seq": F.lit(1), "resolved": F.lit(None).cast("boolean")})
    return assemble.edges_from_facts(rows).groupBy("edge_type", F.col("to_entity_id").isNotNull().alias("bound")).agg(F.count(F.lit(1)).alias("edges"), F.min("from_entity_id").alias("first_from"))


@query("g39_entities_of_items", o.graph("SELECT entity_type, source_name, count(*) AS entities FROM all_entities WHERE source_name = 'NATION_3' OR (entity_type = 'sql_table' AND entity_id IN (SELECT to_entity_id FROM resolved WHERE edge_type = 'READS_SQL_OBJECT' AND resolved)) GROUP BY ALL"))
def g39(v: View) -> DataFrame:
    whole = v.entities.select("entity_id", "entity_type", "name", "source_name", "properties")
    item = lambda c, key: whole.select(F.col("entity_id").alias(key), F.struct("*").alias(c))
    used = v.edges.where("edge_type = 'READS_SQL_OBJECT' and resolved").select("from_entity_id", "to_entity_id")
    items = used.join(item("from_entity", "from_entity_id"), "from_entity_id", "left").join(item("target", "to_entity_id"), "to_entity_id", "left").select("from_entity", "target")
    return reports.entities_of_items(whole.where("source_name = 'NATION_3'"), items).groupBy("entity_type", "source_name").agg(F.count(F.lit(1)).alias("entities"))

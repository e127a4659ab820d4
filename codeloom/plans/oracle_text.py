"""SQL texts of the oracles: the graph view, and a direct formulation of resolution and reports."""

from __future__ import annotations

import hashlib

from codeloom.plans.graph_view import duckdb_ctes

ROOT_ID = hashlib.sha256(b"entity|NATION_15|service|Supplier#000000000|").hexdigest()[:24]
ROOT = f"'{ROOT_ID}'"

_RESOLUTION = """
external AS (
  SELECT DISTINCT substr(sha256('entity|external-resources|' || to_type || '|' || to_name || '|'), 1, 24) AS entity_id, to_type AS entity_type, to_name AS name,
         'external-resources' AS source_name, NULL::VARCHAR AS file_path, lower(to_name) AS alias, NULL::VARCHAR AS schema_name, NULL::VARCHAR AS full_name, NULL::VARCHAR AS schema_state
  FROM edges WHERE to_entity_id IS NULL AND to_type IN ('message_contract', 'message_queue', 'message_topic', 'storage_location', 'cache_key', 'cache_store')
), all_entities AS (
  SELECT entity_id, entity_type, name, source_name, file_path, alias, schema_name, full_name, schema_state FROM entities UNION ALL SELECT * FROM external
), keys AS (
  SELECT DISTINCT entity_id, entity_type, name, source_name, lower(trim(trim(k), '[]`"''')) AS key
  FROM (SELECT *, unnest([name, alias, full_name, schema_name || '.' || name]) AS k FROM all_entities WHERE coalesce(schema_state, '') <> 'historical') WHERE k IS NOT NULL
), lookup AS (
  SELECT entity_type AS grp, * FROM keys UNION ALL SELECT '*', * FROM keys
  UNION ALL SELECT 'sql_object', * FROM keys WHERE entity_type IN ('sql_table', 'sql_view', 'sql_function', 'sql_trigger', 'stored_procedure')
), refs AS (
  SELECT edge_id, source_name, to_type, lower(trim(trim(to_name), '[]`"''')) AS key,
         unnest(CASE WHEN to_type = 'service' THEN ['service', 'project', 'repository', '*'] ELSE [to_type, '*'] END) AS grp,
         unnest(CASE WHEN to_type = 'service' THEN [0, 1, 2, 3] ELSE [0, 1] END) AS tier
  FROM edges WHERE to_entity_id IS NULL AND to_type <> 'message_topic'
), per_key AS MATERIALIZED (
  SELECT grp, key, count(*) AS n, min(entity_id) AS one, arg_min(entity_type, entity_id) AS one_type FROM lookup GROUP BY grp, key
), per_source AS MATERIALIZED (
  SELECT grp, key, source_name, count(*) AS same, min(entity_id) AS own, arg_min(entity_type, entity_id) AS own_type FROM lookup GROUP BY grp, key, source_name
), reached AS (
  SELECT edge_id, r.grp, r.source_name, tier, n, coalesce(same, 0) AS same, one, own, one_type, own_type
  FROM refs r JOIN per_key t ON r.grp = t.grp AND r.key = t.key LEFT JOIN per_source o ON r.grp = o.grp AND r.key = o.key AND r.source_name = o.source_name
), best AS (SELECT * FROM reached QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY tier) = 1
), chosen AS (
  SELECT edge_id, grp, n, CASE WHEN same = 1 THEN own WHEN same = 0 AND n = 1 THEN one END AS id, CASE WHEN same = 1 THEN own_type WHEN same = 0 AND n = 1 THEN one_type END AS kind FROM best
), resolved AS (
  SELECT e.edge_id, from_entity_id, from_name, from_type, edge_type, to_name, coalesce(c.kind, e.to_type) AS to_type,
         CASE WHEN e.to_entity_id IS NOT NULL THEN e.to_entity_id WHEN e.to_type = 'message_topic' THEN x.entity_id ELSE c.id END AS to_entity_id,
         CASE WHEN e.to_entity_id IS NOT NULL THEN e.to_entity_id IN (SELECT entity_id FROM all_entities) WHEN e.to_type = 'message_topic' THEN true ELSE c.id IS NOT NULL END AS resolved,
         CASE WHEN c.n IS NOT NULL AND c.id IS NULL THEN 'ambiguous' END AS status, CASE WHEN c.n IS NOT NULL AND c.id IS NULL THEN c.n ELSE 0 END AS candidates, c.grp AS grp,
         source_name, e.file_path, line_number, confidence, parser, target_boundary, dependency_scope, interaction_kind, protocol, raw_target
  FROM edges e LEFT JOIN chosen c USING (edge_id) LEFT JOIN (SELECT entity_id, entity_type, name FROM external) x ON e.to_entity_id IS NULL AND e.to_type = x.entity_type AND e.to_name = x.name
), targeted AS (
  SELECT r.*, CASE WHEN resolved THEN a.source_name END AS target_source FROM resolved r LEFT JOIN (SELECT entity_id, source_name FROM all_entities) a ON r.to_entity_id = a.entity_id
)
"""


def graph(select: str, renamed: bool = False) -> str:
    """A query over entities, edges, external, all_entities, lookup, resolved and targeted; it may begin with further CTEs and a comma."""
    text = f"WITH {duckdb_ctes()}, {_RESOLUTION}"
    if renamed:
        text += ", renamed AS (SELECT * REPLACE (CASE edge_type WHEN 'DEPENDS_ON_PROJECT' THEN 'DEPENDS_ON_PACKAGE' WHEN 'CONFIGURES_SERVICE' THEN 'IMPORTS' ELSE edge_type END AS edge_type) FROM resolved)"
        select = select.replace("FROM resolved", "FROM renamed")
    return text + select


CANDIDATES = """
SELECT to_type, key, place, entity_id, entity_type, source_name FROM (
  SELECT r.to_type, r.key, l.entity_id, l.entity_type, l.source_name,
         row_number() OVER (PARTITION BY r.to_type, r.key ORDER BY CASE l.entity_type WHEN 'sql_table' THEN 1 WHEN 'sql_view' THEN 2 WHEN 'sql_function' THEN 3 WHEN 'sql_trigger' THEN 4 WHEN 'stored_procedure' THEN 5 ELSE 0 END, l.entity_id) AS place
  FROM (SELECT DISTINCT to_type, lower(to_name) AS key, grp FROM resolved WHERE status = 'ambiguous') r JOIN lookup l ON l.grp = r.grp AND l.key = r.key)
WHERE place <= 25
"""

SUMMARY = """
SELECT 'sources' AS metric, '' AS key, count(*) AS count FROM nation UNION ALL SELECT 'entities', '', count(*) FROM all_entities UNION ALL SELECT 'edges', '', count(*) FROM resolved
UNION ALL SELECT 'resolved_edges', '', count(*) FROM resolved WHERE resolved UNION ALL SELECT 'unresolved_edges', '', count(*) FROM resolved WHERE NOT resolved
UNION ALL SELECT 'entity_type', entity_type, count(*) FROM all_entities GROUP BY entity_type UNION ALL SELECT 'edge_type', edge_type, count(*) FROM resolved GROUP BY edge_type
"""


def trails(direction: str) -> str:
    near, far = ("from_entity_id", "to_entity_id") if direction == "out" else ("to_entity_id", "from_entity_id")
    return f"""
, steps AS (SELECT edge_id, edge_type, {near} AS near, {far} AS far FROM resolved WHERE resolved AND edge_type IN ('CALLS_SERVICE', 'CONFIGURES_SERVICE', 'DEPENDS_ON_PROJECT', 'CONSUMES_MESSAGE')),
one AS (SELECT near AS root, 1 AS depth, edge_type, far, edge_id AS path FROM steps WHERE near IN (SELECT entity_id FROM entities WHERE entity_type = 'service')),
two AS (SELECT root, 2 AS depth, s.edge_type, s.far, path || '|' || s.edge_id AS path FROM one JOIN steps s ON one.far = s.near WHERE s.edge_id <> path)
SELECT root, depth, edge_type, count(*) AS trails, count(DISTINCT far) AS nodes, min(path) AS first_path FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY root, depth, edge_type"""


NEIGHBORS = f"""
SELECT direction, 1::BIGINT AS depth, edge_id, edge_type, neighbor_id FROM (
  SELECT 0 AS r, 'out' AS direction, edge_id, edge_type, to_entity_id AS neighbor_id, to_name AS n FROM resolved WHERE resolved AND from_entity_id = {ROOT}
  UNION ALL SELECT 1, 'in', edge_id, edge_type, from_entity_id, from_name FROM resolved WHERE resolved AND to_entity_id = {ROOT})
ORDER BY r, edge_type, n, edge_id LIMIT 200
"""

NEIGHBOR_GROUPS = f"""
, near AS (
  SELECT 0 AS r, 'out' AS direction, edge_id, edge_type, to_entity_id AS id, to_name AS n FROM resolved WHERE resolved AND from_entity_id = {ROOT}
  UNION ALL SELECT 1, 'in', edge_id, edge_type, from_entity_id, from_name FROM resolved WHERE resolved AND to_entity_id = {ROOT}
  ORDER BY 1, 4, 6, 3 LIMIT 1000)
SELECT direction, edge_type, source_name AS neighbor_source, entity_type AS neighbor_type, count(*) AS count, 1::BIGINT AS min_depth FROM near LEFT JOIN all_entities ON id = entity_id GROUP BY ALL
"""

_IMPACT = "('CALLS_HTTP', 'CALLS_SERVICE', 'CALLS_SQL', 'CONFIGURES_SERVICE', 'CONSUMES_MESSAGE', 'DEPENDS_ON_PROJECT', 'READS_SQL_OBJECT', 'ROUTES_TO_SERVICE', 'WRITES_SQL_OBJECT')"
_BLAST = f"""
, hops AS MATERIALIZED (SELECT from_entity_id AS f, to_entity_id AS t FROM resolved WHERE to_entity_id IS NOT NULL AND edge_type IN {_IMPACT}),
l1 AS (SELECT DISTINCT f AS id FROM hops WHERE t = {ROOT} AND f <> {ROOT}),
l2 AS (SELECT DISTINCT f AS id FROM hops WHERE t IN (SELECT id FROM l1) AND f <> {ROOT} AND f NOT IN (SELECT id FROM l1)),
blast AS (SELECT id, 1::BIGINT AS depth FROM l1 UNION ALL SELECT id, 2 FROM l2)
"""
BLAST = _BLAST + "SELECT id AS next_id, depth FROM blast"
BLAST_SOURCES = _BLAST + "SELECT source_name AS source, count(*) AS count, min(depth) AS min_depth FROM blast JOIN all_entities ON id = entity_id GROUP BY source_name"

BLAST_PATHS = _BLAST + f"SELECT id AS next_id, depth, depth + 1 AS nodes, id AS first, {ROOT} AS last, true AS whole, false AS truncated FROM blast"
NEIGHBOR_EVIDENCE = f"""
SELECT direction, n.edge_type, coalesce(x.source_name, e.source_name) AS source_name, x.entity_type AS neighbor_type, count(*) AS count, 1::BIGINT AS min_depth, min(n.edge_id) AS first_edge, least(count(*), 5) AS examples
FROM ({NEIGHBORS}) n JOIN resolved e ON e.edge_id = n.edge_id JOIN all_entities x ON x.entity_id = n.neighbor_id GROUP BY ALL
"""

INTERACTIONS = """
, inter AS (
  SELECT source_name AS from_source, target_source, to_type, to_name, edge_type, target_boundary, dependency_scope, interaction_kind, count(*) AS count,
         count(*) FILTER (resolved) AS resolved_count, count(*) FILTER (NOT resolved) AS unresolved_count, string_agg(DISTINCT parser, ',' ORDER BY parser) AS parsers,
         coalesce(string_agg(DISTINCT protocol, ',' ORDER BY protocol), '') AS protocols, array_to_string(list(edge_id ORDER BY edge_id)[1:3], ',') AS examples
  FROM targeted WHERE edge_type IN ('CALLS_HTTP', 'CALLS_SERVICE', 'CALLS_SQL', 'CONFIGURES_SERVICE', 'CONSUMES_MESSAGE', 'READS_SQL_OBJECT', 'ROUTES_TO_SERVICE', 'WRITES_SQL_OBJECT')
  GROUP BY source_name, target_source, to_type, to_name, edge_type, target_boundary, dependency_scope, interaction_kind)
"""

UNRESOLVED = """
, classed AS (
  SELECT *, CASE WHEN status = 'ambiguous' THEN 'ambiguous_target' WHEN edge_type = 'CALLS_HTTP' THEN 'likely_parser_gap' ELSE 'likely_missing_source' END AS classification
  FROM resolved WHERE NOT resolved
), unres AS (
  SELECT edge_type, to_type, to_name, classification, count(*) AS count, string_agg(DISTINCT source_name, ',' ORDER BY source_name) AS source_names,
         string_agg(DISTINCT parser, ',' ORDER BY parser) AS parsers, array_to_string(list(edge_id ORDER BY edge_id)[1:3], ',') AS examples
  FROM classed GROUP BY edge_type, to_type, to_name, classification)
"""

RECONCILIATION = """
, ent AS (SELECT entity_id, entity_type, source_name, schema_state, coalesce(full_name, name) AS sql_name, lower(coalesce(full_name, name)) AS key FROM all_entities WHERE entity_type = 'sql_table'),
cur AS (SELECT * FROM ent WHERE schema_state = 'current_database'), old AS (SELECT * FROM ent WHERE schema_state = 'historical'),
src AS (SELECT * FROM ent WHERE coalesce(schema_state, '') NOT IN ('current_database', 'historical')),
ref AS (SELECT r.*, coalesce(ent.key, lower(raw_target)) AS key FROM resolved r LEFT JOIN ent ON to_entity_id = entity_id WHERE edge_type IN ('CALLS_SQL', 'READS_SQL_OBJECT', 'WRITES_SQL_OBJECT')),
evidence AS (
  SELECT 'code_only_reference' AS classification, to_type AS target_type, to_name AS target_name, source_name, NULL AS database_source, edge_type AS evidence_type, edge_id AS id
  FROM ref WHERE parser <> 'sqlserver_metadata' AND key NOT IN (SELECT key FROM cur) AND (SELECT count(*) FROM cur) > 0
  UNION ALL SELECT 'unresolved_database_reference', to_type, to_name, NULL, source_name, edge_type, edge_id FROM ref WHERE parser = 'sqlserver_metadata' AND NOT resolved
  UNION ALL SELECT 'migration_only_object', entity_type, sql_name, source_name, NULL, 'historical_schema', entity_id FROM old WHERE key NOT IN (SELECT key FROM cur)
  UNION ALL SELECT 'database_only_object', entity_type, sql_name, NULL, source_name, 'current_database', entity_id FROM cur
  WHERE key NOT IN (SELECT key FROM ref WHERE parser <> 'sqlserver_metadata') AND key NOT IN (SELECT key FROM src)
), recon AS (
  SELECT classification, target_type, target_name, count(*) AS count, coalesce(string_agg(DISTINCT source_name, ',' ORDER BY source_name), '') AS source_names,
         coalesce(string_agg(DISTINCT database_source, ',' ORDER BY database_source), '') AS database_sources, string_agg(DISTINCT evidence_type, ',' ORDER BY evidence_type) AS evidence_types, min(id) AS example
  FROM evidence GROUP BY classification, target_type, target_name)
"""


def reached(depth: int) -> str:
    """CTE items: what the root reaches in both directions, without a limit, each node by its first discovery; rank is what that is ordered by."""
    order = ", ".join(f"coalesce(h.{c}, '')" for c in ("edge_type", "source_name", "to_name", "edge_id"))
    keys = f"[{order}]"
    text = ""
    for d, near, far in (("out", "from_entity_id", "coalesce(to_entity_id, 'unresolved:' || edge_id)"), ("in", "to_entity_id", "from_entity_id")):
        text += f", h_{d} AS MATERIALIZED (SELECT {near} AS near, {far} AS next_id, edge_id, edge_type, source_name, to_name, to_type FROM resolved WHERE {near} IS NOT NULL)"
        text += f", {d}_0 AS (SELECT {ROOT} AS next_id, []::VARCHAR[] AS rank)"
        for level in range(1, depth + 1):
            seen = " UNION ALL ".join(f"SELECT next_id FROM {d}_{i}" for i in range(level))
            text += f""", {d}_{level} AS MATERIALIZED (SELECT h.next_id, list_concat(f.rank, {keys}) AS rank, '{d}' AS direction, {level} AS depth, h.edge_id, h.edge_type, h.source_name, h.to_name, h.to_type
  FROM {d}_{level - 1} f JOIN h_{d} h ON f.next_id = h.near AND f.next_id IN (SELECT entity_id FROM all_entities) WHERE h.next_id IS NOT NULL AND h.next_id NOT IN ({seen})
  QUALIFY row_number() OVER (PARTITION BY h.next_id ORDER BY f.rank, {order}) = 1)"""
    every = " UNION ALL BY NAME ".join(f"SELECT * FROM {d}_{i}" for d in ("out", "in") for i in range(1, depth + 1))
    return text + f""", items AS MATERIALIZED (SELECT i.*, coalesce(a.entity_type, i.to_type) AS neighbor_type, coalesce(a.name, i.to_name) AS neighbor_name, a.source_name AS neighbor_source
  FROM ({every}) i LEFT JOIN (SELECT entity_id, entity_type, name, source_name FROM all_entities) a ON i.next_id = a.entity_id)"""


PATH_GROUPS = reached(2) + """, numbered AS (
  SELECT *, coalesce(neighbor_source, source_name, 'unknown') AS source, row_number() OVER (PARTITION BY coalesce(neighbor_source, source_name, 'unknown'), edge_type ORDER BY depth, direction, rank) AS place FROM items)
SELECT source, edge_type, count(*) AS count, min(depth)::INTEGER AS min_depth, edge_type AS edge_types, string_agg(DISTINCT coalesce(neighbor_type, 'unknown'), ',' ORDER BY coalesce(neighbor_type, 'unknown')) AS entity_types,
  string_agg(neighbor_name, ',' ORDER BY place) FILTER (place <= 5) AS examples FROM numbered GROUP BY source, edge_type"""

RADIUS_SUMMARY = reached(3) + """
SELECT 'items' AS metric, '' AS key, count(*) AS count FROM items UNION ALL SELECT 'max_depth', '', coalesce(max(depth), 0) FROM items
UNION ALL SELECT 'edge_type', coalesce(edge_type, 'unknown'), count(*) FROM items GROUP BY ALL UNION ALL SELECT 'direction', direction, count(*) FROM items GROUP BY ALL
UNION ALL SELECT 'entity_type', coalesce(neighbor_type, 'unknown'), count(*) FROM items GROUP BY ALL"""

_WARNINGS = "('CALLS_SQL', 'unresolved_sql_calls', 'warning'), ('READS_SQL_OBJECT', 'unresolved_sql_reads', 'warning'), ('WRITES_SQL_OBJECT', 'unresolved_sql_writes', 'warning'), ('REFERENCES_SQL_OBJECT', 'unresolved_sql_schema_references', 'warning'), ('CALLS_SERVICE', 'unresolved_service_calls', 'warning'), ('CALLS_HTTP', 'unresolved_http_calls', 'warning'), ('IMPORTS', 'unresolved_imports', 'info')"
COVERAGE = UNRESOLVED + f"""
, top AS (SELECT * FROM unres ORDER BY count DESC, classification, edge_type, to_name, to_type LIMIT 25)
SELECT * FROM (
  SELECT code, severity, sum(count)::BIGINT AS count FROM top JOIN (VALUES {_WARNINGS}) AS w(edge_type, code, severity) USING (edge_type) GROUP BY code, severity
  UNION ALL SELECT code, severity, sum(count)::BIGINT FROM unres JOIN (VALUES ('likely_parser_gap', 'parser_gap', 'warning'), ('ambiguous_target', 'ambiguous_targets', 'warning'), ('likely_missing_source', 'missing_source', 'warning')) AS w(classification, code, severity) USING (classification) GROUP BY code, severity)
ORDER BY CASE severity WHEN 'warning' THEN 0 ELSE 1 END, count DESC, code LIMIT 8"""

PAYLOADS = "SELECT '{\"entity_id\":' || to_json(entity_id) || ',\"entity_type\":' || to_json(entity_type) || ',\"name\":' || to_json(name) || ',\"source_name\":' || to_json(source_name) || CASE WHEN file_path IS NULL THEN '' ELSE ',\"file_path\":' || to_json(file_path) END || '}' AS payload FROM all_entities"

"""Closed vocabularies of the graph: fixed values that predicates, validators and CASE ladders share."""

from __future__ import annotations

# Edge types.
EDGE_TYPES = [
    "CALLS_HTTP", "CALLS_SERVICE", "CALLS_SQL", "CALLS_SYMBOL", "CONFIGURES_SERVICE", "CONSUMES_MESSAGE", "CONTAINS_FILE",
    "CONTAINS_PROJECT", "DECLARES_BUILD_CONFIG", "DECLARES_CONFIG", "DECLARES_CONFIG_FILE", "DECLARES_DEPLOYMENT", "DECLARES_INGRESS",
    "DECLARES_JOB", "DECLARES_PACKAGE", "DECLARES_ROUTE", "DECLARES_SERVICE", "DECLARES_SOLUTION", "DECLARES_SYMBOL", "DECLARES_WORKSPACE",
    "DEFINES", "DEPENDS_ON_PACKAGE", "DEPENDS_ON_PROJECT", "EXPOSES_ROUTE", "HANDLES_ROUTE", "IMPORTS", "PUBLISHES_MESSAGE",
    "READS_CACHE_KEY", "READS_SQL_OBJECT", "READS_STORAGE_OBJECT", "REFERENCES_SQL_OBJECT", "ROUTES_TO_SERVICE", "RUNS_CONTAINER",
    "RUNS_JOB", "SCHEDULES_JOB", "SELECTS_DEPLOYMENT", "TRIGGERS_ON_SQL_OBJECT", "WRITES_SQL_OBJECT", "WRITES_STORAGE_OBJECT",
    "WRITES_CACHE_KEY",
]
SQL_EDGE_TYPES = ["CALLS_SQL", "READS_SQL_OBJECT", "REFERENCES_SQL_OBJECT", "TRIGGERS_ON_SQL_OBJECT", "WRITES_SQL_OBJECT"]
INTERACTION_EDGE_TYPES = [
    "CALLS_HTTP", "CALLS_SERVICE", "CALLS_SQL", "CONFIGURES_SERVICE", "CONSUMES_MESSAGE", "PUBLISHES_MESSAGE", "READS_CACHE_KEY",
    "READS_SQL_OBJECT", "READS_STORAGE_OBJECT", "REFERENCES_SQL_OBJECT", "ROUTES_TO_SERVICE", "TRIGGERS_ON_SQL_OBJECT", "WRITES_SQL_OBJECT",
    "WRITES_STORAGE_OBJECT", "WRITES_CACHE_KEY",
]

# Entity types.
ENTITY_TYPES = [
    "api_route", "build_config", "cache_key", "cache_store", "class", "config_file", "config_value", "container", "deployment", "file",
    "function", "ingress", "interface", "message_contract", "message_queue", "message_topic", "module", "package", "project", "repository",
    "service", "solution", "storage_location", "scheduled_job", "sql_function", "sql_table", "sql_trigger", "sql_view", "stored_procedure",
    "workspace",
]
EDGE_TARGET_TYPES = [*ENTITY_TYPES, "sql_object"]
#: In the order in which candidates of a sql_object reference are listed.
SQL_ENTITY_TYPES = ["sql_table", "sql_view", "sql_function", "sql_trigger", "stored_procedure"]
MESSAGE_ENTITY_TYPES = ["message_contract", "message_queue", "message_topic"]
STORAGE_ENTITY_TYPES = ["storage_location"]
CACHE_ENTITY_TYPES = ["cache_key", "cache_store"]
EXTERNAL_ENTITY_TYPES = [*MESSAGE_ENTITY_TYPES, *STORAGE_ENTITY_TYPES, *CACHE_ENTITY_TYPES]
EXTERNAL_SOURCE = "external-resources"
SURFACE_ENTITY_TYPES = [
    "api_route", "deployment", "ingress", "package", "project", "service", "sql_function", "sql_table", "sql_view", "stored_procedure",
]

# Traversal profiles.
IMPACT_EDGE_TYPES = [
    "CALLS_HTTP", "CALLS_SERVICE", "CALLS_SQL", "CALLS_SYMBOL", "CONFIGURES_SERVICE", "CONSUMES_MESSAGE", "DEPENDS_ON_PACKAGE",
    "DEPENDS_ON_PROJECT", "HANDLES_ROUTE", "IMPORTS", "PUBLISHES_MESSAGE", "READS_CACHE_KEY", "READS_SQL_OBJECT", "READS_STORAGE_OBJECT",
    "REFERENCES_SQL_OBJECT", "ROUTES_TO_SERVICE", "SELECTS_DEPLOYMENT", "TRIGGERS_ON_SQL_OBJECT", "WRITES_SQL_OBJECT",
    "WRITES_STORAGE_OBJECT", "WRITES_CACHE_KEY", "RUNS_JOB", "SCHEDULES_JOB",
]
STRUCTURAL_EDGE_TYPES = [
    "CONTAINS_FILE", "CONTAINS_PROJECT", "DECLARES_BUILD_CONFIG", "DECLARES_CONFIG", "DECLARES_CONFIG_FILE", "DECLARES_DEPLOYMENT",
    "DECLARES_INGRESS", "DECLARES_JOB", "DECLARES_PACKAGE", "DECLARES_ROUTE", "DECLARES_SERVICE", "DECLARES_SOLUTION", "DECLARES_SYMBOL",
    "DECLARES_WORKSPACE", "DEFINES", "EXPOSES_ROUTE", "RUNS_CONTAINER",
]
IMPACT_PROFILES = {"impact": IMPACT_EDGE_TYPES, "structural": STRUCTURAL_EDGE_TYPES, "all": None}

# Evidence of interactions.
INTERACTION_EVIDENCE_KEYS = ["target_boundary", "dependency_scope", "interaction_kind"]
INTERACTION_TARGET_BOUNDARIES = ["application", "cache", "database", "messaging", "storage"]
INTERACTION_DEPENDENCY_SCOPES = ["configuration", "deployment", "runtime", "schema"]
INTERACTION_KINDS = [
    "http_call", "ingress_route", "cache_read", "cache_write", "message_consume", "message_publish", "service_call",
    "service_configuration", "sql_reference", "sql_schema_reference", "sql_trigger", "storage_read", "storage_write",
]

# Classification of unresolved references.
MISSING_SOURCE_EDGE_TYPES = [
    "CALLS_SERVICE", "CALLS_SQL", "CONFIGURES_SERVICE", "DEPENDS_ON_PACKAGE", "DEPENDS_ON_PROJECT", "READS_SQL_OBJECT",
    "REFERENCES_SQL_OBJECT", "ROUTES_TO_SERVICE", "TRIGGERS_ON_SQL_OBJECT", "WRITES_SQL_OBJECT",
]
PARSER_GAP_EDGE_TYPES = ["CALLS_HTTP", "CALLS_SYMBOL", "DECLARES_SYMBOL", "IMPORTS"]
LOCAL_EDGE_PREFIXES = ["CONTAINS_", "DECLARES_", "EXPOSES_", "RUNS_", "SELECTS_"]
MISSING_SOURCE_TARGET_TYPES = [
    "package", "project", "repository", "service", "message_contract", "message_queue", "message_topic", "cache_key", "cache_store",
    "sql_function", "sql_object", "sql_table", "sql_trigger", "sql_view", "stored_procedure", "storage_location",
]
PARSER_GAP_TARGET_TYPES = ["api_route", "class", "function", "interface", "module"]
UNRESOLVED_RANKS = {"likely_missing_source": 0, "likely_parser_gap": 1, "ambiguous_target": 2, "needs_review": 3}
RECONCILIATION_RANKS = {
    "code_only_reference": 0, "unresolved_database_reference": 1, "schema_drift": 2, "migration_only_object": 3, "database_only_object": 4,
}

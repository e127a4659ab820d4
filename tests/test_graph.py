"""Hand-built graphs for assembly, resolution, store, traversal and reports."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import exprs
from codeloom.operators import assemble, incremental, reports, resolve, store, traverse

ENTITY = "entity_type string, name string, source_name string, file_path string, line_number int, aliases array<string>, properties map<string,string>"
EDGE = (
    "edge_id string, from_entity_id string, from_name string, from_type string, to_name string, to_type string, to_entity_id string, edge_type string, resolved boolean, "
    "source_name string, file_path string, line_number int, identity_key string, confidence string, parser string, properties map<string,string>"
)


def entities_of(spark, *rows):
    full = [(t, n, s, None, None, list(a), dict(p)) for t, n, s, a, p in rows]
    return spark.createDataFrame(full, ENTITY).withColumn("entity_id", exprs.entity_id()).select("entity_id", *[c.split()[0] for c in ENTITY.split(", ")])


def edge(i, start, name, kind, edge_type="CALLS_SQL", source="a", target=None, parser="sql", props=None):
    return (f"e{i}", start, "x", "function", name, kind, target, edge_type, target is not None, source, None, i, None, "high", parser, props or {})


def resolved(spark, entities, *edges):
    entities, out = resolve.resolve(entities, spark.createDataFrame(list(edges), EDGE))
    return entities, out, {r["edge_id"]: r for r in out.collect()}


def test_same_source_preference_and_ambiguity(spark):
    e = entities_of(spark, ("stored_procedure", "Load", "a", [], {}), ("stored_procedure", "Load", "b", [], {}), ("stored_procedure", "Load", "c", [], {}))
    ids = {r["source_name"]: r["entity_id"] for r in e.collect()}
    full, edges, got = resolved(spark, e, edge(1, "s", "[load]", "stored_procedure", source="b"), edge(2, "s", "LOAD", "sql_object", source="z"))
    assert got["e1"]["to_entity_id"] == ids["b"] and got["e1"]["resolved"]
    assert not got["e2"]["resolved"] and got["e2"]["resolution_status"] == "ambiguous" and got["e2"]["candidate_count"] == 3
    assert resolve.candidates(full, edges).count() == 3


def test_tiers_fallback_and_historical(spark):
    e = entities_of(
        spark, ("project", "orders", "a", [], {}), ("repository", "orders", "b", [], {}), ("sql_table", "T", "a", [], {"schema": "dbo", "full_name": "dbo.T"}),
        ("sql_table", "Old", "a", [], {"schema_state": "historical"}), ("package", "p", "c", ["alias"], {}),
    )
    _, _, got = resolved(
        spark, e, edge(1, "s", "Orders", "service", "CALLS_SERVICE", "z"), edge(2, "s", "DBO.T", "sql_object", source="z"), edge(3, "s", "old", "sql_table", source="z"),
        edge(4, "s", "alias", "module", source="z"), edge(5, "s", "none", None, source="z"),
    )
    assert (got["e1"]["to_type"], got["e2"]["to_type"], got["e4"]["to_type"]) == ("project", "sql_table", "package")
    assert not got["e3"]["resolved"] and got["e3"]["resolution_status"] is None and not got["e5"]["resolved"]


def test_external_resources_are_shared(spark):
    e = entities_of(spark, ("service", "s", "a", [], {}))
    full, _, got = resolved(
        spark, e, edge(1, "s", "orders", "message_topic", "PUBLISHES_MESSAGE", "a"), edge(2, "s", "orders", "message_topic", "CONSUMES_MESSAGE", "b"), edge(3, "s", "k", "cache_key", "READS_CACHE_KEY"),
    )
    assert got["e1"]["to_entity_id"] == got["e2"]["to_entity_id"] and all(r["resolved"] for r in got.values())
    assert full.where("source_name = 'external-resources'").count() == 2


def test_upserts(spark):
    rows = [("service", "s", "a", None, 1, ["x"], {"p": "1", "q": "2"}, 1), ("service", "s", "a", None, 9, ["y", "x"], {"p": "3", "q": None}, 2)]
    got = assemble.upsert_entities(spark.createDataFrame(rows, ENTITY + ", seq long")).collect()
    assert len(got) == 1 and got[0]["line_number"] == 1 and got[0]["aliases"] == ["x", "y"] and got[0]["properties"] == {"p": "3", "q": "2"}
    edges = spark.createDataFrame([(*edge(1, "s", "t", "x")[1:], 1), (*edge(1, "s", "t", "y")[1:], 2)], EDGE.replace("edge_id string, ", "") + ", seq long")
    got = assemble.upsert_edges(edges).collect()
    assert len(got) == 1 and got[0]["to_type"] == "y"


def test_blast_radius_and_profiles(spark):
    e = entities_of(spark, ("api_route", "r", "api", [], {}), ("function", "f", "api", [], {}), ("sql_table", "t", "db", [], {}), ("repository", "api", "api", [], {}), ("file", "x", "api", [], {}))
    ids = {r["name"]: r["entity_id"] for r in e.collect()}
    edges = spark.createDataFrame([
        edge(1, ids["r"], "f", "function", "HANDLES_ROUTE", "api", ids["f"]), edge(2, ids["f"], "t", "sql_table", "READS_SQL_OBJECT", "api", ids["t"]),
        edge(3, ids["api"], "x", "file", "CONTAINS_FILE", "api", ids["x"]),
    ], EDGE)
    report = traverse.radius_report(edges, e, ids["t"], "in", 2)
    items = report["items"].collect()
    assert [(r["depth"], r["neighbor_name"]) for r in items] == [(1, "f"), (2, "r")] and items[1]["path"] == ["e1", "e2"]
    assert report["sources"].collect()[0]["source"] == "api"
    for profile, n in (("impact", 0), ("structural", 1)):
        assert traverse.blast_radius(edges, e, ids["api"], "out", 1, 10, traverse.profile_types(profile)).count() == n
    with pytest.raises(ValueError):
        traverse.radius_report(edges, e, "unknown")
    assert traverse.neighbors(edges, ids["f"], "both", 1).select("direction").collect()[0][0] == "out"


def test_unresolved_report(spark):
    rows = [
        edge(1, "s", "inventory-service", "service", "CALLS_SERVICE", "api-service"), edge(2, "s", "inventory-service", "service", "CALLS_SERVICE", "api-service"), edge(3, "s", "./x", "module", "IMPORTS", "api-service"),
        edge(4, "s", "GET /x", "api_route", "CALLS_HTTP", "web"), edge(5, "s", "Load", "stored_procedure", "CALLS_SQL", "api-service"), edge(6, "s", "done", "service", "CALLS_SERVICE", "web", "id"),
    ]
    edges = spark.createDataFrame(rows, EDGE).withColumn("resolution_status", F.when(F.col("edge_id") == "e5", "ambiguous"))
    s = reports.unresolved_summary(edges).head()
    assert (s["edges"], s["groups"], s["likely_missing_source"], s["likely_parser_gap"], s["ambiguous_target"]) == (5, 4, 2, 2, 1)
    top = reports.unresolved_source_hotspots(edges).head()
    assert (top["source_name"], top["count"]) == ("api-service", 4)
    group = reports.unresolved_groups(edges).orderBy(F.desc("count")).head()
    assert (group["to_name"], group["count"], group["examples"]) == ("inventory-service", 2, "e1,e2")
    codes = [r["code"] for r in reports.coverage_warnings(edges).collect()]
    assert codes[0] in ("missing_source", "parser_gap", "unresolved_service_calls") and codes[-1] == "unresolved_imports"


def test_reconciliation_classes(spark):
    e = entities_of(
        spark, ("sql_table", "Orders", "db", [], {"full_name": "dbo.Orders", "schema_state": "current_database"}), ("sql_view", "CustomerSummary", "db", [], {"schema_state": "current_database"}),
        ("sql_table", "CustomerSummary", "repo", [], {"schema_state": "current_schema"}), ("sql_table", "LegacyCustomer", "repo", [], {"schema_state": "historical"}),
    )
    edges = spark.createDataFrame([
        edge(1, "s", "LoadMissing", "stored_procedure"), edge(2, "s", "MissingParent", "sql_table", "REFERENCES_SQL_OBJECT", "current-db", parser="sqlserver_metadata"),
    ], EDGE)
    got = {r["classification"]: r["target_name"] for r in reports.reconciliation_groups(edges, e).collect()}
    assert got == {
        "code_only_reference": "LoadMissing", "unresolved_database_reference": "MissingParent", "schema_drift": "CustomerSummary",
        "migration_only_object": "LegacyCustomer", "database_only_object": "dbo.Orders",
    }


def test_normalisers(spark):
    row = spark.range(1).select(
        exprs.normalize_key(F.lit(" [dbo].[Orders] ")), exprs.normalized_sql_key(F.lit("[dbo]. [Orders]")), exprs.route_path(F.lit("https://h.example/a/12/{id}?q#f")), exprs.service_from_env(F.lit("ORDER_BASE_URL")),
        exprs.service_from_url(F.lit("http://orders.svc.local/x")), exprs.relationship_type(F.lit("1 bad-type")), exprs.service_from_identifier(F.lit("OrderServiceClient")),
    ).head()
    assert list(row) == ["dbo].[orders", "dbo.orders", "/a/:param/:param", "order", "orders", "EDGE_1_BAD_TYPE", "order-service-client"]


def test_incremental(spark):
    files = "source_name string, rel_path string, content string"
    now = incremental.snapshot(spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "z", "3"), ("n", "q", "")], files))
    then = incremental.snapshot(spark.createDataFrame([("a", "x", "1"), ("a", "y", "0"), ("a", "w", "4"), ("b", "z", "3")], files))
    got = {r["source_name"]: (r["status"], r["reasons"]) for r in incremental.comparison(now, then).collect()}
    assert got == {"a": ("changed", "files_modified,files_removed"), "b": ("unchanged", ""), "n": ("new", "files_added")}
    rebuilt = incremental.to_rebuild(incremental.comparison(now, then), spark.createDataFrame([("a",), ("n",)], "source_name string"))
    assert {r["source_name"]: r["reason"] for r in rebuilt.collect()} == {"a": "changed", "b": "missing_artifact", "n": "new"}
    assert incremental.load_decision("s", ["a"], "s", ["a"], []) == ("skip", []) and incremental.load_decision(None, [], "s", ["a"], ["a"])[0] == "full_load"


def test_store_refuses_bad_arguments(spark):
    for call in (lambda: store.limit_of(0, 10), lambda: store.limit_of(True, 10), lambda: store.depth_of(4), lambda: store.direction_of("up")):
        with pytest.raises(ValueError):
            call()


def test_neighbours_of_a_hub_cost_the_limit(spark):
    from codeloom.operators import traverse

    n = 100_000
    hub = spark.range(n).selectExpr("concat('e', id) AS edge_id", "elt(id % 2 + 1, 'CALLS_HTTP', 'CALLS_SERVICE') AS edge_type", "'hub' AS from_entity_id", "'hub' AS from_name", "concat('n', id) AS to_entity_id", "concat('n', id) AS to_name")
    back = spark.range(n).selectExpr("concat('b', id) AS edge_id", "'IMPORTS' AS edge_type", "concat('n', id) AS from_entity_id", "concat('n', id) AS from_name", "'hub' AS to_entity_id", "'hub' AS to_name")
    root = spark.createDataFrame([("r", "IMPORTS", "root", "root", "hub", "hub")], hub.schema)
    edges = hub.union(back).union(root).selectExpr("*", "true AS resolved", "'s' AS source_name")
    got = traverse.neighbors(edges, "root", "both", 3, limit=40).collect()
    names = sorted(f"n{i}" for i in range(0, n, 2))[:39]
    assert [(r["depth"], r["neighbor_id"]) for r in got] == [(1, "hub"), *[(2, x) for x in names]]
    # Under a limit that nothing reaches, the same as all trails.
    small = edges.where("edge_id IN ('r', 'e0', 'e1', 'b0')")
    rows = traverse.neighbors(small, "root", "both", 3, limit=200).collect()
    whole = [(d, r["depth"], tuple(r["path"])) for d in ("out", "in") for r in traverse.trails(small, spark.createDataFrame([("root",)], "root string"), d, 3).collect()]
    assert sorted((r["direction"], r["depth"], tuple(r["path"])) for r in rows) == sorted(whole) and len(rows) == 4
    assert traverse.neighbors(small, "nobody").collect() == []

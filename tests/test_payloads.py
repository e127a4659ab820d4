import json

from codeloom.operators import payloads, traverse
from pyspark.sql import functions as F

ENTITY = "entity_id string, entity_type string, name string, source_name string, file_path string, line_number int, aliases array<string>, properties map<string,string>"
EDGE = "edge_id string, edge_type string, from_entity_id string, from_name string, to_entity_id string, to_name string, to_type string, resolved boolean, source_name string, file_path string, line_number int, properties map<string,string>"


def graph(spark):
    entities = spark.createDataFrame([(x, "service", f"svc-{x}", "s", None if x == "a" else "f", None, None if x == "b" else ["n"], {"k": "v", "none": None}) for x in "abc"], ENTITY)
    edges = spark.createDataFrame([
        ("e1", "CALLS_SERVICE", "a", "svc-a", "b", "svc-b", "service", True, "s", "  ", 3, None), ("e2", "CALLS_SERVICE", "b", "svc-b", "c", "svc-c", "service", True, "s", None, None, {}),
        ("e3", "CALLS_HTTP", "b", "svc-b", None, "GET /x", "api_route", False, "s", None, None, None),
    ], EDGE)
    return entities, edges


def test_paths_of_two_steps_in_both_directions(spark):
    entities, edges = graph(spark)
    rows = {(r["direction"], r["neighbor_id"]): json.loads(r["j"]) for r in payloads.neighbors(traverse.neighbors(edges, "a", "out", 2), edges, entities).withColumn("j", payloads.as_json("payload")).collect()}
    two = rows["out", "c"]
    assert two["depth"] == 2 and two["path"]["node_ids"] == ["a", "b", "c"] and two["path"]["edge_ids"] == ["e1", "e2"]
    assert [(s["index"], s["from"]["entity_id"], s["edge"]["edge_id"], s["to"]["entity_id"]) for s in two["path"]["steps"]] == [(1, "a", "e1", "b"), (2, "b", "e2", "c")]
    assert two["neighbor"] == {"entity_id": "c", "entity_type": "service", "name": "svc-c", "source_name": "s", "file_path": "f", "aliases": ["n"], "properties": {"k": "v"}}
    assert "file_path" not in two["path"]["nodes"][0] and "file_path" not in two["path"]["edges"][0] and two["path"]["nodes"][1]["aliases"] == []
    back = {r["neighbor_id"]: r["payload"] for r in payloads.neighbors(traverse.neighbors(edges, "c", "in", 2), edges, entities).collect()}
    assert back["a"]["path"]["node_ids"] == ["a", "b", "c"] and back["a"]["neighbor"]["entity_id"] == "a"


def test_unresolved_targets_truncation_and_groups(spark):
    entities, edges = graph(spark)
    found = traverse.blast_radius(edges, entities, "a", "out", 2, 2)
    items = payloads.radius(found, edges, entities, 2)
    got = items.withColumn("j", payloads.as_json("payload")).collect()
    assert len(got) == 2 and all(r["truncated"] for r in got)
    whole = payloads.radius(traverse.blast_radius(edges, entities, "a", "out", 2, 50), edges, entities, 50).withColumn("j", payloads.as_json("payload")).collect()
    target = next(json.loads(r["j"]) for r in whole if r["next_id"] == "unresolved:e3")
    assert target["neighbor"] == {"name": "GET /x", "source_name": "s", "target_id": "unresolved:e3", "target_type": "api_route", "resolved": False} and target["path"]["node_ids"] == ["a", "b", "unresolved:e3"]
    assert not any(r["truncated"] for r in whole)
    groups = payloads.groups(payloads.radius(traverse.blast_radius(edges, entities, "a", "out", 2, 50), edges, entities))
    assert {(r["edge_type"], r["neighbor_type"]): (r["count"], r["min_depth"], len(r["examples"])) for r in groups.collect()} == {("CALLS_SERVICE", "service"): (2, 1, 2), ("CALLS_HTTP", "api_route"): (1, 2, 1)}


def test_paths_with_unknown_edges_and_none(spark):
    entities, edges = graph(spark)
    items = spark.createDataFrame([(1, ["e1", "gone"]), (2, [])], "k int, path array<string>")
    assert [r["path_payload"] for r in payloads.paths(items, edges, entities, ["k"]).collect()] == [None, None]
    assert payloads.paths(items.limit(0), edges, entities, ["k"]).where(F.col("path_payload").isNotNull()).count() == 0

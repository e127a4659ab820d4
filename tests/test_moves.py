"""What large graphs must not move: whole edges stay where they are, and are neither sorted nor written twice, where few ids or rows decide."""

import os

import pytest
from pyspark.sql import functions as F
from test_view import EDGE, ENTITY, tables  # noqa: F401

from codeloom.api import Graph
from codeloom.functions import exprs
from codeloom.operators import assemble, payloads, reports, store, traverse
from codeloom.plans import registry
from codeloom.sources import stored


@pytest.fixture
def unhinted(spark):
    """Only what is marked as small is broadcast, as with tables too large for Spark to do so by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled_rows(node):
    """The rows that a plan's shuffles wrote when it ran."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(node.plan())
    below = sum(shuffled_rows(node.children().apply(i)) for i in range(node.children().size()))
    return below + (node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0)


def test_bound_edges_are_told_by_resolution(spark, tables):  # noqa: F811
    assert "LeftSemi" not in plan(registry.queries()["c10_bound_edges"](spark, tables[0]))


@pytest.mark.parametrize("name", ["g12_interaction_sources", "g13_interaction_targets", "g14_interaction_summary", "g42_evidence_groups"])
def test_reports_without_examples_sort_no_edges(spark, tables, name):  # noqa: F811
    folder, con = tables
    got = registry.queries()[name](spark, folder)
    assert "Window" not in plan(got)
    want = con.sql(registry.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in got.columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    """r is called by a and b, a by c, c by a, and b calls nothing that is known; d's edge has no known origin."""
    folder = str(tmp_path_factory.mktemp("graph"))
    entities = [("service", n, "s" if n < "c" else "t", None, None, [], {}) for n in "abcr"]
    spark.createDataFrame([(n, *e) for n, e in zip("abcr", entities)], "entity_id string, " + ENTITY).write.parquet(folder + "/entities")
    edge = lambda i, a, b: (f"e{i}", a, a, "service", b or "gone", "service", b, "CALLS_SERVICE", b is not None, "s" if a < "c" else "t", None, i, None, "high", "p", {})
    spark.createDataFrame([edge(1, "a", "r"), edge(2, "b", "r"), edge(3, "c", "a"), edge(4, "a", "c"), edge(5, "b", None), edge(6, "d", "r")], EDGE).write.parquet(folder + "/edges")
    return spark.read.parquet(folder + "/entities"), spark.read.parquet(folder + "/edges")


def trails(edges, start):
    return sorted((r["root"], r["depth"], tuple(r["path"]), r["neighbor_id"]) for r in traverse.trails(edges, start, "in", 2).collect())


def test_few_trails_go_to_the_edges(unhinted, graph, monkeypatch):
    start = unhinted.createDataFrame([("r",), ("r",)], "root string")
    assert "SortMergeJoin" not in plan(traverse.trails(graph[1], start, "in", 2))
    few = trails(graph[1], start)
    assert few == sorted([("r", 1, ("e1",), "a"), ("r", 1, ("e2",), "b"), ("r", 1, ("e6",), "d"), ("r", 2, ("e1", "e3"), "c")] * 2)
    monkeypatch.setattr(traverse, "SMALL", 0)
    assert trails(graph[1], start) == few
    monkeypatch.setattr(traverse, "SMALL_IDS", 0)
    assert trails(graph[1], start) == few


def reads_edges(df):
    return any("/edges/" in f for f in df.inputFiles())


def test_levels_of_a_radius_are_stored(unhinted, graph):
    entities, edges = graph
    found = traverse.blast_radius(edges, entities, "r", "in", 2, None)
    assert not reads_edges(found) and {(r["next_id"], r["depth"]) for r in found.collect()} == {("a", 1), ("b", 1), ("d", 1), ("c", 2)}
    items = payloads.radius(found, edges, entities)
    assert not reads_edges(items)
    assert {r["next_id"]: list(r["payload"]["path"]["node_ids"]) for r in items.collect() if r["next_id"] in "abc"} == {"a": ["a", "r"], "b": ["b", "r"], "c": ["c", "a", "r"]}


def test_edges_of_known_ends_are_not_shuffled(unhinted, graph, monkeypatch):
    entities, edges = graph
    known = entities.where("entity_id <> 'c'")
    assert "SortMergeJoin" not in plan(store.linked_edges(edges, known))
    linked = lambda: sorted(r["edge_id"] for r in store.linked_edges(edges, known).collect())
    new = (entities.where("entity_id = 'c'"), edges.where("edge_id = 'e3'"))
    assert "SortMergeJoin" not in plan(store.replace_sources(graph, new, ["t"])[1])
    replaced = lambda: sorted(r["edge_id"] for r in store.replace_sources(graph, new, ["t"])[1].collect())
    for _ in range(2):
        assert linked() == ["e1", "e2", "e5"] and replaced() == ["e3", "e5"]
        monkeypatch.setattr(store, "SMALL_IDS", -1)


def test_a_new_folder_is_written_once(spark, graph, tmp_path, monkeypatch):
    def twice(*_):
        raise AssertionError("written to the scratch folder first")

    at = str(tmp_path / "g")
    made = []
    real = stored.Stored._add
    monkeypatch.setattr("codeloom.api.cut", twice)
    monkeypatch.setattr(stored.Stored, "_add", lambda self, df, *a: (made.append(plan(df)), real(self, df, *a)))
    sources = spark.createDataFrame([(0, "s", "/s"), (1, "t", "/t")], "index long, name string, path string")
    Graph("x", sources, *graph).write(at)
    assert made and not any("Exchange" in p for p in made)
    assert sorted(r["edge_id"] for r in Graph.read(spark, at, "x").edges.collect()) == ["e1", "e2", "e3", "e4", "e5", "e6"]
    builds = {r["build"] for r in stored.Stored(spark, at).manifest()}
    Graph("x", sources, *graph).write(at)
    assert {r["build"] for r in stored.Stored(spark, at).manifest()} == builds and len(os.listdir(at + "/data/edges")) == 1


def test_alike_sql_references_are_counted_before_they_meet_entities(spark):
    """Thirty calls of one object that differ in their origins and lines are one row of the report's evidence, with the smallest id."""
    entities = spark.createDataFrame([("t1", "sql_table", "orders", "db", None, None, [], {"schema_state": "current_database"})], "entity_id string, " + ENTITY)
    edge = lambda i, parser: (f"e{i:02}", f"f{i}", f"f{i}", "file", "gone", "sql_object", None, "CALLS_SQL", False, "s", None, i, None, "high", parser, {})
    edges = spark.createDataFrame([edge(i, "sql_reference" if i < 30 else "sqlserver_metadata") for i in range(32)], EDGE)
    assert sorted((r["metadata"], r["n"], r["edge_id"]) for r in reports.sql_edges(edges, entities).collect()) == [(False, 30, "e00"), (True, 2, "e30")]
    got = {(r["classification"], r["target_name"], r["count"], r["example"]) for r in reports.reconciliation_groups(edges, entities).collect()}
    assert got == {("code_only_reference", "gone", 30, "e00"), ("unresolved_database_reference", "gone", 2, "e30"), ("database_only_object", "orders", 1, "t1")}


def test_only_edges_of_several_facts_are_shuffled(unhinted, monkeypatch):
    """Each of the edges 0 and 1 has three facts, of which the last counts, whole; the others have one."""
    fact = lambda i, seq: (f"f{i}", "a", "file", "x", f"type {seq}", None, "CALLS_SQL", False, "s", None, 5, None, "high", f"parser {seq}", {"seq": str(seq)}, seq)
    facts = unhinted.createDataFrame([fact(i, seq) for i in range(200) for seq in ((2, 3, 1) if i < 2 else (1,))], EDGE.replace("edge_id string, ", "") + ", seq long")
    want = sorted((f"f{i}", f"type {seq}", f"parser {seq}", {"seq": str(seq)}, seq) for i in range(200) for seq in [3 if i < 2 else 1])
    got = lambda df: sorted((r["from_entity_id"], r["to_type"], r["parser"], r["properties"], r["seq"]) for r in df.collect())
    edges = assemble.upsert_edges(facts)
    assert edges.columns == ["edge_id", *facts.columns] and got(edges) == want
    assert 2 <= shuffled_rows(edges._jdf.queryExecution().executedPlan()) <= 6
    with monkeypatch.context() as m:
        m.setattr(assemble.F, "xxhash64", lambda *_: F.lit(1).cast("long"))  # as if all ids had one hash
        assert got(assemble.upsert_edges(facts)) == want
    monkeypatch.setattr(assemble, "SMALL_IDS", 1)
    assert got(assemble.upsert_edges(facts)) == want


def test_first_and_last_ids_are_found_without_sorting_edges(spark, tables):  # noqa: F811
    assert "Sort [edge_type" not in plan(registry.queries()["c02_edge_upsert"](spark, tables[0]))
    ids = ["0" * 24, "f" * 24, "0" * 12 + "f" * 12, "f" * 12 + "0" * 12, "0" * 11 + "1" + "0" * 12, "0123456789abcdef01234567"]
    rows = spark.createDataFrame([(x,) for x in ids], "id string").withColumn("n", exprs.id_number("id")).select("id", "n", exprs.id_text("n").alias("back")).orderBy("n").collect()
    assert [r["id"] for r in rows] == [r["back"] for r in rows] == sorted(ids)

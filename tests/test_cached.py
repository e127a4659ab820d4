from codeloom.api import Graph, snapshot_of
from codeloom.cached import Cache, loaded_sources
from codeloom.operators import store


def test_only_changed_sources_are_scanned_and_all_are_resolved(spark, tmp_path):
    web, db = tmp_path / "web", tmp_path / "db"
    web.mkdir()
    db.mkdir()
    (web / "app.py").write_text('def orders():\n    db.execute("SELECT * FROM dbo.Orders")\n')
    (db / "schema.sql").write_text("CREATE TABLE dbo.Other (id int)\nGO\n")
    trees = {"web": str(web), "db": str(db)}
    cache, target = Cache(spark, str(tmp_path / "cache")), str(tmp_path / "g")
    first = cache.refresh("s", trees)
    assert first.scanned == ["db", "web"] and loaded_sources(spark, target) == []
    assert cache.load(first, target, None, []) == "full_load"
    same = cache.refresh("s", trees)
    assert same.scanned == [] and cache.load(same, target, "s", loaded_sources(spark, target)) == "skip"

    # The edge of the unchanged source is resolved by what the changed one declares now.
    (db / "schema.sql").write_text("CREATE TABLE dbo.Orders (id int)\nGO\n")
    third = cache.refresh("s", trees)
    assert third.scanned == third.changed == ["db"]
    assert cache.load(third, target, "s", ["db", "web"]) == "replace_sources"
    stored = Graph.read(spark, target, "s")
    reads = stored.edges.where("edge_type = 'READS_SQL_OBJECT' and to_name = 'dbo.Orders'").collect()
    assert reads and all(r["resolved"] and r["source_name"] == "web" for r in reads)
    assert "dbo.Orders" in (names := {r["name"] for r in stored.entities.collect()}) and "dbo.Other" not in names

    # Other scanners, and tables that are gone, are reasons to scan again.
    other = Cache(spark, str(tmp_path / "cache"), "other").status(snapshot_of(spark, trees), trees)
    assert {r["reasons"] for r in other.collect()} == {"parser_changed"}
    builds = {r["source_name"]: r["build"] for r in cache.state().collect()}
    (tmp_path / "cache" / "issues" / builds["web"]).rename(tmp_path / "gone")
    assert cache.complete() == ["db"]
    stored.export(str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "entities")).count() == len(stored.entities.collect())


def test_unique_keys_and_orphan_targets(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), ("b", None)], "k string, v int")
    assert sorted(store.unique(rows, "k").collect()) == [("a", 2), ("b", None)]
    edges = spark.createDataFrame([("e1", "s", "IMPORTS", "module", "m", None, False), ("e2", "s", "IMPORTS", "module", "n", None, False)], "edge_id string, source_name string, edge_type string, to_type string, to_name string, to_entity_id string, resolved boolean")
    targets = store.target_records(edges)
    assert targets.count() == 2 and [r["name"] for r in store.without_orphan_targets(targets, edges.where("to_name = 'm'")).collect()] == ["m"]

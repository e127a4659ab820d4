from codeloom.api import Graph, snapshot_of


def test_build_store_and_report(spark, tmp_path):
    web, db = tmp_path / "web", tmp_path / "db"
    (web / "node_modules").mkdir(parents=True)
    db.mkdir()
    (web / "package.json").write_text('{"name": "web", "dependencies": {"left": "1"}}')
    (web / "node_modules" / "x.py").write_text("def skipped(): pass")
    (web / "app.py").write_text('@app.get("/orders")\ndef orders():\n    db.execute("SELECT * FROM dbo.Orders")\n')
    (web / "bad.py").write_text("def (")
    (db / "schema.sql").write_text("CREATE TABLE dbo.Orders (id int)\nGO\n")
    trees = {"web": str(web), "db": str(db)}
    graph = Graph.build(spark, "s", trees)
    graph.write(str(tmp_path / "g"))
    graph = Graph.read(spark, str(tmp_path / "g"), "s")
    edges = {(r["edge_type"], r["to_name"]): r for r in graph.edges.collect()}
    assert edges["READS_SQL_OBJECT", "dbo.Orders"]["resolved"] and edges["HANDLES_ROUTE", "orders"]["resolved"]
    assert not edges["DEPENDS_ON_PACKAGE", "left"]["resolved"]
    assert graph.search("orders").count() >= 2 and graph.stats().head()["sources"] == 2
    assert graph.unresolved()["summary"].head()["edges"] >= 1
    assert "skipped" not in {r["name"] for r in graph.entities.collect()}
    assert snapshot_of(spark, trees).count() == 4


def test_build_has_the_edges_of_scripts_and_sql_text(spark, tmp_path):
    web, db = tmp_path / "web", tmp_path / "db"
    web.mkdir()
    db.mkdir()
    (web / "a.ts").write_text('import x from "left-pad";\nexport function list() {}\napp.get("/orders", list);\nfetch("/api/items");\nfetch(process.env.BILLING_URL);\nproducer.send("orders.created");\ncache.get("k1");\ns3.upload("bucket/x");\n'.replace("fetch(process.env.BILLING_URL)", "axios.get(`${process.env.BILLING_URL}/x`);axios.get(url)"))
    (db / "p.sql").write_text("CREATE TABLE dbo.T (id int)\nGO\nCREATE PROCEDURE dbo.P AS\nSELECT * FROM dbo.T\nINSERT INTO dbo.T VALUES (1)\nEXEC dbo.Q\nGO\n")
    graph = Graph.build(spark, "s", {"web": str(web), "db": str(db)})
    edges = {(r["edge_type"], r["to_name"]): r for r in graph.edges.collect()}
    for key in (("IMPORTS", "left-pad"), ("DECLARES_SYMBOL", "list"), ("EXPOSES_ROUTE", "GET /orders"), ("HANDLES_ROUTE", "list"), ("CALLS_HTTP", "GET /api/items"), ("PUBLISHES_MESSAGE", "orders.created"), ("READS_CACHE_KEY", "k1"), ("WRITES_STORAGE_OBJECT", "bucket/x"), ("READS_SQL_OBJECT", "dbo.T"), ("WRITES_SQL_OBJECT", "dbo.T"), ("CALLS_SQL", "dbo.Q")):
        assert key in edges, (key, sorted(edges))
    assert any(k[0] == "CALLS_SERVICE" for k in edges)
    assert edges["READS_SQL_OBJECT", "dbo.T"]["resolved"] and edges["EXPOSES_ROUTE", "GET /orders"]["resolved"]
    assert not edges["CALLS_SQL", "dbo.Q"]["resolved"]


def test_scaffold_scopes_and_confidence(spark):
    from codeloom.api import Graph

    code = "export function load() {\n  fetch('/orders/1', {method: 'put'});\n  helper();\n  q('SELECT * FROM dbo.T');\n}\nhelper();\nfunction helper() { redis.get('k'); }\n"
    rows = [
        ("web", "package.json", ".json", '{"name": "shop"}'), ("web", "src/deep/package.json", ".json", '{"name": "deep"}'), ("web", "src/deep/x/a.ts", ".ts", code), ("web", "src/b.ts", ".ts", ""),
        ("job", "w.py", ".py", "def run():\n    sqs.send_message(QueueUrl='https://q/1/jobs')\n    open('/tmp/x', 'w')\n    s3.get_object(Bucket='b', Key='k')\n    cache.get('c')\n"),
    ]
    files = spark.createDataFrame(rows, "source_name string, rel_path string, extension string, content string")
    graph = Graph.of_files(spark, "s", {"web": "/w", "job": "/j"}, files)
    got = {(r["edge_type"], r["from_name"], r["to_name"]): r for r in graph.edges.collect()}
    for key in (
        ("CONTAINS_PROJECT", "web", "shop"), ("CONTAINS_PROJECT", "web", "deep"), ("CONTAINS_FILE", "web", "src/b.ts"), ("CONTAINS_FILE", "shop", "src/b.ts"), ("CONTAINS_FILE", "deep", "src/deep/x/a.ts"),
        ("CALLS_HTTP", "load", "PUT /orders/:param"), ("CALLS_HTTP", "src/deep/x/a.ts", "PUT /orders/:param"), ("CALLS_SYMBOL", "load", "helper"), ("READS_SQL_OBJECT", "load", "dbo.T"),
        ("READS_CACHE_KEY", "helper", "k"), ("PUBLISHES_MESSAGE", "run", "jobs"), ("WRITES_STORAGE_OBJECT", "run", "/tmp/x"), ("READS_STORAGE_OBJECT", "run", "b/k"), ("READS_CACHE_KEY", "run", "c"),
    ):
        assert key in got, (key, sorted(got))
    assert ("CONTAINS_FILE", "shop", "src/deep/x/a.ts") not in got and ("READS_SQL_OBJECT", "src/deep/x/a.ts", "dbo.T") in got
    assert all(r["resolved"] and r["confidence"] == "high" for k, r in got.items() if k[0].startswith(("CONTAINS", "DECLARES")))
    ids = {r["entity_id"] for r in graph.entities.collect()}
    assert all(r["from_entity_id"] in ids and (not r["resolved"] or r["to_entity_id"] in ids) for r in got.values())
    assert graph.issues.count() == 0


def test_sql_references_come_from_the_object_they_stand_in(spark):
    rows = [
        ("db", "t.sql", ".sql", "CREATE TABLE dbo.T (id int)\nGO\n"),
        ("db", "p.sql", ".sql", "CREATE PROCEDURE dbo.P AS\nSELECT * FROM [dbo].[T]\nGO\nSELECT 1 FROM dbo.Loose\nCREATE OR ALTER PROC dbo.R AS EXEC dbo.P\nUPDATE dbo.T SET x = 1 ON UPDATE CASCADE ON DELETE NO ACTION\nGO\n"),
        ("app", "a.cs", ".cs", 'class A { void M() { db.Query("SELECT * FROM dbo.T"); } }'),
        ("app", "b.py", ".py", "from os import path\nx = 'DELETE FROM dbo.T'\n"),
        ("app", "c.ts", ".ts", 'import x from "pkg";\nfunction f() {\n  export * from "lodash";\n}\n'),
    ]
    files = spark.createDataFrame(rows, "source_name string, rel_path string, extension string, content string")
    graph = Graph.of_files(spark, "s", {"db": "/d", "app": "/a"}, files)
    got = {(r["edge_type"], r["from_type"], r["from_name"], r["to_name"]): r for r in graph.edges.collect() if "SQL" in r["edge_type"] or r["edge_type"] == "DEFINES"}
    assert set(got) == {
        ("DEFINES", "file", "t.sql", "dbo.T"), ("DEFINES", "file", "p.sql", "dbo.P"), ("DEFINES", "file", "p.sql", "dbo.R"),
        ("READS_SQL_OBJECT", "stored_procedure", "dbo.P", "dbo.T"), ("READS_SQL_OBJECT", "file", "p.sql", "dbo.Loose"), ("CALLS_SQL", "stored_procedure", "dbo.R", "dbo.P"),
        ("WRITES_SQL_OBJECT", "stored_procedure", "dbo.R", "dbo.T"), ("READS_SQL_OBJECT", "file", "a.cs", "dbo.T"), ("READS_SQL_OBJECT", "file", "b.py", "dbo.T"), ("WRITES_SQL_OBJECT", "file", "b.py", "dbo.T"),
    }
    assert all(r["resolved"] for k, r in got.items() if k[3] != "dbo.Loose")
    assert got["CALLS_SQL", "stored_procedure", "dbo.R", "dbo.P"]["properties"]["source_context_name"] == "dbo.R"
    ids = {r["name"]: r["entity_id"] for r in graph.entities.collect()}
    reached = {r["next_id"] for r in graph.impact(ids["dbo.T"])["items"].collect()}
    assert {ids["dbo.P"], ids["dbo.R"]} <= reached


def test_names_that_scanners_find_resolve(spark):
    service = "apiVersion: v1\nkind: Service\nmetadata:\n  name: price\n  namespace: shop\n"
    rows = [
        ("k8s", "price.yaml", ".yaml", service),
        ("py", "pyproject.toml", ".toml", '[project]\nname = "My_Lib"\n'), ("app", "a.py", ".py", "import my_lib\n"),
        ("net", "A.cs", ".cs", 'class A {\n  [HttpGet("/orders/{id}")]\n  public int Get(int id) {\n    bus.Publish<Made>(m);\n    return 1;\n  }\n}\n'), ("web", "w.ts", ".ts", "fetch('/orders/7');\n"),
    ]
    files = spark.createDataFrame(rows, "source_name string, rel_path string, extension string, content string")
    graph = Graph.of_files(spark, "s", {n: n for n in ("k8s", "py", "app", "net", "web")}, files)
    got = {(r["edge_type"], r["from_name"], r["to_name"]): r for r in graph.edges.collect()}
    assert got["CALLS_HTTP", "w.ts", "GET /orders/:param"]["resolved"] and got["IMPORTS", "a", "my-lib"]["resolved"]
    assert ("PUBLISHES_MESSAGE", "A.Get", "Made") in got
    aliases = {r["name"]: r["aliases"] for r in graph.entities.collect()}
    assert "price.shop.svc.cluster.local" in aliases["price"] and "my_lib" in aliases["my-lib"]
    assert {r["entity_type"]: r["properties"] for r in graph.entities.collect() if r["name"] == "price"}["service"]["namespace"] == "shop"

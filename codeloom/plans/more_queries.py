"""Queries of operators that read texts, catalogs or snapshots instead of the graph view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.functions import exprs
from codeloom.operators import catalog, facts, incremental, scanners, sqltext
from codeloom.sources import files as file_source

Query = Callable[[SparkSession, str], DataFrame]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as SQL files: a statement a lineitem; the file's directory depends on the order's priority."""
    items, parts = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.translate("p_name", " ", "_")
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    text = (
        F.when(n == 1, F.concat(F.lit("CREATE TABLE sales.["), name, F.lit("] (id int REFERENCES dbo.keys)")))
        .when(flag == "A", F.concat(F.lit("SELECT * FROM [dbo].["), name, F.lit("] a JOIN dim.dates d"))).when(flag == "N", F.concat(F.lit("EXEC dbo.load_"), name))
        .otherwise(F.concat(F.lit("INSERT INTO stage."), name, F.lit(" SELECT 1; DELETE FROM "), name))
    )
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", text.alias("t")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_set("s")), lambda x: x["t"]), "\n")
    path = F.concat(F.when(F.col("l_orderkey") % 3 == 0, "db/migrations/o").otherwise("db/o"), F.col("l_orderkey").cast("string"), F.lit(".sql"))
    return rows.groupBy("l_orderkey").agg(joined.alias("content")).select(F.concat(F.lit("repo-"), (F.col("l_orderkey") % 10).cast("string")).alias("source_name"), path.alias("rel_path"), "content")


_SUPPLIERS = "WITH x AS (SELECT 'NATION_' || s_nationkey AS s, s_suppkey::VARCHAR AS k, s_nationkey::VARCHAR AS n FROM supplier) "

_FILES = """
WITH stmt AS (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS f, replace(p_name, ' ', '_') AS n FROM lineitem JOIN part ON l_partkey = p_partkey
), uniq AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'C' ELSE f END AS k, n FROM stmt),
src AS (SELECT *, 'repo-' || (l_orderkey % 10) AS source_name FROM uniq)
"""


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def b70(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(sqltext.definitions(files(spark, sf_dir)), "source_name", "entity_type", "full_name", "schema", "name")


def b71(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(sqltext.calls(files(spark, sf_dir)), "source_name", "to_name", "to_type")


def b72(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(sqltext.reads(files(spark, sf_dir)), "source_name", "to_name", "edge_type")


def b73(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(sqltext.writes(files(spark, sf_dir)), "source_name", "to_name", "sql_operation")


def b74(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(sqltext.schema_references(files(spark, sf_dir)), "source_name", "to_name")


def b75(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(sqltext.scopes(files(spark, sf_dir)).where("scope is not null"), "source_name", "scope")


def b76(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(sqltext.scan(files(spark, sf_dir)), "edge_type", "dependency_scope", "interaction_kind")


def b77(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, kind = sqltext.provenance()
    return _count(files(spark, sf_dir).select(state.alias("schema_state"), kind.alias("kind")), "schema_state", "kind")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("source").alias("source_name"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("rel_path"), F.col("text").alias("content"), "doc_id")


def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.snapshot(_documents(spark, sf_dir))


def _two_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, sf_dir)
    before = docs.where("doc_id % 11 <> 0").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return incremental.snapshot(docs.where("doc_id % 13 <> 0")), incremental.snapshot(before)


def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.diff(*_two_snapshots(spark, sf_dir))


def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.comparison(*_two_snapshots(spark, sf_dir))


def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = incremental.comparison(*_two_snapshots(spark, sf_dir))
    return incremental.to_rebuild(compared, _documents(spark, sf_dir).where("source_name <> 'src1'"))


_DIFF = """
WITH c AS (SELECT source AS source_name, 'doc/' || doc_id AS path, doc_id FROM documents),
d AS (SELECT source_name, path, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 13 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'modified' END AS change
      FROM c WHERE NOT (doc_id % 11 = 0 AND doc_id % 13 = 0))
"""


def b51(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses as they are, behind a base, with a parameter inside a segment, and others."""
    path = F.regexp_extract("url", "^https?://[^/]*(/.*)$", 1)
    raws = F.array("url", F.concat(F.lit("${base}"), path), F.regexp_replace("url", "/([0-9]+)", "/a-{$1}-b"), *[F.lit(x) for x in ("/x/{id}", "http://bare.example", "plain/<id>/:q/7", "//10.0.0.1:80/p;v=1")])
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(raws).alias("raw"))
    return pages.select("page_id", "raw", exprs.route_path("raw").alias("route"), exprs.service_from_url("raw").alias("service"))


def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_source.snippet(_documents(spark, sf_dir), "doc/2", 3, 2)


def b52(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey").cast("string")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        "s_suppkey", exprs.service_from_env(F.concat(F.lit("ORDER_"), n, F.lit("_API_URL"))).alias("of_env"), exprs.service_from_identifier(F.concat(F.lit("orderService_"), n, F.lit("Client"))).alias("of_identifier"),
        exprs.service_from_identifier(F.concat(F.lit(" Price_"), n, F.lit(".BaseUrl"))).alias("of_address"), exprs.service_from_identifier(F.lit(" -Url")).alias("of_nothing"),
        exprs.python_package(F.concat(F.lit(" My_Lib_"), n)).alias("package"), exprs.package_root(F.concat(F.lit("@a/b"), n, F.lit("/deep"))).alias("root"), exprs.truthy(F.when(F.col("s_nationkey") % 2 == 0, " Yes").otherwise("0")).alias("truthy"),
    )


def b50(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    code = pages.select(F.concat(F.lit("repo-"), (F.col("page_id") % 10).cast("string")).alias("source_name"), F.concat(F.lit("src/p"), F.col("page_id").cast("string"), F.lit(".ts")).alias("rel_path"), F.concat(F.lit('import x from "pkg/a";\nconst r = fetch("'), "url", F.lit('", {method: "POST"});\naxios.get(`${process.env.ORDER_API_URL}/x`); axios.put(process.env.OTHER_URL);')).alias("content"))
    return _count(scanners.http_calls(code), "source_name", "method", "edge_type", "to_type")


def b55(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    code = pages.select(F.lit("repo").alias("source_name"), F.concat(F.lit("src/p"), F.col("page_id").cast("string"), F.lit(".ts")).alias("rel_path"), F.concat(F.lit('import x from "@acme/pkg'), (F.col("page_id") % 5).cast("string"), F.lit('/deep";\nconst y = require("./local");\nexport * from "lodash/fp";')).alias("content"))
    return _count(scanners.imports(code), "to_name", "import_kind")


def _suppliers(spark: SparkSession, sf_dir: str, path: str, text) -> DataFrame:
    """A file a supplier: path with its key, text as a Column of key and nation."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("n"))
    return rows.select(F.concat(F.lit("NATION_"), "n").alias("source_name"), F.format_string(path, "k").alias("rel_path"), text.alias("content"))


def _found(df: DataFrame) -> DataFrame:
    return _count(df.where("issue is null"), "source_name", "edge_type", "from_type", "to_type", "to_name")


def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('{"name": "app-%s", "dependencies": {"lib-%s": "^1.0"}, "devDependencies": {"@t/x": "2"}}', "k", "n")
    return _found(facts.scan(_suppliers(spark, sf_dir, "s%s/package.json", text)))


def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("# %s\n-r base.txt\nLib_%s>=1 # why\n\nrequests\n", "k", "n")
    return _found(facts.scan(_suppliers(spark, sf_dir, "s%s/requirements.txt", text)))


def b20(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(
        "apiVersion: v1\nkind: Service\nmetadata:\n  name: svc-%s\nspec:\n  selector:\n    app: a%s\n---\napiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: d\nspec:\n  template:\n    metadata:\n      labels:\n        app: a1\n",
        "k", "n",
    )
    return _found(facts.scan(_suppliers(spark, sf_dir, "s%s/k8s.yaml", text)))


def b32(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('import os\n@app.get("/n%s")\ndef f():\n    db.execute("SELECT 1 FROM t%s")\n', "n", "n")
    return _found(facts.scan(_suppliers(spark, sf_dir, "s%s/app.py", text)))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(
        'app.get("/n/%s", listAll);\nexport function listAll() {}\nredisCache.get("k%s");\nredisCache.set("k", 1);\nkafkaProducer.send("topic-%s");\ncron.schedule("* * * * *", listAll);\ns3.getObject("b/%s");\n', "n", "n", "n", "n"
    )
    return _suppliers(spark, sf_dir, "s%s/a.ts", text)


def b53(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(scanners.routes(_code(spark, sf_dir)), "source_name", "route", "handler")


def b57(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(scanners.cache_calls(_code(spark, sf_dir)), "source_name", "edge_type", "to_name")


def b58(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(scanners.message_calls(_code(spark, sf_dir)), "source_name", "edge_type", "to_type", "to_name")


def b59(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(scanners.storage_calls(_code(spark, sf_dir)), "source_name", "edge_type", "to_name")


def b60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(scanners.jobs(_code(spark, sf_dir)), "source_name", "name", "schedule", "handler")


def b30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(scanners.symbols(_code(spark, sf_dir)), "source_name", "entity_type", "name", "exported")


def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    event = F.when(F.col("l_returnflag") == "A", "Insert").when(F.col("l_returnflag") == "N", "update").otherwise("DELETE")
    rows = items.select(F.lit("dbo").alias("schema_name"), F.concat(F.lit("trg_"), F.col("l_partkey").cast("string")).alias("trigger_name"), F.lit("dbo").alias("table_schema_name"), F.concat(F.lit("t_"), F.col("l_partkey").cast("string")).alias("table_name"), event.alias("event_name"), F.lit(False).alias("is_disabled"))
    return catalog.sqlserver_triggers(rows).select("trigger_name", "table_name", "events", "is_disabled")


def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.array_join(catalog.postgres_trigger_events(F.col("p_size").cast("int")), ",").alias("events"))


def b83(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, schemas, keys = catalog.fixture_keys(spark, sf_dir)
    known = catalog.object_entities(catalog.sqlserver_objects(objects, schemas, None), "db", "sqlserver")
    edges, issues = catalog.foreign_key_edges(catalog.foreign_keys(objects, schemas, keys, None), "db", known)
    tally = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return tally(edges.where("resolved"), "resolved").unionByName(tally(edges.where("not resolved"), "unresolved")).unionByName(tally(issues, "issues"))


def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.sqlserver_objects(*catalog.fixture(spark, sf_dir), limit=None)


def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, schemas, keys = catalog.fixture_keys(spark, sf_dir)
    return catalog.foreign_keys(objects, schemas, keys, limit=None)


def queries() -> dict[str, Query]:
    return {
        "a20_catalog_objects": a20, "a21_catalog_foreign_keys": a21, "b50_http_targets": b50, "b51_route_paths": b51, "b55_imports": b55,
        "a22_catalog_triggers": a22, "a27_trigger_events": a27, "b10_package_json": b10, "b13_requirements": b13, "b20_kubernetes": b20, "b30_symbols": b30,
        "b32_python_code": b32, "b53_routes": b53, "b57_cache_calls": b57, "b58_message_calls": b58, "b59_storage_calls": b59, "b60_jobs": b60, "b83_foreign_key_edges": b83,
        "b70_sql_definitions": b70, "b71_sql_calls": b71, "b72_sql_reads": b72, "b73_sql_writes": b73, "b74_sql_references": b74, "b75_sql_scopes": b75,
        "b76_sql_scan": b76, "b77_sql_provenance": b77, "f01_snapshot": f01, "f02_snapshot_diff": f02, "f04_snapshot_status": f04, "f05_to_rebuild": f05, "a14_snippet": a14, "b52_service_names": b52,
    }


def oracle_sql() -> dict[str, str]:
    n = "count(*) AS n"
    return {
        "a20_catalog_objects": "SELECT 'schema_' || (p_partkey % 3) AS schema_name, 'obj_' || p_partkey AS object_name, CASE p_partkey % 4 WHEN 0 THEN 'U' WHEN 1 THEN 'V' WHEN 2 THEN 'P' ELSE 'FN' END AS object_type FROM part WHERE p_partkey % 5 <> 0",
        "a21_catalog_foreign_keys": "SELECT 'schema_' || (p_partkey % 3) AS schema_name, 'obj_' || p_partkey AS table_name, 'schema_' || ((p_partkey // 2) % 3) AS referenced_schema_name, 'obj_' || (p_partkey // 2) AS referenced_table_name, 'fk_' || p_partkey AS constraint_name FROM part",
        "a22_catalog_triggers": "SELECT 'trg_' || l_partkey AS trigger_name, 't_' || l_partkey AS table_name, string_agg(DISTINCT CASE l_returnflag WHEN 'A' THEN 'INSERT' WHEN 'N' THEN 'UPDATE' ELSE 'DELETE' END, ',' ORDER BY CASE l_returnflag WHEN 'A' THEN 'INSERT' WHEN 'N' THEN 'UPDATE' ELSE 'DELETE' END) AS events, false AS is_disabled FROM lineitem GROUP BY l_partkey",
        "a27_trigger_events": "SELECT p_partkey, concat_ws(',', CASE WHEN p_size & 4 <> 0 THEN 'INSERT' END, CASE WHEN p_size & 16 <> 0 THEN 'UPDATE' END, CASE WHEN p_size & 8 <> 0 THEN 'DELETE' END, CASE WHEN p_size & 32 <> 0 THEN 'TRUNCATE' END) AS events FROM part",
        "b10_package_json": _SUPPLIERS + "SELECT s AS source_name, e AS edge_type, f AS from_type, 'package' AS to_type, t AS to_name, count(*) AS n FROM (SELECT s, 'DECLARES_PACKAGE' AS e, 'project' AS f, 'app-' || k AS t FROM x UNION ALL SELECT s, 'DEPENDS_ON_PACKAGE', 'package', 'lib-' || n FROM x UNION ALL SELECT s, 'DEPENDS_ON_PACKAGE', 'package', '@t/x' FROM x) GROUP BY ALL",
        "b13_requirements": _SUPPLIERS + "SELECT s AS source_name, 'DEPENDS_ON_PACKAGE' AS edge_type, 'package' AS from_type, 'package' AS to_type, t AS to_name, count(*) AS n FROM (SELECT s, unnest(['lib-' || n, 'requests']) AS t FROM x) GROUP BY ALL",
        "b20_kubernetes": _SUPPLIERS + "SELECT s AS source_name, e AS edge_type, f AS from_type, t AS to_type, o AS to_name, count(*) AS n FROM (SELECT s, 'DECLARES_SERVICE' AS e, 'file' AS f, 'service' AS t, 'svc-' || k AS o FROM x UNION ALL SELECT s, 'DECLARES_DEPLOYMENT', 'file', 'deployment', 'd' FROM x UNION ALL SELECT s, 'SELECTS_DEPLOYMENT', 'service', 'deployment', 'd' FROM x WHERE n = '1') GROUP BY ALL",
        "b30_symbols": _SUPPLIERS + "SELECT s AS source_name, 'function' AS entity_type, 'listAll' AS name, true AS exported, count(*) AS n FROM x GROUP BY s",
        "b32_python_code": _SUPPLIERS + "SELECT s AS source_name, e AS edge_type, f AS from_type, t AS to_type, o AS to_name, count(*) AS n FROM (SELECT s, 'IMPORTS' AS e, 'module' AS f, 'package' AS t, 'os' AS o FROM x UNION ALL SELECT s, 'DECLARES_SYMBOL', 'module', 'function', 'f' FROM x UNION ALL SELECT s, 'HANDLES_ROUTE', 'api_route', 'function', 'f' FROM x UNION ALL SELECT s, 'READS_SQL_OBJECT', 'function', 'sql_object', 't' || n FROM x) GROUP BY ALL",
        "b53_routes": _SUPPLIERS + "SELECT s AS source_name, 'GET /n/:param' AS route, 'listAll' AS handler, count(*) AS n FROM x GROUP BY s",
        "b57_cache_calls": _SUPPLIERS + "SELECT s AS source_name, e AS edge_type, t AS to_name, count(*) AS n FROM (SELECT s, 'WRITES_CACHE_KEY' AS e, 'k' AS t FROM x UNION ALL SELECT s, 'READS_CACHE_KEY', 'k' || n FROM x) GROUP BY ALL",
        "b58_message_calls": _SUPPLIERS + "SELECT s AS source_name, 'PUBLISHES_MESSAGE' AS edge_type, 'message_topic' AS to_type, 'topic-' || x.n AS to_name, count(*) AS n FROM x GROUP BY s, x.n",
        "b59_storage_calls": _SUPPLIERS + "SELECT s AS source_name, 'READS_STORAGE_OBJECT' AS edge_type, 'b/' || x.n AS to_name, count(*) AS n FROM x GROUP BY s, x.n",
        "b60_jobs": _SUPPLIERS + "SELECT s AS source_name, 'listAll @ * * * * *' AS name, '* * * * *' AS schedule, 'listAll' AS handler, count(*) AS n FROM x GROUP BY s",
        "b83_foreign_key_edges": "WITH k AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 4 = 0) SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p_partkey NOT IN (SELECT k FROM k) THEN 'issues' WHEN p_partkey // 2 IN (SELECT k FROM k) THEN 'resolved' ELSE 'unresolved' END AS kind FROM part) GROUP BY kind",
        "b50_http_targets": "SELECT 'repo-' || (page_id % 10) AS source_name, m AS method, CASE m WHEN 'POST' THEN 'CALLS_HTTP' ELSE 'CALLS_SERVICE' END AS edge_type, CASE m WHEN 'POST' THEN 'api_route' ELSE 'service' END AS to_type, count(*) AS n FROM pages, (VALUES ('POST'), ('GET')) AS t(m) GROUP BY ALL",
        "b55_imports": "SELECT '@acme/pkg' || (page_id % 5) AS to_name, 'package' AS import_kind, count(*) AS n FROM pages GROUP BY ALL UNION ALL SELECT './local', 'relative', count(*) FROM pages UNION ALL SELECT 'lodash', 'package', count(*) FROM pages",
        "b51_route_paths": r"""WITH raw AS (SELECT page_id, raw FROM (SELECT page_id, unnest([url, '${base}' || regexp_extract(url, '^https?://[^/]*(/.*)$', 1), regexp_replace(url, '/([0-9]+)', '/a-{\1}-b'), '/x/{id}', 'http://bare.example', 'plain/<id>/:q/7', '//10.0.0.1:80/p;v=1']) AS raw FROM pages)),
ends AS (SELECT *, CASE WHEN regexp_matches(raw, '^\$\{[^}]*\}/') THEN regexp_extract(raw, '^\$\{[^}]*\}(.*)$', 1) WHEN raw LIKE '%}%' AND split_part(raw, '}', -1) LIKE '/%' THEN split_part(raw, '}', -1) WHEN raw = 'http://bare.example' THEN raw
  WHEN raw LIKE 'http%' THEN regexp_extract(raw, '^https?://[^/]*([^?#]*)', 1) WHEN raw LIKE '//%' THEN '/p' ELSE raw END AS ending FROM raw),
parts AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(ending, '[?#].*$', ''), '\$?\{[^}]+\}', ':param', 'g'), '/'), lambda x: x <> '') AS segments FROM ends)
SELECT page_id, raw, '/' || array_to_string(list_transform(segments, lambda x: CASE WHEN x LIKE ':%' OR regexp_full_match(x, '[0-9]+') THEN ':param' ELSE x END), '/') AS route,
  CASE WHEN raw LIKE 'http%' THEN lower(string_split(regexp_extract(raw, '^https?://([^/?#:]+)', 1), '.')[1]) WHEN raw LIKE '//%' THEN '10' ELSE 'external-service' END AS service FROM parts""",
        "b75_sql_scopes": _FILES + "SELECT source_name, scope, count(*) AS n FROM (SELECT source_name, last_value(CASE WHEN k = 'C' THEN 'sales.' || src.n END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS scope FROM src) WHERE scope IS NOT NULL GROUP BY source_name, scope",
        "f05_to_rebuild": _DIFF + "SELECT source_name, CASE WHEN count(change) > 0 THEN 'changed' ELSE 'missing_artifact' END AS reason FROM d GROUP BY source_name HAVING count(change) > 0 OR source_name = 'src1'",
        "a14_snippet": r"SELECT i::INTEGER AS line_number, line, i = 3 AS highlight FROM (SELECT unnest(string_split_regex(text, '\r\n|\n|\r')) AS line, generate_subscripts(string_split_regex(text, '\r\n|\n|\r'), 1) AS i FROM documents WHERE doc_id = 2) WHERE i BETWEEN 1 AND 5",
        "b52_service_names": "SELECT s_suppkey, 'order-' || s_nationkey AS of_env, 'order-service-' || s_nationkey || '-client' AS of_identifier, 'price-' || s_nationkey || '-base' AS of_address, 'external-service' AS of_nothing, 'my-lib-' || s_nationkey AS package, '@a/b' || s_nationkey AS root, s_nationkey % 2 = 0 AS truthy FROM supplier",
        "b70_sql_definitions": _FILES + f"SELECT source_name, 'sql_table' AS entity_type, 'sales.' || n AS full_name, 'sales' AS schema, n AS name, {n} FROM src WHERE k = 'C' GROUP BY source_name, src.n",
        "b71_sql_calls": _FILES + f"SELECT source_name, 'dbo.load_' || n AS to_name, 'stored_procedure' AS to_type, {n} FROM src WHERE k = 'N' GROUP BY source_name, src.n",
        "b72_sql_reads": _FILES + "SELECT source_name, t AS to_name, 'READS_SQL_OBJECT' AS edge_type, count(*) AS n FROM (SELECT source_name, 'dbo.' || n AS t FROM src WHERE k = 'A' UNION ALL SELECT source_name, 'dim.dates' FROM src WHERE k = 'A' UNION ALL SELECT source_name, n FROM src WHERE k = 'R') GROUP BY source_name, t",
        "b73_sql_writes": _FILES + "SELECT source_name, t AS to_name, o AS sql_operation, count(*) AS n FROM (SELECT source_name, 'stage.' || n AS t, 'insert' AS o FROM src WHERE k = 'R' UNION ALL SELECT source_name, n, 'delete' FROM src WHERE k = 'R') GROUP BY source_name, t, o",
        "b74_sql_references": _FILES + "SELECT source_name, 'dbo.keys' AS to_name, count(*) AS n FROM src WHERE k = 'C' GROUP BY source_name",
        "b76_sql_scan": _FILES + "SELECT e AS edge_type, CASE e WHEN 'REFERENCES_SQL_OBJECT' THEN 'schema' ELSE 'runtime' END AS dependency_scope, CASE e WHEN 'REFERENCES_SQL_OBJECT' THEN 'sql_schema_reference' ELSE 'sql_reference' END AS interaction_kind, count(*) AS n FROM (SELECT unnest(CASE k WHEN 'C' THEN ['REFERENCES_SQL_OBJECT'] WHEN 'A' THEN ['READS_SQL_OBJECT', 'READS_SQL_OBJECT'] WHEN 'N' THEN ['CALLS_SQL'] ELSE ['WRITES_SQL_OBJECT', 'WRITES_SQL_OBJECT', 'READS_SQL_OBJECT'] END) AS e FROM src) GROUP BY e",
        "b77_sql_provenance": "SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'historical' ELSE 'unknown' END AS schema_state, CASE WHEN l_orderkey % 3 = 0 THEN 'migration_file' ELSE 'sql_file' END AS kind, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL",
        "f01_snapshot": "SELECT source AS source_name, 'doc/' || doc_id AS path, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size_bytes FROM documents",
        "f02_snapshot_diff": _DIFF + "SELECT source_name, path, change FROM d WHERE change IS NOT NULL",
        "f04_snapshot_status": _DIFF + "SELECT source_name, CASE WHEN count(change) = 0 THEN 'unchanged' ELSE 'changed' END AS status, concat_ws(',', CASE WHEN count(*) FILTER (change = 'added') > 0 THEN 'files_added' END, CASE WHEN count(*) FILTER (change = 'modified') > 0 THEN 'files_modified' END, CASE WHEN count(*) FILTER (change = 'removed') > 0 THEN 'files_removed' END) AS reasons, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'removed') AS removed FROM d GROUP BY source_name",
    }

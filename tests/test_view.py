"""Resolution and the graph view: what repeated rows and empty results must not change."""

import duckdb
import pytest
from pyspark.sql import functions as F

from codeloom.functions import exprs
from codeloom.operators import resolve, traverse
from codeloom.plans import registry

ENTITY = "entity_type string, name string, source_name string, file_path string, line_number int, aliases array<string>, properties map<string,string>"
EDGE = (
    "edge_id string, from_entity_id string, from_name string, from_type string, to_name string, to_type string, to_entity_id string, edge_type string, resolved boolean, "
    "source_name string, file_path string, line_number int, identity_key string, confidence string, parser string, properties map<string,string>"
)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Two of the pages have one path, the same key modulo 1000 and one source, so that their edges have one id."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = {
        "nation": "SELECT i::INTEGER AS n_nationkey, 'NATION_' || i AS n_name, 0 AS n_regionkey FROM range(25) t(i)",
        "customer": "SELECT i AS c_custkey, 'Customer#' || i AS c_name, (i % 25)::INTEGER AS c_nationkey, 'M' || i % 3 AS c_mktsegment FROM range(40) t(i)",
        "supplier": "SELECT i AS s_suppkey, 'Supplier#' || i AS s_name, (i % 25)::INTEGER AS s_nationkey FROM range(12) t(i)",
        "part": "SELECT i AS p_partkey, 'part ' || i % 7 AS p_name, 'Brand#' || i % 2 AS p_brand, 'LARGE' AS p_type, (i % 9)::INTEGER AS p_size FROM range(30) t(i)",
        "orders": "SELECT i AS o_orderkey, i % 40 AS o_custkey FROM range(60) t(i)",
        "lineitem": "SELECT i % 60 AS l_orderkey, i % 30 AS l_partkey, i % 12 AS l_suppkey, (i % 7 + 1)::INTEGER AS l_linenumber, CASE i % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS l_returnflag FROM range(500) t(i)",
        "pages": "SELECT i * 500 AS page_id, 'http://h' || i || '.example/p' AS url, '' AS html FROM range(6) t(i)",
        "events": "SELECT i AS event_id, i % 30 AS user_id, CASE i % 2 WHEN 0 THEN 'view' ELSE 'error' END AS event_type FROM range(50) t(i)",
    }
    con = duckdb.connect()
    for name, sql in rows.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["c02_edge_upsert", "c13_merge_graphs", "c08_resolved_edges", "g11_interaction_groups", "g07_radius_summary"])
def test_repeated_edges_and_an_absent_root_agree_with_sql(spark, tables, name):
    folder, con = tables
    got = registry.queries()[name](spark, folder)
    want = con.sql(registry.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in got.columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_summary_of_no_items(spark):
    none = spark.createDataFrame([], "depth int, edge_type string, direction string, neighbor_type string")
    assert sorted(map(tuple, traverse.radius_summary(none).collect())) == [("items", "", 0), ("max_depth", "", 0)]


def test_resolution_keeps_each_edge_once_and_does_not_shuffle_edges(spark):
    rows = [("service", "s", "a", None, None, [], {})] * 3 + [("service", "t", "b", None, None, [], {})] * 2
    entities = spark.createDataFrame(rows, ENTITY).withColumn("entity_id", exprs.entity_id())
    ids = {r["name"]: r["entity_id"] for r in entities.collect()}
    edge = lambda i, name, target: (f"e{i}", "x", "x", "project", name, "service", target, "CALLS_SERVICE", target is not None, "z", None, i, None, "high", "p", {})
    _, out = resolve.resolve(entities, spark.createDataFrame([edge(1, "s", ids["s"]), edge(2, "T", None), edge(3, "gone", "0" * 24), edge(4, "none", None)], EDGE))
    got = {r["edge_id"]: r for r in out.collect()}
    assert out.count() == 4 and got["e2"]["to_entity_id"] == ids["t"]
    assert [got[f"e{i}"]["resolved"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    plan = out.where(F.col("resolved"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan

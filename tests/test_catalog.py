from codeloom.plans import more_queries


def test_catalogs_of_more_objects_than_the_row_budget_are_read_whole(spark, tmp_path):
    n = 70_000
    spark.range(1, n + 1).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    named = more_queries.queries()
    known = {k for k in range(1, n + 1) if k % 5 and k % 4 == 0}
    assert named["a20_catalog_objects"](spark, str(tmp_path)).count() == sum(1 for k in range(1, n + 1) if k % 5)
    # The key of object 1 refers to object 0, which does not exist.
    assert named["a21_catalog_foreign_keys"](spark, str(tmp_path)).count() == n - 1
    got = {r["kind"]: r["n"] for r in named["b83_foreign_key_edges"](spark, str(tmp_path)).collect()}
    keys = range(2, n + 1)
    assert got["resolved"] == sum(1 for k in keys if k in known and k // 2 in known)
    assert got["unresolved"] == sum(1 for k in keys if k in known and k // 2 not in known)
    assert got["issues"] == sum(1 for k in keys if k not in known)

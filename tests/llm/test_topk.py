import math

import numpy as np
import pytest

from codeloom.llm import topk
from pyspark.sql import functions as F


def brute(rows, k):
    vectors = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    out = []
    for q in sorted(i for i in vectors if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_equal_to_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(600)] + [(700 + i, [0.5] * 8) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    bad = spark.createDataFrame([(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [float("inf")] * 8), (904, None), (None, [1.0] * 8)], df.schema)
    got = topk.top_k(topk.scaled(df.union(bad)), F.col("id") % 100 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 10)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 0.5])], "vec_id long, embedding array<double>")
    got = topk.top_k(topk.scaled(df), F.col("id") % 100 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 5)]
    assert topk.top_k(topk.scaled(df.limit(0)), F.col("id") % 100 == 0).count() == 0


def test_scores_of_58_bits_short_and_empty_vectors_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-300_000_000, 300_000_000, 8) / 1024).tolist()) for i in range(300)]
    rows += [(300, rows[7][1]), (301, rows[7][1]), (302, [2.5, 1.25]), (303, [])]
    padded = [(i, v + [0.0] * (8 - len(v))) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("shard", F.lit(2))
    got = topk.top_k(topk.scaled(df), F.col("id") % 100 == 0).collect()
    assert max(abs(r["score"]) for r in got) > 1 << 56
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(padded, 10)
    twice = topk.top_k(topk.scaled(df.union(df)), F.col("id") % 100 == 0).where("query_id = 0").collect()
    assert len(twice) == 10 and all(r["vec_id"] != 0 for r in twice)


def test_scores_past_63_bits_are_an_error(spark):
    big = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="63 bits"):
        topk.top_k(topk.scaled(big), F.col("id") % 100 == 0).collect()
    assert topk.products(np.array([[1 << 40, 1]]), np.array([[1 << 22, 5]])).tolist() == [[(1 << 62) + 5]]
    assert topk.products(np.array([[1 << 60, -(1 << 60)]]), np.array([[8, 8]])).tolist() == [[0]]

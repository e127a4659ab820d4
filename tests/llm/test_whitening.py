import math

import numpy as np
import pytest

from codeloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, components=16):
    """Plain numpy: (vec_id, component) -> (n, deviation, |whitened|, explained)."""
    width = max(len(v) for _, v in rows)
    xs = [(i, tuple(math.floor(64 * c) + 1000000 for c in list(v) + [0.0] * (width - len(v)))) for i, v in rows]
    fit = np.array(sorted({x for _, x in xs}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array((n * fit - sums), dtype=object)
    cov = np.array((centred.T @ centred) / n**3, dtype=np.float64)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = {}
    for i, x in xs:
        z = n * np.array(x, dtype=object) - sums
        w = np.array(z, dtype=np.float64) / n @ u / np.sqrt(e)
        for k in range(len(e)):
            out[i, k + 1] = (n, int((z * z).sum()), abs(w[k]), e[k] / np.trace(cov))
    return out


def check(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    for r in got:
        n, deviation, white, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert abs(abs(r["whitened"]) - white) < 1e-7 * max(1, white)
        assert abs(r["explained"] - explained) <= 1e-9 * explained
        assert r["identity_error"] < 1e-6


@pytest.mark.parametrize("pairs_at_once", [4096, 7])
def test_equal_to_brute_force(spark, monkeypatch, pairs_at_once):
    monkeypatch.setattr(whitening, "PAIRS_AT_ONCE", pairs_at_once)
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(20, 20)) * np.linspace(0.2, 30, 20)
    rows = [(i, (rng.normal(size=20) @ spread).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [(2000, rows[7][1][:11])]
    bad = [(3000, None), (3001, [None] * 20), (3002, [float("nan")] + [0.0] * 19), (3003, [float("-inf")] + [0.0] * 19)]
    got = whitening.whitened(spark.createDataFrame(rows + bad, SCHEMA)).collect()
    check(got, brute(rows))


def test_signs_agree_between_rows_and_large_entries_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * [1e11, 1e9, 1e10]).tolist()) for i in range(50)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    check(got, brute(rows))
    white = np.zeros((50, 3))
    for r in got:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(white.T, bias=True) - np.eye(3)).max() < 1e-9


def test_components_without_variance_and_few_rows(spark):
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(4)], SCHEMA)
    got = whitening.whitened(flat).collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1} and len(got) == 12
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_repeated_ids_null_ids_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [3.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("a")).withColumn("x", F.lit(1)).withColumn("component", F.lit(2)).withColumn("n", F.lit(3))
    got = whitening.whitened(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == sorted([(i or 0, k, 3) for i, _ in rows for k in (1, 2)])


def test_too_large_entries_are_an_error(spark):
    with pytest.raises(Exception, match="62 bits"):
        whitening.whitened(spark.createDataFrame([(1, [1e300])], SCHEMA)).collect()

import math
import re

import pytest

from codeloom.llm import mixing, queries


def test_weights_reach_the_entropy(spark):
    counted = spark.createDataFrame([("a", 8000), ("b", 1000), ("c", 900), ("d", 100)], "source string, n long")
    rows = {r["source"]: r for r in mixing.weights(counted, entropy=0.9, max_repeats=100.0).collect()}
    w = [r["weight"] for r in rows.values()]
    assert math.isclose(sum(w), 1) and -sum(x * math.log(x) for x in w) / math.log(4) == pytest.approx(0.9, abs=1e-3)
    power = {s: math.log(r["weight"] / rows["a"]["weight"]) / math.log(r["share"] / rows["a"]["share"]) for s, r in rows.items() if s != "a"}
    assert max(power.values()) - min(power.values()) < 1e-6


def test_repetition_limit_beats_entropy(spark):
    counted = spark.createDataFrame([("a", 9900), ("b", 100)], "source string, n long")
    rows = {r["source"]: r for r in mixing.weights(counted, entropy=1.0, max_repeats=2.0).collect()}
    assert rows["b"]["weight"] / rows["b"]["share"] == pytest.approx(2.0, rel=1e-3)


def test_copies_against_brute_force(docs_of, sentence):
    texts = [sentence(i, 5 + i % 17) for i in range(400)]
    sources = ["hot" if i % 5 else f"s{i % 3}" for i in range(400)]
    docs = docs_of(texts, sources=sources)
    got = mixing.mix(docs, max_repeats=10.0, copies_col="copies").collect()
    counted = docs.select("source", mixing.tokens("text").alias("n"))
    plan = {r["source"]: r for r in mixing.weights(counted, max_repeats=10.0).collect()}
    assert plan["hot"]["weight"] < plan["hot"]["share"]
    order = {r["doc_id"]: r["p"] for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 53), {1 << 40}) as p").collect()}
    for source, p in plan.items():
        own = sorted((r for r in got if r["source"] == source), key=lambda r: order[r["doc_id"]])
        passes, rest = divmod(p["target"], p["total"])
        for r in own:
            n = len(r["text"].split())
            assert r["copies"] == passes + (1 if rest >= n else 0)
            rest = rest - n if rest >= n else -1
    mixed = mixing.mix(docs, max_repeats=10.0)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_nulls_single_source_and_empty_table(docs_of):
    docs = docs_of([None, "", "a b", "c d e"], sources=[None, "x", "x", "x"])
    assert sorted(r["doc_id"] for r in mixing.mix(docs).collect()) == [0, 1, 2, 3]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs_of(["a b", "c"], sources=[None, None])).count() == 2


def brute(rows, gain, budget_share, max_repeats):
    """(exponent, weights, {(id, text): copies}) of rows (id, text, source, place), by plain bisection and one pass over each source."""
    n = lambda t: len(re.findall(r"\S+", t or "", re.ASCII))
    total = {}
    for _, text, source, _ in rows:
        total[source] = total.get(source, 0) + n(text)
    total = {k: v for k, v in total.items() if v}
    whole = sum(total.values())
    budget = round(whole * budget_share)

    def weighed(a):
        w = {k: (v / whole) ** a for k, v in total.items()}
        return {k: v / sum(w.values()) for k, v in w.items()}

    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    repeats = lambda w: max(w[k] * budget / total[k] for k in w)
    target = entropy(weighed(1)) + gain * (math.log(len(total)) - entropy(weighed(1)))

    def last(holds):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(weighed(mid)) else (low, mid)
        return low

    a = last(lambda w: entropy(w) >= target)
    if repeats(weighed(a)) > max_repeats:
        a = last(lambda w: repeats(w) > max_repeats)
    w, copies = weighed(a), {}
    for source in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == source), key=lambda r: r[3])
        passes, rest = divmod(math.floor(w[source] * budget + 0.5), total[source]) if source in w else (0, 0)
        for i, text, _, _ in own:
            size = n(text)
            copies[i, text] = passes + (size <= rest) if size else 1
            rest = rest - size if size <= rest else -1
    return a, w, copies


PLACE = f"pmod(xxhash64(doc_id, 53), {1 << 40}) AS place"


def test_query_does_real_work_and_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"], r["place"]) for r in docs.selectExpr("doc_id", "text", "source", PLACE).collect()]
    a, w, copies = brute(rows, mixing.GAIN, queries.MIXED_SHARE, mixing.MAX_REPEATS)
    got = queries.op5_mixing(spark, folder).collect()
    text = {i: t for i, t, _, _ in rows}
    assert {(r["doc_id"], text[r["doc_id"]]): r["copies"] for r in got} == copies
    assert a < 0.9 and {0, 1, 2} <= set(copies.values())
    counted = docs.select("source", mixing.tokens("text").alias("n"))
    made = {r["source"]: r["weight"] for r in mixing.weights(counted).collect()}
    assert all(abs(made[k] - w[k]) < 1e-5 for k in w)
    # Every copy has a block, and every tenth of the blocks holds a source's weight, as far as documents of its size can.
    assert all(len(r["blocks"]) == r["copies"] and all(0 <= b < mixing.BLOCKS for b in r["blocks"]) for r in got)
    drawn = sum(r["copies"] * r["tokens"] for r in got)
    largest = max(w, key=w.get)
    for tenth in range(10):
        inside = [(r["source"], r["tokens"]) for r in got for b in r["blocks"] if b * 10 // mixing.BLOCKS == tenth]
        assert abs(sum(n for _, n in inside) / drawn - 0.1) < 0.06
        assert abs(sum(n for s, n in inside if s == largest) / sum(n for _, n in inside) - w[largest]) < 0.25


def test_equal_shares_stay_and_blocks_of_copies(docs_of):
    docs = docs_of(["a b c d"] * 40, sources=[f"s{i % 4}" for i in range(40)])
    kept = mixing.mix(docs, copies_col="copies", budget_share=0.9).collect()
    assert sum(r["copies"] for r in kept) == 36 and {r["copies"] for r in kept} == {0, 1}
    rows = mixing.mix(docs, budget=400, blocks_col="block").collect()
    assert len(rows) == 100 and {"block"} == set(rows[0].asDict()) - set(docs.columns)

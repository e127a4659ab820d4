from collections import Counter
from types import SimpleNamespace

from codeloom.operators import traverse
from codeloom.plans import oracle_text as o, registry

TYPES = traverse.profile_types("impact")


def brute(edges, root):
    depth, at = {root: 0}, [root]
    for level in (1, 2):
        at = sorted({f for f, t, kind, _ in edges if t in at and kind in TYPES and f not in depth})
        depth |= {f: level for f in at}
    return {k: d for k, d in depth.items() if d}


def test_dependents_in_every_source_are_reached(spark):
    root = o.ROOT_ID
    # a in the root's own source; b, c in others; d calls b from a third; e has an edge of no impact type; f is three steps away.
    source = {root: "NATION_15", "a": "NATION_15", "b": "NATION_1", "c": "NATION_2", "d": "NATION_3", "e": "NATION_4", "f": "NATION_5"}
    edges = [(f, t, kind, source[f]) for f, t, kind in (("a", root, "CALLS_SERVICE"), ("b", root, "CALLS_HTTP"), ("c", "a", "CALLS_SERVICE"), ("d", "b", "CALLS_SERVICE"), ("e", root, "MENTIONS"), ("f", "d", "CALLS_SERVICE"), (root, "b", "CALLS_SERVICE"))]
    rows = [(f"e{i}", kind, f, f, t, t, s, "service") for i, (f, t, kind, s) in enumerate(edges)]
    view = SimpleNamespace(
        edges=spark.createDataFrame(rows, "edge_id string, edge_type string, from_entity_id string, from_name string, to_entity_id string, to_name string, source_name string, to_type string"),
        entities=spark.createDataFrame([(k, "service", k, s) for k, s in source.items()], "entity_id string, entity_type string, name string, source_name string"),
    )
    want = brute(edges, root)
    assert {r["next_id"]: r["depth"] for r in registry.g01_all(view).collect()} == want == {"a": 1, "b": 1, "c": 2, "d": 2}
    assert {r["source"]: r["count"] for r in registry.g05_all(view).collect()} == Counter(source[k] for k in want)
    assert {r["next_id"]: r["depth"] for r in registry.g01(view).collect()} == want

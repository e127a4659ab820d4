"""Traversal: all trails up to a depth, and breadth-first blast radius with each node once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.operators.store import LIST_LIMIT, depth_of, direction_of, limit_of
from codeloom.sources.tables import SMALL, SMALL_IDS, cut, small
from codeloom.vocabulary import IMPACT_PROFILES

_EDGE = ("edge_id", "edge_type", "from_entity_id", "from_name", "to_entity_id", "to_name", "source_name")


def profile_types(profile: str, edge_type: str | None = None) -> list[str] | None:
    """G02. The edge types of a profile, or the one given; None for all."""
    if profile not in IMPACT_PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    return [edge_type] if edge_type else IMPACT_PROFILES[profile]


def _allowed(edges: DataFrame, types: Sequence[str] | None) -> DataFrame:
    return edges.where(F.col("edge_type").isin(list(types))) if types is not None else edges


def _ends(direction: str) -> tuple[str, str]:
    return ("from_entity_id", "to_entity_id") if direction == "out" else ("to_entity_id", "from_entity_id")


def _step(at: DataFrame, steps: DataFrame, direction: str, level: int) -> DataFrame:
    """The trails of at(root, _at, path), one edge longer."""
    near, far = _ends(direction)
    met = at.join(steps, at["_at"] == steps[near]).where(~F.array_contains("path", F.col("edge_id")))
    return met.select("root", F.lit(level).alias("depth"), *_EDGE, F.col(far).alias("neighbor_id"), F.array_append("path", F.col("edge_id")).alias("path"))


def _meeting(at: DataFrame, steps: DataFrame, near: str) -> tuple[DataFrame, DataFrame]:
    """Trails at(_at) and steps for their join at steps' near: few trails are broadcast; else both without nodes of one side alone, as far as few ids say so."""
    if at.limit(SMALL + 1).count() <= SMALL:
        return F.broadcast(at), steps
    ends, starts = cut(at.select(F.col("_at").alias("_id")).distinct()), cut(steps.where(F.col(near).isNotNull()).select(F.col(near).alias("_id")).distinct())
    both = cut(ends.join(starts, "_id", "left_semi"))
    sides = []
    n = both.count()
    for rows, key, ids in ((at, "_at", ends), (steps, near, starts)):
        if n <= SMALL_IDS:
            rows = rows.join(F.broadcast(both), F.col(key) == F.col("_id"), "left_semi")
        elif ids.count() - n <= SMALL_IDS:
            rows = rows.join(F.broadcast(ids.join(both, "_id", "left_anti")), F.col(key) == F.col("_id"), "left_anti")
        sides.append(rows)
    return sides[0], sides[1]


def _steps(edges: DataFrame, direction: str, edge_types: Sequence[str] | None) -> DataFrame:
    return _allowed(edges.where("resolved"), edge_types).where(F.col(_ends(direction)[1]).isNotNull()).select(*_EDGE)


def trails(edges: DataFrame, start: DataFrame, direction: str, depth: int = 1, edge_types: Sequence[str] | None = None) -> DataFrame:
    """E06, E07. All trails of up to depth edges from start(root): no edge twice, nodes may repeat.

    Returns root, depth, the edge that touches the neighbour, neighbor_id, and path,
    the edge ids from the root on.

    A level that starts from few trails sends them to the edges; otherwise trails and edges are
    first cut to the nodes at which both meet.
    """
    depth_of(depth)
    steps = _steps(edges, direction, edge_types)
    at = cut(start.select("root")).select("root", F.col("root").alias("_at"), F.array().cast("array<string>").alias("path"))
    found = None
    for level in range(1, depth + 1):
        level_rows = _step(*_meeting(at, steps, _ends(direction)[0]), direction, level)
        found = level_rows if found is None else found.unionByName(level_rows)
        at = level_rows.select("root", F.col("neighbor_id").alias("_at"), "path")
    return found


def neighbors(edges: DataFrame, entity_id: str, direction: str = "both", depth: int = 1, edge_types: Sequence[str] | None = None, limit: int = 50) -> DataFrame:
    """E08. Trails of one entity: outgoing ones first, then incoming ones, the shorter before the longer, cut at limit.

    Each level is cut to what is left of the limit, in the final order, and stored; the next starts from it only if it was not
    cut. So no level starts from more trails than the limit, whatever the degrees of the nodes.
    """
    direction_of(direction)
    depth_of(depth)
    start = edges.sparkSession.createDataFrame([(entity_id,)], "root string")
    out, left = None, limit_of(limit, LIST_LIMIT)
    for rank, d in enumerate(("out", "in")):
        if direction not in (d, "both"):
            continue
        steps = _steps(edges, d, edge_types)
        name = "to_name" if d == "out" else "from_name"
        at = start.select("root", F.col("root").alias("_at"), F.array().cast("array<string>").alias("path"))
        for level in range(1, depth + 1):
            if left <= 0 and out is not None:
                break
            # A level starts from limit trails at most: they go to every task, and the edges stay where they are.
            rows = _step(F.broadcast(at), steps, d, level).orderBy("edge_type", name, "edge_id", F.array_join("path", ",")).limit(left)
            rows = cut(rows.select(F.lit(rank).alias("_rank"), F.lit(d).alias("direction"), "*"))
            left -= rows.count()
            out = rows if out is None else out.unionByName(rows)
            at = rows.select("root", F.col("neighbor_id").alias("_at"), "path")
    shown = F.when(F.col("direction") == "out", F.col("to_name")).otherwise(F.col("from_name"))
    return out.orderBy("_rank", "depth", "edge_type", shown, "edge_id", F.array_join("path", ",")).drop("_rank")


def _order() -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")) for c in ("edge_type", "source_name", "to_name", "edge_id")]


def blast_radius(edges: DataFrame, entities: DataFrame, root: str, direction: str = "in", depth: int = 2, limit: int | None = 200, edge_types: Sequence[str] | None = None) -> DataFrame:
    """G01, G03, G04. Nodes that the root reaches, each once, by its first discovery.

    A level's nodes are discovered in the order of their parents, then edge type,
    source, target name and edge id. Unresolved outgoing targets are nodes
    ``unresolved:<edge id>`` and are not expanded. Each direction is cut at limit in
    the order of discovery, then both together in the order of the report. Each level
    is stored; a small frontier goes to the edges, which then stay where they are, and a
    larger one meets them in a shuffle. With limit None nothing is cut, and rank is the
    list of what a node's discovery is ordered by.
    """
    direction_of(direction)
    depth_of(depth)
    if limit is not None:
        limit_of(limit, LIST_LIMIT)
    steps = _allowed(edges, edge_types)
    found = None
    for d in ("out", "in"):
        if direction not in (d, "both"):
            continue
        near, far = ("from_entity_id", F.coalesce("to_entity_id", F.concat(F.lit("unresolved:"), "edge_id"))) if d == "out" else ("to_entity_id", F.col("from_entity_id"))
        hops = steps.where(F.col(near).isNotNull()).select(*_EDGE, F.col("to_type"), F.col(near).alias("_near"), far.alias("next_id")).where("next_id is not null")
        frontier = edges.sparkSession.createDataFrame([(root, 0 if limit is not None else [], [root], [])], f"node string, rank {'int' if limit is not None else 'array<string>'}, nodes array<string>, path array<string>")
        seen, level_rows, items = frontier.select(F.col("node").alias("next_id")), None, None
        for level in range(1, depth + 1):
            met = small(frontier).join(hops, F.col("node") == F.col("_near")).join(small(seen), "next_id", "left_anti")
            first = F.row_number().over(Window.partitionBy("next_id").orderBy("rank", *_order()))
            once = met.withColumn("_n", first).where("_n = 1").drop("_n")
            # The limit bounds what is ordered here: rows enter one task already cut to it.
            if limit is None:
                level_rows = once.withColumn("_rank", F.concat("rank", F.array(*_order())))
            else:
                place = F.row_number().over(Window.orderBy("rank", *_order()))
                level_rows = once.orderBy("rank", *_order()).limit(limit).withColumn("_rank", (place + F.lit(level * 10_000_000)).cast("int"))
            level_rows = level_rows.select(
                F.lit(d).alias("direction"), F.lit(level).alias("depth"), F.col("_rank").alias("rank"), *_EDGE, "to_type", "next_id",
                (F.array_append("nodes", F.col("next_id")) if d == "out" else F.array_prepend("nodes", F.col("next_id"))).alias("nodes"),
                (F.array_append("path", F.col("edge_id")) if d == "out" else F.array_prepend("path", F.col("edge_id"))).alias("path"),
            )
            level_rows = cut(level_rows)
            items = level_rows if items is None else items.unionByName(level_rows)
            frontier = level_rows.select(F.col("next_id").alias("node"), "rank", "nodes", "path")
            frontier = cut(frontier.join(entities.select(F.col("entity_id").alias("node")).join(small(frontier.select("node")), "node", "left_semi"), "node", "left_semi"))
            seen = seen.union(level_rows.select("next_id"))
        items = items if limit is None else items.orderBy("rank").limit(limit)
        found = items if found is None else found.unionByName(items)
    node = entities.select(F.col("entity_id").alias("next_id"), F.col("entity_type").alias("neighbor_type"), F.col("name").alias("neighbor_name"), F.col("source_name").alias("neighbor_source"))
    found = found.join(node.join(small(found.select("next_id")), "next_id", "left_semi"), "next_id", "left").withColumns({
        "neighbor_type": F.coalesce("neighbor_type", "to_type"), "neighbor_name": F.coalesce("neighbor_name", "to_name"),
    })
    order = ["depth", "direction", "edge_type", F.coalesce("neighbor_source", "next_id"), "rank"]
    return found.orderBy(*order) if limit is None else found.orderBy(*order).limit(limit)


def affected_sources(items: DataFrame, examples: int = 5) -> DataFrame:
    """G05. Sources of the nodes: count, least depth, types, first examples."""
    rows = items.withColumn("source", F.coalesce("neighbor_source", F.when(F.col("neighbor_source").isNull() & F.col("next_id").startswith("unresolved:"), F.col("source_name")), F.lit("unknown")))
    return _grouped(rows, ["source"], examples).orderBy("min_depth", F.desc("count"), "source")


def path_groups(items: DataFrame, examples: int = 5) -> DataFrame:
    """G06. The same by source and edge type."""
    rows = items.withColumn("source", F.coalesce("neighbor_source", "source_name", F.lit("unknown")))
    return _grouped(rows, ["source", "edge_type"], examples).orderBy("min_depth", F.desc("count"), "source", "edge_type")


def _grouped(rows: DataFrame, keys: list[str], examples: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("depth", "direction", "rank")
    ranked = rows.withColumn("_n", F.row_number().over(w))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.min("depth").alias("min_depth"), F.array_join(F.array_sort(F.collect_set("edge_type")), ",").alias("edge_types"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("neighbor_type", F.lit("unknown")))), ",").alias("entity_types"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= examples, F.struct("_n", "neighbor_name")))), lambda x: x["neighbor_name"]), ",").alias("examples"),
    )


def radius_summary(items: DataFrame) -> DataFrame:
    """G07. metric, key, count: items, deepest level, and counts by edge type, direction and node type; items and level are 0 where there are none.

    Items are counted once, by all three; the metrics are sums of these few counts.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    metrics = ["edge_type", "direction", "entity_type"]
    tallies = items.groupBy(known("edge_type").alias("edge_type"), known("direction").alias("direction"), known("neighbor_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))
    one = lambda metric, key, count: F.struct(F.lit(metric).alias("metric"), key.alias("key"), count.alias("count"))
    tallies = tallies.agg(F.collect_list(F.struct(*metrics, "n", "deepest")).alias("t"))  # a row at most for each three types, also where there are no items
    total = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    deepest = F.coalesce(F.array_max(F.transform("t", lambda x: x["deepest"])), F.lit(0)).cast("long")
    whole = F.array(one("items", F.lit(""), total(F.col("t"))), one("max_depth", F.lit(""), deepest))
    of = [F.transform(F.array_distinct(F.transform("t", lambda x: x[m])), lambda k: one(m, k, total(F.filter("t", lambda x: x[m] == k)))) for m in metrics]
    return tallies.select(F.explode(F.concat(whole, *of)).alias("m")).select("m.*")


def radius_report(edges: DataFrame, entities: DataFrame, root: str, direction: str = "in", depth: int = 2, limit: int = 200, profile: str = "impact", edge_type: str | None = None) -> dict[str, DataFrame]:
    """G08. Items, affected sources, path groups and summary; an unknown root raises."""
    if not entities.where(F.col("entity_id") == root).limit(1).count():
        raise ValueError(f"unknown entity: {root}")
    items = blast_radius(edges, entities, root, direction, depth, limit, profile_types(profile, edge_type))
    return {"items": items, "sources": affected_sources(items), "groups": path_groups(items), "summary": radius_summary(items)}

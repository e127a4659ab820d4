"""Nested payloads: entities, edges, neighbours and paths as structs, and as JSON without null fields at any level.

A path of edge ids becomes nodes, edges and steps in one pass: its edges are laid out with
their places, meet their records and the nodes at both ends once, and are gathered again in
order. Paths are as long as a traversal's depth, so what is gathered is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions.exprs import string_value
from codeloom.sources.tables import cut, small

ENTITY = ["entity_id", "entity_type", "name", "source_name", "file_path", "line_number", "aliases", "properties"]
EDGE = [
    "edge_id", "edge_type", "from_entity_id", "from_name", "from_type", "to_entity_id", "to_name", "to_type", "resolved", "source_name", "file_path", "line_number", "confidence", "parser",
    "properties",
]
EXAMPLES = 5


def _struct(df: DataFrame, fields: Sequence[str], prefix: str = "") -> Column:
    """The fields that df has, blank strings as null."""
    kinds = dict(df.dtypes)
    return F.struct(*[(string_value(prefix + c) if kinds[prefix + c] == "string" else F.col(prefix + c)).alias(c) for c in fields if prefix + c in kinds])


def as_json(value: str | Column) -> Column:
    """A struct as JSON, without null fields at any level; null values of maps go too."""
    return F.to_json(value, {"ignoreNullFields": "true"})


def entities(df: DataFrame) -> DataFrame:
    """(entity_id, payload): entities as structs, with no aliases and no properties rather than null ones."""
    names, values = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    filled = df.withColumns({"aliases": F.coalesce("aliases", names), "properties": F.map_filter(F.coalesce("properties", values), lambda k, v: v.isNotNull())})
    return filled.select("entity_id", _struct(filled, ENTITY).alias("payload"))


def edges(df: DataFrame) -> DataFrame:
    """(edge_id, payload): edges as structs."""
    return df.select("edge_id", _struct(df, EDGE).alias("payload"))


def _node(kind: DataFrame, known: str, target: Column | None) -> Column:
    """A node's struct: the entity, or what an unresolved edge points at."""
    shape = kind.schema["payload"].dataType
    names = [f"{f.name} {f.dataType.simpleString()}" for f in shape.fields]
    more = "target_id string, target_type string, resolved boolean"
    entity = F.struct(*[F.col(f"{known}.{f.name}").alias(f.name) for f in shape.fields], *[F.lit(None).cast(t).alias(n) for n, t in (("target_id", "string"), ("target_type", "string"), ("resolved", "boolean"))])
    if target is None:
        return entity
    return F.when(F.col(known).isNotNull(), entity).otherwise(target.cast(f"struct<{', '.join(f'{x.split()[0]}:{x.split(None, 1)[1]}' for x in [*names, *more.split(', ')])}>"))


def paths(items: DataFrame, edge_rows: DataFrame, entity_rows: DataFrame, key: Sequence[str], path_col: str = "path") -> DataFrame:
    """items with path_payload: node_ids, edge_ids, nodes, edges and steps of a path of edge ids, each of which begins where the one before ends.

    key: columns that tell the items apart. A path without edges, or with an unknown one, has a null payload.
    """
    known = entities(entity_rows)
    fields = known.schema["payload"].dataType.names
    record = edge_rows.select("edge_id", _struct(edge_rows, EDGE).alias("edge"), "from_entity_id", "to_entity_id", "to_name", "to_type", "source_name")
    placed = items.select(*key, F.size(path_col).alias("_n"), F.posexplode(path_col).alias("_i", "edge_id"))
    met = placed.join(record, "edge_id")
    for end in ("from", "to"):
        met = met.join(known.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("payload").alias(f"_{end}")), f"{end}_entity_id", "left")
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in known.schema["payload"].dataType.fields}
    given = {"name": string_value("to_name"), "source_name": string_value("source_name")}
    target = F.struct(*[given.get(f, nothing[f]).alias(f) for f in fields], F.concat(F.lit("unresolved:"), "edge_id").alias("target_id"), string_value("to_type").alias("target_type"), F.lit(False).alias("resolved"))
    step = F.struct((F.col("_i") + 1).alias("index"), _node(known, "_from", None).alias("from"), F.col("edge"), _node(known, "_to", target).alias("to"))
    gathered = met.groupBy(*key, "_n").agg(F.array_sort(F.collect_list(F.struct(F.col("_i"), step.alias("step"))), lambda x, y: x["_i"] - y["_i"]).alias("s")).where(F.size("s") == F.col("_n"))
    gathered = gathered.withColumn("steps", F.transform("s", lambda x: x["step"]))
    nodes = F.concat(F.slice(F.transform("steps", lambda x: x["from"]), 1, 1), F.transform("steps", lambda x: x["to"]))
    made = gathered.withColumn("nodes", nodes).select(*key, F.struct(
        F.transform("nodes", lambda n: F.coalesce(n["entity_id"], n["target_id"])).alias("node_ids"), F.transform("steps", lambda x: x["edge"]["edge_id"]).alias("edge_ids"),
        "nodes", F.transform("steps", lambda x: x["edge"]).alias("edges"), "steps",
    ).alias("path_payload"))
    return items.join(made, list(key), "left")


def _items(found: DataFrame, edge_rows: DataFrame, entity_rows: DataFrame) -> DataFrame:
    """Rows of a traversal (direction, depth, edge_id, neighbour's id in _id, path along the edges) as payloads: direction, depth, edge, neighbor, path.

    Records and nodes are first cut to those that the rows name, and stored: few ids go to the graph, which stays where it is.
    """
    found = cut(found)
    ids = cut(found.select(F.explode(F.concat(F.coalesce("path", F.array().cast("array<string>")), F.array("edge_id"))).alias("edge_id")).distinct())
    edge_rows = cut(edge_rows.join(small(ids), "edge_id", "left_semi"))
    ends = cut(edge_rows.select(F.explode(F.array("from_entity_id", "to_entity_id")).alias("entity_id")).where("entity_id is not null").distinct())
    entity_rows = cut(entity_rows.join(small(ends), "entity_id", "left_semi"))
    keyed = paths(found.withColumn("_key", F.concat_ws("|", "direction", F.array_join("path", ","), "_id")), edge_rows, entity_rows, ["_key"])
    met = keyed.join(edges(edge_rows).withColumnRenamed("payload", "_edge"), "edge_id")
    last = F.when(F.col("direction") == "out", F.element_at("path_payload.nodes", -1)).otherwise(F.element_at("path_payload.nodes", 1))
    return met.withColumn("payload", F.struct("direction", "depth", F.col("_edge").alias("edge"), last.alias("neighbor"), F.col("path_payload").alias("path")))


def neighbors(found: DataFrame, edge_rows: DataFrame, entity_rows: DataFrame) -> DataFrame:
    """E08, E25. (direction, depth, edge_id, neighbor_id, payload) of traverse.neighbors()' rows; incoming paths run from the neighbour to the root, as their edges do."""
    along = F.when(F.col("direction") == "in", F.reverse("path")).otherwise(F.col("path"))
    rows = found.withColumns({"path": along, "_id": F.col("neighbor_id")}).select("direction", "depth", "edge_id", "neighbor_id", "_id", "path")
    return _items(rows, edge_rows, entity_rows).select("direction", "depth", "edge_id", "neighbor_id", "payload")


def radius(found: DataFrame, edge_rows: DataFrame, entity_rows: DataFrame, limit: int | None = None) -> DataFrame:
    """G04. (next_id, payload, truncated) of traverse.blast_radius()' items; truncated where they reach the limit, so that more may exist."""
    rows = found.withColumn("_id", F.col("next_id")).select("direction", "depth", "edge_id", "next_id", "_id", "path", "rank")
    out = _items(rows, edge_rows, entity_rows)
    full = F.count(F.lit(1)).over(Window.partitionBy()) >= limit if limit is not None else F.lit(False)
    return out.select("next_id", "rank", "payload", full.alias("truncated"))


def groups(items: DataFrame) -> DataFrame:
    """G43. Items of neighbors() or radius() by direction, edge type, source and neighbour's type: count, least depth and the first examples, as JSON in order of depth and edge."""
    p = F.col("payload")
    rows = items.select(
        p["direction"].alias("direction"), p["edge"]["edge_type"].alias("edge_type"), F.coalesce(p["neighbor"]["source_name"], p["edge"]["source_name"], F.lit("unknown")).alias("source_name"),
        F.coalesce(p["neighbor"]["entity_type"], p["neighbor"]["target_type"], F.lit("unknown")).alias("neighbor_type"), p["depth"].alias("depth"), p["edge"]["edge_id"].alias("edge_id"), as_json("payload").alias("example"),
    )
    keys = ["direction", "edge_type", "source_name", "neighbor_type"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("depth", "edge_id", "example"))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= EXAMPLES, F.struct("_n", "example")))), lambda x: x["example"])
    return rows.withColumn("_n", place).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min("depth").alias("min_depth"), first.alias("examples"))

"""Scanners of application code: HTTP calls, routes, imports, symbols and scopes, messages, caches, storage, jobs.

One pass over the files gives the places that tokens.py finds: calls with their literal
arguments, decorators, imports and declarations. The scanners are rules over this table; windows run
within one file, whose length the scan bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions.exprs import package_root, route_path, service_from_env, service_from_url, strip
from codeloom.operators.sqltext import lines
from codeloom.operators.tokens import Tokens

# What the scanners look for.
HTTP_VERBS = ["get", "post", "put", "patch", "delete", "options", "head"]
CALL_SKIP_NAMES = ["catch", "describe", "fetch", "for", "function", "if", "it", "require", "return", "switch", "while"]
CACHE_READS = ["exists", "get", "get_many", "getstring", "hget", "mget"]
CACHE_WRITES = ["del", "delete", "hset", "mset", "set", "set_many", "setex", "setstring"]
CACHE_PLAIN = ["get", "set", "delete"]
CACHE_HINTS = ["cache", "redis", "memcache", "memorycache", "distributedcache"]
PUBLISHES = ["basic_publish", "emit", "produce", "produceasync", "publish", "publishasync", "send", "send_message", "sendasync", "sendmessage", "sendtoqueue"]
CONSUMES = ["basic_consume", "consume", "receive", "receive_message", "receiveasync", "receivemessage", "subscribe", "subscribeasync"]
MESSAGE_HINTS = ["bus", "channel", "consumer", "event", "kafka", "message", "producer", "publisher", "queue", "rabbit", "sns", "sqs", "subscriber", "topic"]
QUEUE_METHODS = ["basic_consume", "receive_message", "receivemessage", "send_message", "sendmessage", "sendtoqueue"]
GENERIC_METHODS = ["publish", "publishasync", "sendasync", "subscribe", "subscribeasync"]
MESSAGE_KEYS = ["topic", "topics", "queue", "queue_name", "queueName", "QueueUrl", "routing_key", "routingKey"]
STORAGE_READS = ["createreadstream", "download", "downloadasync", "downloadtofile", "get_object", "getobject", "openread", "readallbytes", "readalltext", "readfile", "readfilesync"]
STORAGE_WRITES = ["appendfile", "createwritestream", "openwrite", "put_object", "putobject", "upload", "uploadasync", "uploadfromfile", "writeallbytes", "writealltext", "writefile", "writefilesync"]
STORAGE_BROAD = ["appendfile", "download", "readfile", "upload", "writefile"]
STORAGE_HINTS = ["blob", "bucket", "container", "directory", "file", "fs", "ftp", "path", "s3", "share", "storage"]
BUCKET_KEYS, CONTAINER_KEYS, OBJECT_KEYS = ["bucket", "bucketname"], ["container", "containername", "share"], ["key", "blobname", "path", "filepath"]

ROUTERS = ["app", "fastify", "router", "server"]
ENV_ENDINGS = "(URL|URI|ENDPOINT|HOST)$"

PLACE = (
    "source_name string, rel_path string, line_number int, form string, name string, receiver string, generic string, first string, second string, "
    "`values` array<struct<key:string,value:string>>, within array<struct<key:string,value:string>>, of_line string, exported boolean, place int"
)
_ARROW = pa.schema([
    *[(c, pa.string()) for c in ("source_name", "rel_path")], ("line_number", pa.int32()), *[(c, pa.string()) for c in ("form", "name", "receiver", "generic", "first", "second")],
    *[(c, pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))) for c in ("values", "within")], ("of_line", pa.string()), ("exported", pa.bool_()), ("place", pa.int32()),
])


def places(files: DataFrame) -> DataFrame:
    """A row a call, decorator, import, function or class of files(source_name, rel_path, content); place counts them within a file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, path, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [
                    {"source_name": source, "rel_path": path, "line_number": p.line, **p._asdict(), **{c: [{"key": k, "value": v} for k, v in getattr(p, c)] for c in ("values", "within")}, "place": i}
                    for i, p in enumerate(Tokens(text or "").places())
                ]
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    if "form" in files.columns:
        return files
    return files.select("source_name", "rel_path", "content").mapInArrow(run, PLACE)


def _calls(files: DataFrame) -> DataFrame:
    return places(files).where("form = 'call'")


def _some(c: str) -> Column:
    return F.nullif(c, F.lit(""))


_WHERE = ["source_name", "rel_path", "line_number"]


def http_calls(files: DataFrame) -> DataFrame:
    """B50. fetch and axios calls with a literal target: of a service that an environment variable names, else of a route METHOD /path."""
    verb, receiver = F.lower("name"), F.lower(F.element_at(F.split("receiver", r"\."), -1))
    fetch, axios = (verb == "fetch"), (receiver == "axios") & verb.isin(HTTP_VERBS)
    given = F.lower(F.try_element_at(F.filter("within", lambda p: F.lower(p["key"]) == "method"), F.lit(1))["value"])
    method = F.upper(F.when(axios, verb).when(given.isin(HTTP_VERBS), given).otherwise("get"))
    rows = _calls(files).where((fetch | axios) & F.col("first").isNotNull()).select(*_WHERE, method.alias("method"), F.col("first").alias("raw"))
    named = F.regexp_extract("raw", r"\b(?:process|import\.meta)\.env\.([A-Z][A-Z0-9_]*)", 1)
    rows = rows.withColumn("env", F.when(named.rlike(ENV_ENDINGS), named))
    service = F.col("env").isNotNull()
    return rows.select(
        *_WHERE, "method", F.col("raw").alias("raw_target"), F.when(service, "CALLS_SERVICE").otherwise("CALLS_HTTP").alias("edge_type"),
        F.when(service, "service").otherwise("api_route").alias("to_type"), F.when(service, service_from_env("env")).otherwise(F.concat("method", F.lit(" "), route_path("raw"))).alias("to_name"),
        service_from_url("raw").alias("host_service"),
    )


def declarations(files: DataFrame) -> DataFrame:
    """Functions and classes that files declare, in their order (at)."""
    rows = places(files).where(F.col("form").isin("function", "class"))
    return rows.select(*_WHERE, F.col("form").alias("entity_type"), "name", "exported", F.col("place").alias("at"))


def symbols(files: DataFrame) -> DataFrame:
    """B30, B56. Functions and classes that files declare, and whether they are exported."""
    return declarations(files).drop("at")


def _functions(files: DataFrame) -> DataFrame:
    return declarations(files).where("entity_type = 'function'")


def routes(files: DataFrame) -> DataFrame:
    """B53. Routes that express, fastify or Nest declare; the handler where it is a function of the same file."""
    verb, receiver = F.lower("name"), F.lower(F.element_at(F.split("receiver", r"\."), -1))
    plain = (F.col("form") == "call") & receiver.isin(ROUTERS) & F.col("first").isNotNull()
    nest = (F.col("form") == "decorator") & (F.col("receiver") == "")
    rows = places(files).where(verb.isin(HTTP_VERBS) & (plain | nest)).withColumn("handler", F.when(plain, F.col("second")))
    known = _functions(files).select("source_name", "rel_path", F.col("name").alias("handler"), F.lit(True).alias("known")).distinct()
    rows = rows.join(known, ["source_name", "rel_path", "handler"], "left")
    route = F.concat(F.upper("name"), F.lit(" "), route_path(F.coalesce("first", F.lit("/"))))
    return rows.select(*_WHERE, route.alias("route"), F.when(F.col("known"), F.col("handler")).alias("handler"))


def imports(files: DataFrame) -> DataFrame:
    """B55. Imported modules (relative ones whole) and packages (their roots)."""
    required = (F.col("form") == "call") & (F.col("name") == "require") & (F.col("receiver") == "")
    rows = places(files).where(((F.col("form") == "import") | required) & F.col("first").isNotNull()).withColumn("raw", F.col("first"))
    relative = F.col("raw").startswith(".")
    return rows.select(*_WHERE, F.col("raw").alias("raw_target"), F.when(relative, F.col("raw")).otherwise(package_root("raw")).alias("to_name"), F.when(relative, "relative").otherwise("package").alias("import_kind"))


def jobs(files: DataFrame) -> DataFrame:
    """B60. Scheduled jobs, named ``handler @ schedule``."""
    last = F.element_at(F.split("receiver", r"\."), -1)
    rows = _calls(files).where((F.col("name") == "schedule") & (last == "cron") & F.col("first").isNotNull() & F.col("second").isNotNull())
    return rows.select(*_WHERE, F.concat("second", F.lit(" @ "), "first").alias("name"), F.col("first").alias("schedule"), F.col("second").alias("handler"))


def scopes(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """B61. source_name, rel_path, line_number, line, function: the function that each line stands in.

    A function begins with the line that declares it, and ends after the first line at which no
    brace opened since then is left open (its own line, where that opens none). Between two
    declarations the lines count from the first; so a line belongs to the function as long as the
    balance after every line before it was positive. found: the files' places, if they are at hand.
    """
    last = _functions(files if found is None else found).groupBy("source_name", "rel_path", "line_number").agg(F.max_by("name", "at").alias("declared"))
    rows = lines(files).join(last, ["source_name", "rel_path", "line_number"], "left")
    of_file = Window.partitionBy("source_name", "rel_path").orderBy("line_number")
    rows = rows.withColumn("segment", F.count("declared").over(of_file))
    of_segment = Window.partitionBy("source_name", "rel_path", "segment").orderBy("line_number")
    count = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
    rows = rows.withColumn("open", F.sum(count("{") - count("}")).over(of_segment))
    least = F.min("open").over(of_segment.rowsBetween(Window.unboundedPreceding, -1))
    function = F.when((F.col("segment") > 0) & (F.coalesce(least, F.lit(1)) > 0), F.first("declared").over(of_segment))
    return rows.select("source_name", "rel_path", "line_number", "line", function.alias("function"))


def symbol_calls(files: DataFrame, scoped: DataFrame | None = None) -> DataFrame:
    """B31. Calls of functions of the same file, from the function in which they stand, a name once a line; a function's calls of itself are left out."""
    called = within_functions(_calls(files).select(*_WHERE, F.col("name").alias("to_name")).distinct(), files, scoped)
    called = called.where(~F.col("to_name").isin(CALL_SKIP_NAMES) & (F.col("to_name") != F.col("function")))
    known = _functions(files).select("source_name", "rel_path", F.col("name").alias("to_name")).distinct()
    return called.join(known, ["source_name", "rel_path", "to_name"], "left_semi").select(*_WHERE, "function", "to_name")


def within_functions(facts: DataFrame, files: DataFrame, scoped: DataFrame | None = None) -> DataFrame:
    """B30. The facts (source_name, rel_path, line_number) of lines that stand in a function, with it; scoped: scopes() of the files, if at hand."""
    inside = (scopes(files) if scoped is None else scoped).where("function is not null").select(*_WHERE, "function")
    return facts.join(inside, _WHERE)


def _operations(files: DataFrame, methods: list[str]) -> DataFrame:
    rows = _calls(files).withColumns({"method": F.lower("name"), "receiver": F.lower("receiver")})
    return rows.where(F.col("method").isin(methods))


def _hinted(hints: list[str]) -> Column:
    return F.col("receiver").rlike("|".join(hints))


def _given(keys: list[str]) -> Column:
    """The literals given to one of the keys, in any case."""
    wanted = [k.lower() for k in keys]
    return F.filter("values", lambda p: F.lower(p["key"]).isin(wanted))


def cache_calls(files: DataFrame) -> DataFrame:
    """B57. Reads and writes of cache keys; get, set and delete need a receiver that looks like a cache. The key is the line's first argument that is a literal."""
    rows = _operations(files, CACHE_READS + CACHE_WRITES).where(_hinted(CACHE_HINTS) | ~F.col("method").isin(CACHE_PLAIN))
    kind = F.when(F.col("method").isin(CACHE_READS), "READS_CACHE_KEY").otherwise("WRITES_CACHE_KEY")
    return rows.withColumn("to_name", strip("of_line")).where("to_name is not null").select("source_name", "rel_path", "line_number", kind.alias("edge_type"), "to_name")


def message_target(x: Column) -> Column:
    """A target's name: the last segment of a URL's path, what follows the scheme of another address, or the text itself."""
    raw = strip(x)
    path = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
    return F.coalesce(_some(F.regexp_extract(path, r"([^/]+)/*$", 1)), raw)


def message_calls(files: DataFrame) -> DataFrame:
    """B58. Published and consumed messages; targets are a generic type, values given to keys, or else the line's first argument."""
    method, generic = F.col("method"), F.col("generic") != ""
    rows = _operations(files, PUBLISHES + CONSUMES).where(_hinted(MESSAGE_HINTS) | method.isin(QUEUE_METHODS) | method.isin(GENERIC_METHODS) & generic)
    kind = F.when(method.isin(PUBLISHES), "PUBLISHES_MESSAGE").otherwise("CONSUMES_MESSAGE")
    of_key = lambda p: F.struct(F.when(F.lower(p["key"]).rlike("queue|routing"), "message_queue").otherwise("message_topic").alias("type"), p["value"].alias("value"))
    keyed = F.transform(_given(MESSAGE_KEYS), of_key)
    contract = F.filter(F.array(F.struct(F.lit("message_contract").alias("type"), F.col("generic").alias("value"))), lambda t: t["value"] != "")
    named = F.concat(contract, keyed)
    first = F.array(F.struct(F.when(method.isin(QUEUE_METHODS), "message_queue").otherwise("message_topic").alias("type"), F.col("of_line").alias("value")))
    target = F.explode(F.when(F.size(named) > 0, named).otherwise(F.filter(first, lambda t: t["value"].isNotNull()))).alias("t")
    found = rows.select("source_name", "rel_path", "line_number", kind.alias("edge_type"), target)
    return found.select("source_name", "rel_path", "line_number", "edge_type", F.col("t.type").alias("to_type"), message_target(F.col("t.value")).alias("to_name")).distinct()


def storage_target(x: Column) -> Column:
    """host/path of a URL, or the text with plain slashes."""
    raw = strip(x)
    host = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    path = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/*([^?#]*?)/*(?:[?#].*)?$", 1)
    return F.when(host != "", F.concat_ws("/", host, _some(path))).otherwise(F.replace(raw, F.lit("\\"), F.lit("/")))


def storage_calls(files: DataFrame) -> DataFrame:
    """B59. Reads and writes of stored objects; broad method names need a receiver that looks like storage. Targets are bucket or container and key, else the line's first argument."""
    rows = _operations(files, STORAGE_READS + STORAGE_WRITES).where(_hinted(STORAGE_HINTS) | ~F.col("method").isin(STORAGE_BROAD))
    kind = F.when(F.col("method").isin(STORAGE_READS), "READS_STORAGE_OBJECT").otherwise("WRITES_STORAGE_OBJECT")
    given = F.transform(_given(BUCKET_KEYS + CONTAINER_KEYS + OBJECT_KEYS), lambda p: F.struct(F.lower(p["key"]).alias("key"), p["value"].alias("value")))
    rows = rows.withColumn("given", given)
    # Of a key given twice the last value counts.
    last = lambda key: F.try_element_at(F.filter("given", lambda p: p["key"] == key), F.lit(-1))["value"]
    bucket, container, item = (reduce(F.coalesce, [last(k) for k in keys]) for keys in (BUCKET_KEYS, CONTAINER_KEYS, OBJECT_KEYS))
    holder = F.coalesce(bucket, container)
    named = F.when(holder.isNotNull() & item.isNotNull(), F.concat(holder, F.lit("/"), item)).otherwise(F.coalesce(item, bucket, container))
    target = storage_target(F.when(F.size("given") > 0, named).otherwise(F.col("of_line")))
    return rows.select("source_name", "rel_path", "line_number", kind.alias("edge_type"), target.alias("to_name")).where("to_name is not null")

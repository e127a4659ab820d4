from codeloom.operators import scanners
from codeloom.operators.tokens import Tokens

FILES = "source_name string, rel_path string, content string"


def of(spark, text, path="a.ts"):
    return spark.createDataFrame([("s", path, text)], FILES)


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_what_is_no_call_declaration_or_import_is_none(spark):
    text = """const s = "fetch('/in/a/string') function no() {}";
const importance = 1; obj.import("x"); my_fetch("/not");
axios.get(url); axios.unknown("/x"); other.get("/y"); fetch(path);
const value = call((x) => x); let y = "a" => 1;
xrouter.get("/r", h); export const z = 3; classy("c"); export default 5;
"""
    files = of(spark, text)
    assert scanners.http_calls(files).collect() == [] and scanners.routes(files).collect() == []
    assert scanners.symbols(files).collect() == [] and scanners.imports(files).collect() == []


def test_typed_nested_and_spread_declarations_and_calls(spark):
    text = """import {
  a, b
} from "@scope/pkg/deep";
import "side-effect"; import type { T } from './types';
export { c } from "lodash/fp"; const d = require('fs');
export default async function load<T>(x: (y: number) => void): Promise<T> {
  return fetch(
    `/orders/${x}`, { headers: { a: "b" }, method: 'delete' });
}
export const pick = async ({ a, b = [1, 2] }: P, c?: Q): Promise<R> => { helper(a); };
const helper = <T,>(x: T) => x; let one = v => v; var not = (1 + 2);
export abstract class Shop<T> extends Base {}
@Get("/items/:id") list() {} @Post() add() {}
app.post ("/a/{b}", pick); router?.put("/q", auth, pick);
cron.schedule("* * * * *", helper);
"""
    files = of(spark, text)
    assert got(scanners.symbols(files), "name", "entity_type", "exported") == [("Shop", "class", True), ("helper", "function", False), ("load", "function", True), ("one", "function", False), ("pick", "function", True)]
    assert got(scanners.imports(files), "to_name", "import_kind") == [("./types", "relative"), ("@scope/pkg", "package"), ("fs", "package"), ("lodash", "package"), ("side-effect", "package")]
    assert got(scanners.http_calls(files), "method", "to_name", "line_number") == [("DELETE", "DELETE /orders/:param", 7)]
    assert got(scanners.routes(files), "route", "handler") == [("GET /items/:param", None), ("POST /", None), ("POST /a/:param", "pick"), ("PUT /q", None)]
    assert got(scanners.jobs(files), "name") == [("helper @ * * * * *",)]
    assert got(scanners.symbol_calls(files), "function", "to_name") == [("pick", "helper")]


def test_targets_over_several_lines_and_of_one_line(spark):
    text = """sqs.sendMessage({
  QueueUrl: "https://q.eu/1/jobs"
});
bus.Publish<Orders.Made>(m); queue.basic_consume(queue="work"); plain.send("no");
s3.getObject({ Bucket: "b", Key: "k" }); blob.upload("x");
fs.readFile("a\\b"); cache.get("k1"); settings.get("no"); redis.mget("m");
"""
    files = of(spark, text)
    assert got(scanners.message_calls(files), "edge_type", "to_type", "to_name") == [("CONSUMES_MESSAGE", "message_queue", "work"), ("PUBLISHES_MESSAGE", "message_contract", "Orders.Made"), ("PUBLISHES_MESSAGE", "message_queue", "jobs"), ("PUBLISHES_MESSAGE", "message_queue", "work")]
    assert ("READS_STORAGE_OBJECT", "b/k") in got(scanners.storage_calls(files), "edge_type", "to_name")
    assert {("READS_CACHE_KEY", 6)} == set(got(scanners.cache_calls(files), "edge_type", "line_number"))


def test_odd_texts():
    for text in ("", "((((", "'unclosed", "`never\nends", "a" * 100_000, "f(" * 50_000, "{" * 50_000 + "}" * 50_000, "import " * 2000, "const x: " * 2000, "é(\"ü\")"):
        list(Tokens(text).places())

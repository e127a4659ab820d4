"""Queries of the scanners and catalogs over generated source files, with their SQL oracles.

Each supplier has a few files, whose text varies with its key k and nation n; the
oracles say directly what each file holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.operators import catalog, facts, incremental, postgres, scaffold, scanners

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_X = "WITH x AS (SELECT 'NATION_' || s_nationkey AS s, s_suppkey::VARCHAR AS k, s_nationkey::VARCHAR AS n, s_suppkey AS i FROM supplier) "


def query(name: str, oracle: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f
    return register


def each(columns: Sequence[str], rows: Sequence[tuple], where: Sequence[str] | None = None) -> str:
    """SQL that counts, a source, the given rows of every supplier (only of those that a row's condition names)."""
    parts = []
    for i, row in enumerate(rows):
        condition = f" WHERE {where[i]}" if where and where[i] else ""
        parts.append(f"SELECT s AS source_name, {', '.join(f'{v} AS {c}' for v, c in zip(row, columns))} FROM x{condition}")
    return _X + f"SELECT *, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("source_name"), F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("n"), F.col("s_suppkey").alias("i"))


def files(spark: SparkSession, sf_dir: str, path: str, text: str) -> DataFrame:
    """A file a supplier; {k} and {n} in path and text stand for its key and nation."""
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{k}"), F.col("k")), F.lit("{n}"), F.col("n"))
    return suppliers(spark, sf_dir).select("source_name", fill(path).alias("rel_path"), fill(text).alias("content"), "i")


def tally(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


FACT = ["edge_type", "from_type", "to_type", "to_name"]


def scanned(name: str, path: str, text: str, rows: Sequence[tuple]):
    """Registers a query that counts the facts of a parser-based scanner on a file a supplier."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tally(facts.scan(files(spark, sf_dir, path, text)).where("issue is null"), "source_name", *FACT)
    query(name, each(FACT, [tuple(v if "||" in v or v in ("k", "n") else f"'{v}'" for v in row) for row in rows]))(run)


scanned("b11_pnpm_workspace", "w{k}/pnpm-workspace.yaml", "packages:\n  - apps/*\n  - libs/{n}\n", [("DECLARES_WORKSPACE", "file", "workspace", "'w' || k")])
scanned(
    "b12_pyproject", "p{k}/pyproject.toml",
    '[project]\nname = "App_{k}"\ndependencies = ["Lib_{n}>=1", "req[x] ; python_version<\'4\'"]\n[project.optional-dependencies]\ndev = ["pytest"]\n[tool.poetry.dependencies]\npython = "^3"\nclick = "8"\n',
    [("DECLARES_PACKAGE", "project", "package", "'app-' || k"), ("DEPENDS_ON_PACKAGE", "package", "package", "'lib-' || n"), *[("DEPENDS_ON_PACKAGE", "package", "package", p) for p in ("req", "pytest", "click")]],
)
scanned(
    "b15_dotnet_project", "d{k}/App{k}.csproj",
    '<Project><PropertyGroup><AssemblyName>Core{n}</AssemblyName></PropertyGroup><ItemGroup><PackageReference Include="Json" Version="1"/><PackageReference Update="Log{n}"/><ProjectReference Include="..\\lib\\Lib{n}.csproj"/></ItemGroup></Project>',
    [("DECLARES_PACKAGE", "project", "package", "'Core' || n"), ("DEPENDS_ON_PACKAGE", "package", "package", "Json"), ("DEPENDS_ON_PACKAGE", "package", "package", "'Log' || n"), ("DEPENDS_ON_PROJECT", "project", "project", "'Lib' || n")],
)
scanned("b16_packages_config", "d{k}/packages.config", '<packages><package id="EF{n}" version="6"/><package version="1"/></packages>', [("DEPENDS_ON_PACKAGE", "package", "package", "'EF' || n")])
scanned(
    "b17_framework_config", "d{k}/Web.config",
    '<configuration><appSettings><add key="OrdersUrl" value="http://orders{n}.internal/x"/><add key="Plain" value="1"/></appSettings><connectionStrings><add name="Main" connectionString="secret"/></connectionStrings></configuration>',
    [("DECLARES_CONFIG_FILE", "file", "config_file", "'d' || k || '/Web.config'"), *[("DECLARES_CONFIG", "config_file", "config_value", c) for c in ("OrdersUrl", "Plain", "Main")], ("CONFIGURES_SERVICE", "config_value", "service", "'orders' || n")],
)
scanned("b18_build_config", "d{k}/Build{n}.props", '<Project><ItemGroup><PackageVersion Include="Pin{n}" Version="3"/></ItemGroup></Project>', [("DECLARES_BUILD_CONFIG", "file", "build_config", "'Build' || n"), ("DEPENDS_ON_PACKAGE", "package", "package", "'Pin' || n")])
scanned(
    "b19_solution", "d{k}/All.sln", 'Project("{G}") = "Web{n}", "web\\Web.csproj", "{H}"\nEndProject\nProject("{F}") = "docs", "docs", "{I}"\n',
    [("DECLARES_SOLUTION", "file", "solution", "All"), ("CONTAINS_PROJECT", "solution", "project", "'Web' || n")],
)
scanned(
    "b24_ingress", "k{k}/ingress.yaml",
    "apiVersion: networking.k8s.io/v1\nkind: Ingress\nmetadata:\n  name: in-{k}\nspec:\n  rules:\n    - host: h\n      http:\n        paths:\n          - path: /n{n}\n            backend:\n              service:\n                name: svc-{n}\n",
    [("DECLARES_INGRESS", "file", "ingress", "'in-' || k"), ("EXPOSES_ROUTE", "ingress", "api_route", "'ANY /n' || n"), ("ROUTES_TO_SERVICE", "api_route", "service", "'svc-' || n")],
)
scanned(
    "b22_container_env", "k{k}/deploy.yaml",
    "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: dep\nspec:\n  template:\n    spec:\n      containers:\n        - name: c{n}\n          image: i\n          env:\n            - name: PRICE_API_URL\n            - name: MODE\n              value: fast\n            - name: STOCK\n              value: http://stock-{n}.ns/x\n",
    [("DECLARES_DEPLOYMENT", "file", "deployment", "dep"), ("RUNS_CONTAINER", "deployment", "container", "'dep/c' || n"), *[("DECLARES_CONFIG", "container", "config_value", c) for c in ("PRICE_API_URL", "MODE", "STOCK")], ("CONFIGURES_SERVICE", "config_value", "service", "price"), ("CONFIGURES_SERVICE", "config_value", "service", "'stock-' || n")],
)
scanned(
    "b36_python_calls", "p{k}/w.py",
    "def run():\n    bus.publish('made-{n}')\n    sqs.send_message(QueueUrl='https://q.eu/1/jobs-{n}')\n    open('/tmp/{n}', 'w')\n    s3.get_object(Bucket='b', Key='{k}')\n    redis.get('c{n}')\n    model.get('no')\n    other.send('no')\n",
    [
        ("DECLARES_SYMBOL", "module", "function", "run"), ("PUBLISHES_MESSAGE", "function", "message_topic", "'made-' || n"), ("PUBLISHES_MESSAGE", "function", "message_queue", "'jobs-' || n"),
        ("WRITES_STORAGE_OBJECT", "function", "storage_location", "'/tmp/' || n"), ("READS_STORAGE_OBJECT", "function", "storage_location", "'b/' || k"), ("READS_CACHE_KEY", "function", "cache_key", "'c' || n"),
    ],
)
scanned(
    "b34_python_routes", "p{k}/api.py", "@app.route('/o/{n}', methods=['GET', 'POST'])\ndef orders():\n    return requests.get('/items')\n@app.scheduled('0 * * * *')\ndef tick():\n    orders()\n",
    [
        *[("DECLARES_SYMBOL", "module", "function", f) for f in ("orders", "tick")], ("HANDLES_ROUTE", "api_route", "function", "orders"), ("HANDLES_ROUTE", "api_route", "function", "orders"),
        ("CALLS_HTTP", "function", "api_route", "GET /items"), ("RUNS_JOB", "scheduled_job", "function", "tick"), ("CALLS_SYMBOL", "function", "function", "orders"),
    ],
)
scanned(
    "b37_csharp", "c{k}/Orders.cs",
    '[Route("api/[controller]")]\npublic class OrdersController : Controller {\n  [HttpGet("{n}")]\n  public IActionResult List(int a) {\n    client.GetAsync("http://stock{n}.x/y");\n    client.PostAsync("/local");\n  }\n}\napp.MapPost("/min/{n}", x => x);\n',
    [
        ("DECLARES_SYMBOL", "file", "class", "OrdersController"), ("DECLARES_SYMBOL", "file", "function", "OrdersController.List"), ("HANDLES_ROUTE", "api_route", "function", "OrdersController.List"),
        *[("CALLS_SERVICE", near, "service", "'stock' || n") for near in ("file", "function")], *[("CALLS_HTTP", near, "api_route", "POST /local") for near in ("file", "function")],
        ("DECLARES_ROUTE", "file", "api_route", "'POST /min/' || n"), ("DECLARES_ROUTE", "file", "api_route", "'GET /api/Orders/' || n"),
    ],
)
scanned(
    "b38_csharp_members", "c{k}/Deep.cs",
    'namespace Shop.N{n};\npublic record struct Point(int X);\ninternal interface IStore { Task Save(int a); }\n[ApiController, Route("v{n}/[controller]/[action]")]\npublic partial class Things\n  : Base<int>, IStore where T : class\n{\n  private readonly string text = "} public void No() {";\n'
    '  public Things(int a) { Save(a); }\n  public int Size { get; set; }\n  [HttpHead]\n  [Authorize("x")]\n  public async Task<List<int>> Find<T>(\n    string q)\n    where T : class\n  {\n    var s = $"{Save(1)}";\n    this.Save(2); other.Save(3); new Things(1).Save(4);\n    await client.DeleteAsync($@"/a/{{q}}/b");\n  }\n'
    '  // [HttpPut("no")]\n  public Task Save(int a) => Task.Run(() => Find("x"));\n  void Hidden() { client.GetAsync("/hidden"); }\n}\nclass After { }\n',
    [
        *[("DECLARES_SYMBOL", "file", kind, f"'Shop.N' || n || '.{name}'") for kind, name in (("class", "Point"), ("interface", "IStore"), ("class", "Things"), ("class", "After"), ("function", "Things.Find"), ("function", "Things.Save"))],
        ("DECLARES_ROUTE", "file", "api_route", "'HEAD /v' || n || '/Things/Find'"), ("HANDLES_ROUTE", "api_route", "function", "'Shop.N' || n || '.Things.Find'"),
        *[("CALLS_SYMBOL", "function", "function", name) for name in ("Things.Save", "Things.Find")], *[("CALLS_HTTP", near, "api_route", "DELETE /b") for near in ("file", "function")], ("CALLS_HTTP", "file", "api_route", "GET /hidden"),
    ],
)
scanned(
    "b40_visual_basic", "v{k}/M.vb", 'Public Class Shop\n  Public Sub Load(x)\n    url = ConfigurationManager.AppSettings("Order_Api_Url")\n    cmd.CommandText = "SELECT * FROM dbo.T{n}"\n    cmd.CommandText = "dbo.Proc{n}"\n  End Sub\nEnd Class\n',
    [
        ("DECLARES_SYMBOL", "file", "class", "Shop"), ("DECLARES_SYMBOL", "file", "function", "Shop.Load"), *[("CALLS_SERVICE", near, "service", "order-api") for near in ("file", "function")],
        *[("CALLS_SQL", near, "stored_procedure", "'dbo.Proc' || n") for near in ("file", "function")],
    ],
)
scanned(
    "b40_visual_basic_contracts", "v{k}/Stock{n}.asmx.vb",
    'Namespace Legacy.N{n}\nPublic Module Stock \' Class No\n  <WebMethod(Description:="a, b"), _\n   Obsolete> _\n  Public Shared Function Count(id As Integer) As Integer\n    Dim c = New SqlCommand("EXEC [dbo].[Count{n}] @id") \' Me.Other()\n    WebRequest.Create("http://api-{n}.x/y")\n    web.DownloadString("/feed/{n}?q=1")\n    Return Other(Me.Count(1)) + Nothing.Other()\n  End Function\n'
    '  <OperationContract> Private Sub Other()\n    Exit Sub\n  End Sub\n  <Obsolete()>\n  Sub Plain()\n  End Sub\nEnd Module\nEnd Namespace\n',
    [
        *[("DECLARES_SYMBOL", "file", kind, f"'Legacy.N' || n || '.{name}'") for kind, name in (("module", "Stock"), ("function", "Stock.Count"), ("function", "Stock.Other"), ("function", "Stock.Plain"))],
        ("DECLARES_ROUTE", "file", "api_route", "'POST /v' || k || '/Stock' || n || '.asmx/Count'"), ("DECLARES_ROUTE", "file", "api_route", "'POST /v' || k || '/Stock' || n || '.asmx.svc/Other'"),
        *[("HANDLES_ROUTE", "api_route", "function", f"'Legacy.N' || n || '.Stock.{name}'") for name in ("Count", "Other")],
        *[(edge, near, kind, to) for edge, kind, to in (("CALLS_SQL", "stored_procedure", "'dbo.Count' || n"), ("CALLS_SERVICE", "service", "'api-' || n"), ("CALLS_HTTP", "api_route", "GET /feed/:param")) for near in ("file", "function")],
        ("CALLS_SYMBOL", "function", "function", "Stock.Other"),
    ],
)
scanned("b41_legacy_endpoint", "v{k}/Svc{n}.asmx", "<%@ WebService %>", [("DECLARES_ROUTE", "file", "api_route", "'POST /v' || k || '/Svc' || n || '.asmx'")])

SCRIPT = """import x from "pkg";
export function load{n}(a) {
  fetch ("/orders/{n}", {method: "put"});
  helper(); load{n}(); if (a) {
    redis.get("k{n}"); cfg.get("no");
  }
}
axios.get(url); axios.options('/free/{n}');
function helper() { sqs.sendMessage({QueueUrl: "https://sqs.eu/1/jobs-{n}"}); }
helper();
fs.readFileSync("a/{n}"); s3.putObject({Bucket: "bk", Key: "k/{n}"});
app.options("/o", helper); app.head("/h", some.thing);
bus.Publish<Made{n}>(m);
"""


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, "s{k}/a.ts", SCRIPT)


@query("b50_http_calls", each(["method", "edge_type", "to_name"], [("'PUT'", "'CALLS_HTTP'", "'PUT /orders/:param'"), ("'OPTIONS'", "'CALLS_HTTP'", "'OPTIONS /free/:param'")]))
def b50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(scanners.http_calls(scripts(spark, sf_dir)), "source_name", "method", "edge_type", "to_name")


@query("b53_route_handlers", each(["route", "handler"], [("'OPTIONS /o'", "'helper'"), ("'HEAD /h'", "NULL::VARCHAR")]))
def b53(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(scanners.routes(scripts(spark, sf_dir)), "source_name", "route", "handler")


@query("b31_symbol_calls", each(["function", "to_name"], [("'load' || n", "'helper'")]))
def b31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(scanners.symbol_calls(scripts(spark, sf_dir)), "source_name", "function", "to_name")


@query("b61_function_scopes", _X + "SELECT s AS source_name, f AS function, sum(c)::BIGINT AS n FROM (SELECT s, unnest(['load' || n, 'helper']) AS f, unnest([6, 1]) AS c FROM x) GROUP BY ALL")
def b61(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(scanners.scopes(scripts(spark, sf_dir)).where("function is not null"), "source_name", "function")


@query("b30_interactions_of_functions", each(["function", "edge_type", "to_name"], [("'load' || n", "'CALLS_HTTP'", "'PUT /orders/:param'"), ("'load' || n", "'READS_CACHE_KEY'", "'k' || n"), ("'helper'", "'PUBLISHES_MESSAGE'", "'jobs-' || n")]))
def b30(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = scripts(spark, sf_dir)
    keep = lambda df: df.select("source_name", "rel_path", "line_number", "edge_type", "to_name")
    found = keep(scanners.http_calls(code)).unionByName(keep(scanners.cache_calls(code))).unionByName(keep(scanners.message_calls(code)))
    return tally(scanners.within_functions(found, code), "source_name", "function", "edge_type", "to_name")


@query("b58_message_targets", each(["edge_type", "to_type", "to_name"], [("'PUBLISHES_MESSAGE'", "'message_queue'", "'jobs-' || n"), ("'PUBLISHES_MESSAGE'", "'message_contract'", "'Made' || n")]))
def b58(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(scanners.message_calls(scripts(spark, sf_dir)), "source_name", "edge_type", "to_type", "to_name")


@query("b59_storage_targets", each(["edge_type", "to_name"], [("'READS_STORAGE_OBJECT'", "'bk/k/' || n"), ("'WRITES_STORAGE_OBJECT'", "'bk/k/' || n")]))
def b59(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(scanners.storage_calls(scripts(spark, sf_dir)), "source_name", "edge_type", "to_name")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package a supplier, in every second one a nested package, and a script below both."""
    parts = [files(spark, sf_dir, "s{k}/package.json", "{}"), files(spark, sf_dir, "s{k}/deep/package.json", "{}").where("i % 2 = 0"), files(spark, sf_dir, "s{k}/deep/src/a.ts", "x")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("i")


def projects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = tree(spark, sf_dir)
    named = found.where("rel_path like '%/deep/package.json'").select("source_name", "rel_path", F.concat(F.lit("in-"), F.regexp_extract("rel_path", "^s([0-9]+)", 1)).alias("name"))
    return found, scaffold.projects(found, named)


@query("a04_projects", _X + "SELECT s AS source_name, 's' || k AS folder, 's' || k AS name, 's' || k || '/package.json' AS manifest FROM x UNION ALL SELECT s, 's' || k || '/deep', 'in-' || k, 's' || k || '/deep/package.json' FROM x WHERE i % 2 = 0")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects(spark, sf_dir)[1]


@query("b03_owning_projects", _X + """, f AS (SELECT s, k, i, unnest(['/package.json', '/deep/src/a.ts']) AS p FROM x UNION ALL SELECT s, k, i, '/deep/package.json' FROM x WHERE i % 2 = 0)
SELECT s AS source_name, 's' || k || p AS rel_path, CASE WHEN i % 2 = 0 AND p <> '/package.json' THEN 'in-' || k ELSE 's' || k END AS project FROM f""")
def b03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.owning_projects(*projects(spark, sf_dir))


@query("b02_containment", _X + """, f AS (SELECT s, i, unnest([1, 2]) FROM x UNION ALL SELECT s, i, 3 FROM x WHERE i % 2 = 0)
SELECT s AS source_name, 'CONTAINS_PROJECT' AS edge_type, 'repository' AS from_type, count(*) AS n FROM (SELECT s FROM x UNION ALL SELECT s FROM x WHERE i % 2 = 0) GROUP BY s
UNION ALL SELECT s, 'CONTAINS_FILE', t, count(*) FROM f, (VALUES ('repository'), ('project')) AS v(t) GROUP BY s, t""")
def b02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(scaffold.containment(*projects(spark, sf_dir)), "source_name", "edge_type", "from_type")


# Catalogs made of the part table: objects as in a20; every part of a third has a trigger, and refers to the part of half its key.

def _catalog(spark: SparkSession, sf_dir: str):
    objects, schemas = catalog.fixture(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    triggers = part.where("k % 3 = 0").select((F.col("k") + 10_000_000).alias("object_id"), F.concat(F.lit("trg_"), F.col("k").cast("string")).alias("name"), F.col("k").alias("parent_id"), (F.col("k") % 2 == 0).alias("is_disabled"))
    events = part.where("k % 6 <> 0").select((F.col("k") + 10_000_000).alias("object_id"), F.explode(F.array(F.lit("Update"), F.lit("insert"))).alias("event_name"))
    depends = part.select(F.col("k").alias("referencing_id"), F.when(F.col("k") % 7 != 0, F.expr("k div 2")).alias("referenced_id"), F.when(F.col("k") % 14 == 0, "ext").alias("referenced_schema_name"), F.concat(F.lit("far_"), F.col("k").cast("string")).alias("referenced_entity_name"))
    return objects, schemas, triggers, events, depends


_OBJ = "'schema_' || ({0} % 3)"
_KIND = "CASE {0} % 4 WHEN 0 THEN 'U' WHEN 1 THEN 'V' WHEN 2 THEN 'P' ELSE 'FN' END"


@query("a22_trigger_rows", f"SELECT {_OBJ.format('p_partkey')} AS schema_name, 'trg_' || p_partkey AS trigger_name, 'obj_' || p_partkey AS table_name, CASE WHEN p_partkey % 6 <> 0 THEN 'INSERT,UPDATE' ELSE '' END AS events, p_partkey % 2 = 0 AS is_disabled FROM part WHERE p_partkey % 3 = 0")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, schemas, triggers, events, _ = _catalog(spark, sf_dir)
    return catalog.sqlserver_triggers(catalog.sqlserver_trigger_rows(triggers, objects, schemas, events)).drop("table_schema_name")


@query("a23_dependencies", f"""SELECT {_OBJ.format('p.p_partkey')} AS from_schema_name, 'obj_' || p.p_partkey AS from_object_name, {_KIND.format('p.p_partkey')} AS from_object_type,
  CASE WHEN q.p_partkey IS NOT NULL THEN {_OBJ.format('q.p_partkey')} WHEN p.p_partkey % 14 = 0 THEN 'ext' ELSE {_OBJ.format('p.p_partkey')} END AS to_schema_name, CASE WHEN q.p_partkey IS NOT NULL THEN 'obj_' || q.p_partkey ELSE 'far_' || p.p_partkey END AS to_object_name,
  CASE WHEN q.p_partkey IS NOT NULL THEN {_KIND.format('q.p_partkey')} END AS to_object_type, 'module_reference' AS dependency_type FROM part p LEFT JOIN part q ON p.p_partkey % 7 <> 0 AND p.p_partkey // 2 = q.p_partkey""")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, schemas, _, _, depends = _catalog(spark, sf_dir)
    return catalog.sqlserver_dependencies(catalog.sqlserver_dependency_rows(depends, objects, schemas)).drop("dependency_name")


def _postgres(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("r", "p", "v", "m", "i")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    routine = F.element_at(F.array(*[F.lit(x) for x in ("p", "f", "a")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    names = F.element_at(F.array(*[F.lit(x) for x in ("public", "pg_catalog", "shop")]), (F.col("id") + 1).cast("int"))
    classes = part.select(F.col("p_partkey").alias("oid"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") % 3).alias("namespace"), kind.alias("relkind"), routine.alias("prokind"))
    return classes, spark.range(3).select(F.col("id").alias("oid"), names.alias("nspname"))


_NSP = "CASE p_partkey % 3 WHEN 0 THEN 'public' ELSE 'shop' END AS schema_name, 'c' || p_partkey AS object_name"


@query("a24_postgres_relations", f"SELECT {_NSP}, CASE p_partkey % 5 WHEN 2 THEN 'view' WHEN 3 THEN 'materialized_view' ELSE 'table' END AS object_type FROM part WHERE p_partkey % 5 < 4 AND p_partkey % 3 <> 1")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.postgres_objects(*_postgres(spark, sf_dir), limit=None)


@query("a25_postgres_routines", f"SELECT {_NSP}, CASE p_partkey % 3 WHEN 0 THEN 'procedure' ELSE 'function' END AS object_type FROM part WHERE p_partkey % 3 = 0")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.postgres_objects(*_postgres(spark, sf_dir), limit=None, kinds=catalog.POSTGRES_ROUTINES, kind_col="prokind")


def _scanned_catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    objects, schemas, triggers, events, depends = _catalog(spark, sf_dir)
    _, _, keys = catalog.fixture_keys(spark, sf_dir)
    triggered = catalog.sqlserver_triggers(catalog.sqlserver_trigger_rows(triggers, objects, schemas, events))
    depending = catalog.sqlserver_dependencies(catalog.sqlserver_dependency_rows(depends, objects, schemas))
    return catalog.scan_catalog("db", "sqlserver", catalog.sqlserver_objects(objects, schemas, None), catalog.foreign_keys(objects, schemas, keys, None), triggered, depending)


_PARTS = "WITH p AS (SELECT p_partkey AS k, p_partkey // 2 AS h, EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = part.p_partkey // 2) AS far, p_partkey % 5 <> 0 AS known FROM part) "


@query("b80_catalog_entities", f"SELECT CASE p_partkey % 4 WHEN 0 THEN 'sql_table' WHEN 1 THEN 'sql_view' WHEN 2 THEN 'stored_procedure' ELSE 'sql_function' END AS entity_type, {_OBJ.format('p_partkey')} || '.obj_' || p_partkey AS full_name, NULL::VARCHAR AS trigger_events FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'sql_trigger', {_OBJ.format('p_partkey')} || '.trg_' || p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN 'INSERT,UPDATE' ELSE '' END FROM part WHERE p_partkey % 3 = 0")
def b80(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _, _ = _scanned_catalog(spark, sf_dir)
    return known.select("entity_type", F.col("properties")["full_name"].alias("full_name"), F.col("properties")["trigger_events"].alias("trigger_events"))


@query("b82_catalog_index", f"SELECT kind, name AS key, 1::BIGINT AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'sql_table' WHEN 1 THEN 'sql_view' WHEN 2 THEN 'stored_procedure' ELSE 'sql_function' END AS kind, unnest(['obj_' || p_partkey, {_OBJ.format('p_partkey')} || '.obj_' || p_partkey]) AS name FROM part WHERE p_partkey % 5 <> 0)")
def b82(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, schemas = catalog.fixture(spark, sf_dir)
    return catalog.index(catalog.object_entities(catalog.sqlserver_objects(objects, schemas, None), "db", "sqlserver")).where("kind is not null").select("kind", "key", "n")


@query("b83_catalog_edges", _PARTS + """SELECT edge_type, resolved, count(*) AS n FROM (
  SELECT 'TRIGGERS_ON_SQL_OBJECT' AS edge_type, known AND k % 4 = 0 AS resolved FROM p WHERE k % 3 = 0
  UNION ALL SELECT 'REFERENCES_SQL_OBJECT', h % 5 <> 0 AND h % 4 = 0 FROM p WHERE far AND known AND k % 4 = 0
  UNION ALL SELECT 'REFERENCES_SQL_OBJECT', k % 7 <> 0 AND far AND h % 5 <> 0 FROM p WHERE known) GROUP BY ALL""")
def b83(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(_scanned_catalog(spark, sf_dir)[1], "edge_type", "resolved")


@query("b83_catalog_issues", _PARTS + "SELECT message, count(*) AS n FROM (SELECT 'foreign key of an unknown object: schema_' || (k % 3) || '.obj_' || k AS message FROM p WHERE far AND NOT (known AND k % 4 = 0) UNION ALL SELECT 'dependency of an unknown object: schema_' || (k % 3) || '.obj_' || k FROM p WHERE NOT known) GROUP BY ALL")
def b83_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(_scanned_catalog(spark, sf_dir)[2], "message")


@query("b84_graph_types", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'sql_table' WHEN 1 THEN 'sql_view' WHEN 2 THEN 'stored_procedure' ELSE 'sql_function' END AS kind FROM part")
def b84(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(x) for x in (" Table", "MATERIALIZED VIEW", "stored-procedure", "fn")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", catalog.graph_type(names).alias("kind"))


@query("f02_changed_metadata", "SELECT 'NATION_' || n_nationkey AS source_name, CASE WHEN n_nationkey % 2 = 0 THEN 'changed' ELSE 'unchanged' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN 'tool_version_changed' ELSE '' END AS reasons FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = incremental.snapshot(scripts(spark, sf_dir))
    before = same.select("source_name").distinct().withColumn("tool_version", F.lit("1"))
    now = before.withColumn("tool_version", F.when(F.regexp_extract("source_name", "([0-9]+)", 1).cast("int") % 2 == 0, "2").otherwise("1"))
    return incremental.comparison(same, same, now, before).select("source_name", "status", "reasons")


def postgres_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A PostgreSQL catalog made of the parts (relations, keys, triggers, rules), suppliers (routines) and lineitems (dependencies)."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part, supplier = read("part").selectExpr("p_partkey AS k", "p_size AS z"), read("supplier").selectExpr("s_suppkey AS k")
    item = read("lineitem").selectExpr("l_partkey AS p", "l_suppkey AS s", "elt(l_linenumber % 3 + 1, 'n', 'a', 'i') AS deptype")
    rules = item.selectExpr("'pg_rewrite' AS classid", "p + 1000000 AS objid", "'pg_class' AS refclassid", "s AS refobjid", "deptype")
    used = item.selectExpr("'pg_proc' AS classid", "s AS objid", "'pg_proc' AS refclassid", "s % 10 + 1 AS refobjid", "deptype")
    spaces = spark.createDataFrame([(0, "public"), (1, "sales"), (2, "pg_catalog"), (3, "pg_toast_7")], "oid long, nspname string")
    return {
        "pg_namespace": spaces, "pg_rewrite": part.selectExpr("k + 1000000 AS oid", "k AS ev_class"), "pg_depend": rules.union(used),
        "pg_class": part.selectExpr("k AS oid", "concat('rel_', k) AS relname", "k % 4 AS relnamespace", "elt(k % 5 + 1, 'r', 'v', 'm', 'p', 'i') AS relkind"),
        "pg_proc": supplier.selectExpr("k AS oid", "concat('fn_', k) AS proname", "k % 4 AS pronamespace", "elt(k % 3 + 1, 'f', 'p', 'a') AS prokind"),
        "pg_constraint": part.selectExpr("concat('fk_', k) AS conname", "if(k % 3 = 0, 'u', 'f') AS contype", "k AS conrelid", "k div 2 AS confrelid"),
        "pg_trigger": part.selectExpr("concat('trg_', k) AS tgname", "k AS tgrelid", "k % 10 + 1 AS tgfoid", "z AS tgtype", "if(k % 7 = 0, 'D', 'O') AS tgenabled", "k % 6 = 0 AS tgisinternal"),
    }


_SPACE = "CASE {} % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'sales' WHEN 2 THEN 'pg_catalog' ELSE 'pg_toast_7' END"
_PG = f"""WITH c AS (SELECT p_partkey AS oid, 'rel_' || p_partkey AS name, {_SPACE.format("p_partkey")} AS space, p_partkey % 4 < 2 AS own, p_partkey % 5 AS kind, p_size AS z,
  CASE p_partkey % 5 WHEN 1 THEN 'view' WHEN 2 THEN 'materialized_view' ELSE 'table' END AS typed FROM part),
f AS (SELECT s_suppkey AS oid, 'fn_' || s_suppkey AS name, {_SPACE.format("s_suppkey")} AS space, s_suppkey % 4 < 2 AS own, s_suppkey % 3 AS kind, CASE s_suppkey % 3 WHEN 1 THEN 'procedure' ELSE 'function' END AS typed FROM supplier),
d AS (SELECT l_partkey AS p, l_suppkey AS s, l_suppkey % 10 + 1 AS t, CASE l_linenumber % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'a' END AS deptype FROM lineitem WHERE l_linenumber % 3 < 2),
objects AS (SELECT space AS schema_name, name AS object_name, typed AS object_type FROM c WHERE own AND kind < 4 UNION ALL SELECT space, name, typed FROM f WHERE own AND kind < 2),
keys AS (SELECT a.space AS schema_name, a.name AS table_name, b.space AS referenced_schema_name, b.name AS referenced_table_name, 'fk_' || a.oid AS constraint_name FROM c a JOIN c b ON b.oid = a.oid // 2 WHERE a.own AND a.oid % 3 <> 0),
triggers AS (SELECT a.space AS schema_name, 'trg_' || a.oid AS trigger_name, a.space AS table_schema_name, a.name AS table_name,
  concat_ws(',', CASE WHEN z & 4 <> 0 THEN 'INSERT' END, CASE WHEN z & 16 <> 0 THEN 'UPDATE' END, CASE WHEN z & 8 <> 0 THEN 'DELETE' END, CASE WHEN z & 32 <> 0 THEN 'TRUNCATE' END) AS events,
  a.oid % 7 = 0 AS is_disabled, f.space AS function_schema_name, f.name AS function_name FROM c a JOIN f ON f.oid = a.oid % 10 + 1 WHERE a.own AND a.oid % 6 <> 0),
dependencies AS (SELECT a.space AS from_schema_name, a.name AS from_object_name, a.typed AS from_object_type, b.space AS to_schema_name, b.name AS to_object_name, b.typed AS to_object_type, deptype AS dependency_name, 'object_dependency' AS dependency_type
  FROM d JOIN c a ON a.oid = d.p JOIN c b ON b.oid = d.s WHERE a.own AND b.own AND a.kind IN (1, 2) AND a.oid <> b.oid
  UNION ALL SELECT a.space, a.name, a.typed, b.space, b.name, b.typed, deptype, 'object_dependency' FROM d JOIN f a ON a.oid = d.s JOIN f b ON b.oid = d.t WHERE a.own AND b.own AND a.oid <> b.oid)
"""


@query("a25_postgres_objects", _PG + "SELECT * FROM objects")
def a25_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postgres.objects(postgres_tables(spark, sf_dir))


@query("a26_postgres_foreign_keys", _PG + "SELECT * FROM keys")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postgres.foreign_keys(postgres_tables(spark, sf_dir))


@query("a27_trigger_rows", _PG + "SELECT * FROM triggers")
def a27_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postgres.triggers(postgres_tables(spark, sf_dir))


@query("a28_postgres_dependencies", _PG + "SELECT * FROM dependencies")
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postgres.dependencies(postgres_tables(spark, sf_dir))


@query("a29_schema_filter", _PG + "SELECT * FROM keys WHERE schema_name = 'sales'")
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postgres.foreign_keys(postgres_tables(spark, sf_dir), only=["sales"])


#: Rows that a30_row_budget may read of all tables together: more than the objects, fewer than objects and keys, from sf0.01 on.
BUDGET = 1_500


@query("a30_row_budget", _PG + f""", o AS (SELECT * FROM objects ORDER BY schema_name, object_name, object_type LIMIT {BUDGET}), no AS (SELECT count(*) AS n FROM o),
k AS (SELECT * FROM keys ORDER BY schema_name, table_name, constraint_name LIMIT (SELECT {BUDGET} - n FROM no)), nk AS (SELECT no.n + (SELECT count(*) FROM k) AS n FROM no),
t AS (SELECT * FROM triggers ORDER BY schema_name, table_name, trigger_name LIMIT (SELECT {BUDGET} - n FROM nk)), nt AS (SELECT nk.n + (SELECT count(*) FROM t) AS n FROM nk),
e AS (SELECT * FROM dependencies ORDER BY from_schema_name, from_object_name, to_schema_name, to_object_name, dependency_name LIMIT (SELECT {BUDGET} - n FROM nt))
SELECT 'pg_class' AS name, object_name AS item, NULL::VARCHAR AS other, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT 'pg_constraint', constraint_name, table_name, count(*) FROM k GROUP BY ALL
UNION ALL SELECT 'pg_trigger', trigger_name, table_name, count(*) FROM t GROUP BY ALL UNION ALL SELECT 'pg_depend', from_object_name, to_object_name, count(*) FROM e GROUP BY ALL
UNION ALL SELECT 'issue', CASE WHEN (SELECT n FROM no) >= {BUDGET} THEN 'pg_class' WHEN (SELECT n FROM nk) >= {BUDGET} THEN 'pg_constraint' WHEN (SELECT n FROM nt) >= {BUDGET} THEN 'pg_trigger' ELSE 'pg_depend' END, NULL, 1""")
def a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, issues = postgres.read(postgres_tables(spark, sf_dir), BUDGET)
    columns = {"pg_class": ("object_name", None), "pg_constraint": ("constraint_name", "table_name"), "pg_trigger": ("trigger_name", "table_name"), "pg_depend": ("from_object_name", "to_object_name")}
    out = spark.createDataFrame([("issue", i.split(" while reading ")[1].split(";")[0], None) for i in issues], "name string, item string, other string")
    for name, (item, other) in columns.items():
        out = out.unionByName(found[name].select(F.lit(name).alias("name"), F.col(item).alias("item"), (F.col(other) if other else F.lit(None).cast("string")).alias("other")))
    return tally(out, "name", "item", "other")


@query("b80_postgres_catalog", _PG + """, known AS (SELECT lower(schema_name || '.' || object_name) AS name, CASE object_type WHEN 'table' THEN 'sql_table' WHEN 'procedure' THEN 'stored_procedure' WHEN 'function' THEN 'sql_function' ELSE 'sql_view' END AS kind FROM objects
  UNION SELECT lower(schema_name || '.' || trigger_name), 'sql_trigger' FROM triggers),
wanted AS (SELECT lower(schema_name || '.' || table_name) AS own, 'sql_table' AS own_kind, lower(referenced_schema_name || '.' || referenced_table_name) AS other, 'sql_table' AS other_kind, 'REFERENCES_SQL_OBJECT' AS edge_type FROM keys
  UNION ALL SELECT lower(schema_name || '.' || trigger_name), 'sql_trigger', lower(table_schema_name || '.' || table_name), 'sql_table', 'TRIGGERS_ON_SQL_OBJECT' FROM triggers
  UNION ALL SELECT lower(from_schema_name || '.' || from_object_name), CASE from_object_type WHEN 'procedure' THEN 'stored_procedure' WHEN 'function' THEN 'sql_function' ELSE 'sql_view' END,
    lower(to_schema_name || '.' || to_object_name), CASE to_object_type WHEN 'procedure' THEN 'stored_procedure' WHEN 'function' THEN 'sql_function' WHEN 'table' THEN 'sql_table' ELSE 'sql_view' END, 'REFERENCES_SQL_OBJECT' FROM dependencies),
met AS (SELECT w.*, (SELECT count(*) FROM known k WHERE k.name = w.own AND k.kind = w.own_kind) AS a, (SELECT count(*) FROM known k WHERE k.name = w.other AND k.kind = w.other_kind) AS b FROM wanted w)
SELECT 'edge' AS what, edge_type AS kind, own AS item, other, b = 1 AS resolved, count(*) AS n FROM met WHERE a = 1 GROUP BY ALL
UNION ALL SELECT 'entity', kind, name, NULL, NULL, count(*) FROM known GROUP BY ALL UNION ALL SELECT 'issue', NULL, own, NULL, NULL, count(*) FROM met WHERE a <> 1 GROUP BY ALL""")
def b80_postgres(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = postgres_tables(spark, sf_dir)
    entities, edges, issues = postgres.scan("db", {"pg_class": postgres.objects(t), "pg_constraint": postgres.foreign_keys(t), "pg_trigger": postgres.triggers(t), "pg_depend": postgres.dependencies(t)})
    none = lambda c: F.lit(None).cast(c)
    rows = edges.select(F.lit("edge").alias("what"), F.col("edge_type").alias("kind"), F.col("from_name").alias("item"), F.col("to_name").alias("other"), "resolved")
    rows = rows.unionByName(entities.select(F.lit("entity").alias("what"), F.col("entity_type").alias("kind"), F.lower("file_path").alias("item"), none("string").alias("other"), none("boolean").alias("resolved")))
    rows = rows.unionByName(issues.select(F.lit("issue").alias("what"), none("string").alias("kind"), F.regexp_extract("message", ": (.*)$", 1).alias("item"), none("string").alias("other"), none("boolean").alias("resolved")))
    return tally(rows, "what", "kind", "item", "other", "resolved")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)

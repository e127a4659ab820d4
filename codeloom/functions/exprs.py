"""Column expressions shared by the operators: ids, normalisers, names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_EDGES = r"[\[\]`\"']"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """x without white space of any kind at its ends; a text that begins and ends with visible ASCII needs no pattern."""
    c = _col(x)
    plain = F.ascii(c).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)
    return F.when(plain, c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def string_value(x: str | Column) -> Column:
    """The stripped string, NULL where nothing is left."""
    return F.nullif(strip(x), F.lit(""))


def stable_id(*parts: str | Column) -> Column:
    """First 24 hexadecimal digits of the SHA-256 of the parts joined by bars; NULL parts are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def entity_id(source: str | Column = "source_name", kind: str | Column = "entity_type", name: str | Column = "name", path: str | Column = "file_path") -> Column:
    return stable_id(F.lit("entity"), source, kind, name, path)


def edge_id() -> Column:
    """Of the columns of an edge; a line number of 0 counts as none."""
    line = F.when(F.col("line_number") != 0, F.col("line_number").cast("string"))
    return stable_id(F.lit("edge"), "from_entity_id", "edge_type", "to_name", "file_path", line, "identity_key")


def id_number(x: str | Column) -> Column:
    """An id as a number of the same order: groups find the least and largest number by hashing, where those of texts have all rows sorted."""
    left, right = (F.conv(F.substring(_col(x), start, 12), 16, 10).cast("decimal(15,0)") for start in (1, 13))
    return left * F.lit(16**12).cast("decimal(15,0)") + right


def id_text(x: str | Column) -> Column:
    """The id of an id_number()."""
    half = F.lit(16**12).cast("decimal(15,0)")
    right = _col(x) % half
    return F.concat(*[F.lower(F.lpad(F.hex(n.cast("long")), 12, "0")) for n in ((_col(x) - right) / half, right)])


def target_id(source: str | Column = "source_name", kind: str | Column = "to_type", name: str | Column = "to_name") -> Column:
    return stable_id(F.lit("unresolved"), source, kind, name)


def normalize_key(x: str | Column) -> Column:
    """Resolution key: stripped, without quotes and brackets at the ends, lower case."""
    return F.lower(F.regexp_replace(strip(x), f"^{_EDGES}+|{_EDGES}+$", ""))


def normalized_sql_key(x: str | Column) -> Column:
    """normalize_key of each non-blank dotted part; NULL for a NULL or empty name."""
    parts = F.filter(F.split(_col(x), r"\."), lambda p: strip(p) != "")
    return F.when(F.length(_col(x)) > 0, F.array_join(F.transform(parts, normalize_key), "."))


def sql_name(x: str | Column) -> Column:
    """A dotted SQL name without the brackets and quotes of its parts."""
    return F.array_join(F.transform(F.split(_col(x), r"\."), lambda p: F.regexp_replace(strip(p), f"^{_EDGES}+|{_EDGES}+$", "")), ".")


def schema_of(x: str | Column) -> Column:
    """The last but one part of a dotted name."""
    parts = F.split(_col(x), r"\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def short_name(x: str | Column) -> Column:
    return F.element_at(F.split(_col(x), r"\."), -1)


#: A URL: an optional scheme, an optional authority, and the path.
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)"


def endpoint(raw: str | Column) -> Column:
    """What follows a leading ${...} or the last brace, where that is a path; else the path of a URL; else the text itself."""
    x = _col(raw)
    after_first, after_last = F.regexp_extract(x, r"^\$\{[^}]*\}(?s:(.*))$", 1), F.regexp_extract(x, r"\}([^}]*)$", 1)
    path = F.regexp_replace(F.regexp_extract(x, _URL, 2), ";[^/]*$", "")
    return F.when(after_first.startswith("/"), after_first).when(after_last.startswith("/"), after_last).when(path != "", path).otherwise(x)


def route_path(raw: str | Column) -> Column:
    """A normal route path: no query, fragment or empty segment; what stands in braces, segments that begin with a colon, and numbers as :param."""
    bare = F.regexp_replace(F.regexp_replace(endpoint(raw), r"(?s)[?#].*$", ""), r"\$?\{[^}]+\}", ":param")
    segments = F.filter(F.split(bare, "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda s: F.when(s.rlike(r"^(:.*|[0-9]+)$"), F.lit(":param")).otherwise(s)), "/"))


def service_from_env(name: str | Column) -> Column:
    """A service's name from an environment variable such as ORDER_API_URL."""
    low = F.lower(_col(name))
    return F.translate(F.regexp_replace(low, "(_base_url|_api_url|_url|_uri|_endpoint|_host)$", ""), "_", "-")


#: Fixed value: the name of a service that nothing names.
EXTERNAL_SERVICE = "external-service"


def service_from_url(raw: str | Column) -> Column:
    """The first label of a URL's host, by the rules of identifiers."""
    authority = F.regexp_replace(F.regexp_extract(strip(raw), _URL, 1), "^.*@", "")
    host = F.when(authority.startswith("["), F.lower(F.regexp_extract(authority, r"^\[([^\]]*)", 1))).otherwise(F.lower(F.regexp_extract(authority, "^([^:]*)", 1)))
    return service_from_identifier(F.element_at(F.split(host, r"\."), 1))


def service_from_identifier(name: str | Column) -> Column:
    """A service's name from an identifier such as OrderServiceBaseUrl; external-service where nothing is left."""
    dashed = F.regexp_replace(strip(name), r"([a-z0-9])([A-Z])", "$1-$2")
    plain = F.regexp_replace(F.regexp_replace(dashed, "(?i)(base)?(url|uri|endpoint|host)$", ""), "[^A-Za-z0-9]+", "-")
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(plain, "^-+|-+$", "")), F.lit("")), F.lit(EXTERNAL_SERVICE))


def relationship_type(x: str | Column) -> Column:
    """A type name of letters, digits and underscores; RELATED_TO for an empty one."""
    name = F.regexp_replace(F.upper(strip(x)), "[^A-Z0-9_]", "_")
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("RELATED_TO")).when(name.rlike("^[0-9]"), F.concat(F.lit("EDGE_"), name)).otherwise(name)


def metadata_value(x: str | Column) -> Column:
    return F.translate(F.lower(strip(x)), " -", "__")


def truthy(x: str | Column) -> Column:
    return F.coalesce(F.lower(strip(_col(x).cast("string"))).isin("1", "true", "t", "yes", "y"), F.lit(False))


def python_package(x: str | Column) -> Column:
    return F.translate(F.lower(strip(x)), "_", "-")


def package_root(x: str | Column) -> Column:
    """The package of an import path: two segments of a scoped name, else one."""
    parts = F.split(_col(x), "/")
    return F.when(_col(x).startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.element_at(parts, 1))

"""C# and Visual Basic: symbols, attributes, routes, calls and the methods that lines stand in.

C# is read as tokens with their brackets: a walk goes over namespaces, types and members and
steps over bodies, so text in literals opens nothing. Visual Basic is read line by
line, an attribute over several of them if need be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codeloom.operators.facts import Fact, route_path, scanner, service_from_host, service_from_identifier, url_host
from codeloom.operators.tokens import Tokens

#: Words of the languages, and names that the scanners look for.
CS_TYPES = ("class", "interface", "record", "struct")
CS_MODIFIERS = {"public", "private", "protected", "internal", "static", "virtual", "override", "abstract", "async", "sealed", "new", "partial", "extern", "unsafe", "readonly"}
VB_MODIFIERS = {
    "public", "private", "friend", "protected", "partial", "mustinherit", "notinheritable", "shared", "overrides", "overridable", "async", "static",
}
VERBS = ["get", "post", "put", "patch", "delete", "head", "options"]
CLIENT_VERBS = ["get", "post", "put", "patch", "delete"]
VB_READS = ["downloadstring", "openread", "uploadstring"]
CONTRACTS = {"webmethod": ".asmx", "operationcontract": ".svc"}


@dataclass
class Method:
    """A method with its type and namespace, the lines of its body, and the (line, target) of the same file's methods that it calls."""

    name: str
    type: str
    namespace: str
    line: int
    attributes: list = field(default_factory=list)
    prefix: str | None = None
    first: int = 0
    last: int = -1
    body: tuple[int, int] = (0, 0)
    calls: list = field(default_factory=list)

    @property
    def full(self) -> str:
        return ".".join(p for p in (self.namespace, self.type, self.name) if p)


@dataclass
class Unit:
    """What a file declares: (kind, full name, line) of its types, and its methods."""

    types: list = field(default_factory=list)
    methods: list[Method] = field(default_factory=list)

    def index(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for m in self.methods:
            out.setdefault(m.type, set()).add(m.name)
        return out


def _same_file_calls(unit: Unit, method: Method, tokens: Tokens, a: int, b: int, own: str) -> Iterator[tuple[int, str]]:
    """(line, Type.Method) of the calls between tokens a and b of methods that the file declares; own is the word for the present object."""
    index, seen = unit.index(), set()
    for i in range(a, b):
        if tokens.at(i + 1) != "(" or not tokens.is_(i, "name"):
            continue
        name, owner = tokens.text[i], method.type
        if tokens.at(i - 1) == ".":
            owner = tokens.at(i - 2)
            if owner == ")":
                # new Type(...).Method(...)
                start = next((k for k, end in tokens.match.items() if end == i - 2 and tokens.at(k - 2).lower() == "new"), None)
                owner = tokens.at(start - 1) if start is not None else ""
            elif owner.lower() == own:
                owner = method.type
        elif tokens.at(i - 1).lower() == "new":
            continue
        target = f"{owner}.{name}"
        if name in index.get(owner, ()) and target != f"{method.type}.{method.name}" and (tokens.line[i], target) not in seen:
            seen.add((tokens.line[i], target))
            yield tokens.line[i], target


# C#

def _attributes(t: Tokens, i: int, end: int) -> list[tuple[str, str | None]]:
    """(name, first literal) of the attributes between the square brackets at i and end."""
    out, k = [], i + 1
    while k < end:
        if t.is_(k, "name"):
            while t.at(k + 1) in (".", ":") and t.is_(k + 2, "name"):
                k += 2
            close = t.match.get(k + 1, k) if t.at(k + 1) == "(" else k
            literal = next((cs_string(t.text[n]) for n in range(k + 1, close) if t.is_(n, "literal")), None)
            out.append((t.text[k].removesuffix("Attribute").lower(), literal))
            k = close
        k += 1
    return out


def cs_string(literal: str) -> str:
    """J15. What a C# literal says, plain, verbatim or interpolated."""
    body = literal.lstrip("$@")[1:-1]
    return body.replace('""', '"') if "@" in literal[:2] else body.replace('\\"', '"').replace("\\\\", "\\")


def cs_unit(t: Tokens) -> Unit:
    """J18. The types and methods of a C# file, with the attributes before them and the bodies of methods."""
    unit, n = Unit(), len(t.text)
    namespace, pending = "", []
    open_types: list[tuple[str, str | None, int]] = []
    i = start = 0

    while i < n:
        word = t.text[i]
        while open_types and open_types[-1][2] <= i:
            open_types.pop()
        kind, prefix = open_types[-1][:2] if open_types else ("", None)
        if word == "[" and i == start:
            end = t.match.get(i, n)
            pending += _attributes(t, i, end)
            i = start = end + 1
        elif word == "namespace" and t.is_(i + 1, "name"):
            k = i + 2
            while t.at(k) == "." and t.is_(k + 1, "name"):
                k += 2
            namespace, i = "".join(t.text[i + 1 : k]), k + 1
            start, pending = i, []
        elif word in CS_TYPES and t.is_(i + 1, "name") and all(w in CS_MODIFIERS or w in CS_TYPES for w in t.text[start:i]):
            name = i + 2 if t.text[i + 1] in CS_TYPES else i + 1
            k = name + 1
            while k < n and t.text[k] not in "{;":
                k = t.match.get(k, k) + 1
            own = t.text[name]
            unit.types.append(("interface" if word == "interface" else "class", ".".join(p for p in (namespace, own) if p), t.line[name]))
            route = next((v for a, v in pending if a == "route"), None)
            if t.at(k) == "{":
                open_types.append((own, route, t.match.get(k, n)))
            pending, i = [], k + 1
            start = i
        elif word == "(" and open_types and (m := _cs_method(t, start, i, kind, namespace)):
            m.attributes, m.prefix, pending = pending, prefix, []
            unit.methods.append(m)
            k = t.match.get(i, n) + 1
            while k < n and t.text[k] not in ("{", ";", "=>"):
                k = t.match.get(k, k) + 1
            end = k
            if t.at(k) == "{":
                end = t.match.get(k, n - 1)
            elif t.at(k) == "=>":
                while end < n - 1 and t.text[end] != ";":
                    end = t.match.get(end, end) + 1
            if t.at(k) in ("{", "=>"):
                end = min(end, n - 1)
                m.body, m.first, m.last = (k, end), t.line[k], t.line[end]
            i = start = end + 1
        elif word in ("(", "{") and not (word == "{" and not open_types):
            i = t.match.get(i, n) + 1
            if word == "{":
                start, pending = i, []
        else:
            i += 1
            if word in ";{}":
                start = i
                pending = [] if word == ";" else pending
    index = unit.index()
    for m in unit.methods:
        if index:
            m.calls = list(_same_file_calls(unit, m, t, *m.body, "this"))
    return unit


def _cs_method(t: Tokens, start: int, i: int, kind: str, namespace: str) -> Method | None:
    """The method whose parameters open at i, if the tokens of its member from start on are modifiers, a type and a name."""
    name = i - 1
    if t.at(name) == ">":
        depth = 0
        while name > start:
            depth += (t.text[name] == ">") - (t.text[name] == "<")
            name -= 1
            if depth == 0:
                break
    k = start
    while k < name and t.text[k] in CS_MODIFIERS:
        k += 1
    typed = t.text[k:name]
    if k == start or not typed or not t.is_(name, "name") or any(w in ("=", "=>", "operator", "delegate", "event") for w in typed):
        return None
    return Method(t.text[name], kind, namespace, t.line[name])


def join_route(prefix: str | None, path: str) -> str:
    if path.startswith("/"):
        return path
    return "/" + "/".join(s for p in (prefix, path) if p for s in [p.strip("/")] if s)


def _filled(route: str, kind: str, method: str) -> str:
    route = re.sub(r"(?i)\[controller\]", lambda _: kind.removesuffix("Controller"), route)
    return re.sub(r"(?i)\[action\]", lambda _: method, route)


def route_fact(edge: str, near: tuple[str, str], verb: str, path: str, parser: str, line: int | None, **properties: str) -> Fact:
    normal = route_path(path)
    return Fact(edge, *near, "api_route", f"{verb} {path}", parser, line, {"method": verb, "path": path, "normalized_path": normal, **properties}, (f"{verb} {normal}", normal, path))


def http_facts(near: tuple[str, str], verb: str, raw: str, parser: str, line: int, context: dict[str, str]) -> Iterator[Fact]:
    """A call of the service that a whole address names, else of a route."""
    host = url_host(raw) if re.match(r"https?://", raw) else None
    told = {"method": verb, "raw_target": raw, "target_boundary": "application", "dependency_scope": "runtime", "interaction_kind": "service_call" if host else "http_call", **context}
    if host:
        yield Fact("CALLS_SERVICE", *near, "service", service_from_host(host), parser, line, told)
    else:
        yield Fact("CALLS_HTTP", *near, "api_route", f"{verb} {route_path(raw)}", parser, line, told)


def _symbols(unit: Unit, path: str, parser: str, sub: str) -> Iterator[Fact]:
    for kind, full, line in unit.types:
        yield Fact("DECLARES_SYMBOL", "file", path, kind, full, parser, line, {"symbol_kind": kind}, (full.rsplit(".", 1)[-1],))
    for m in unit.methods:
        yield Fact("DECLARES_SYMBOL", "file", path, "function", m.full, parser, m.line, {"symbol_kind": sub, **({"parent": m.type} if m.type else {})}, (m.name, f"{m.type}.{m.name}" if m.type else m.name))


def _origins(unit: Unit, path: str, line: int) -> list[tuple[tuple[str, str], dict[str, str]]]:
    """From where a line's interactions start: its file, and the method that it stands in."""
    inside = [m for m in unit.methods if m.first <= line <= m.last]
    return [(("file", path), {}), *[(("function", m.full), {"source_context_type": "function", "source_context_name": m.full}) for m in inside[-1:]]]


@scanner("csharp", lambda p: p.lower().endswith(".cs"))
def csharp(path: str, text: str) -> Iterator[Fact]:
    """B37 to B39. Types and methods, controller and minimal routes, HTTP calls, calls of the file's own methods."""
    t = Tokens(text, comments=False)
    unit = cs_unit(t)
    yield from _symbols(unit, path, "dotnet_symbol", "method")
    for m in unit.methods:
        plain = next((v for a, v in m.attributes if a == "route"), None)
        for attribute, literal in m.attributes:
            verb = attribute.removeprefix("http")
            if attribute.startswith("http") and verb in VERBS:
                prefix = _filled(m.prefix, m.type, m.name) if m.prefix else None
                route = join_route(prefix, _filled(literal or plain or "", m.type, m.name))
                yield route_fact("DECLARES_ROUTE", ("file", path), verb.upper(), route, "dotnet_controller_route", m.line, operation_name=m.name)
                yield Fact("HANDLES_ROUTE", "api_route", f"{verb.upper()} {route}", "function", m.full, "dotnet_controller_route", m.line)
        for line, target in m.calls:
            yield Fact("CALLS_SYMBOL", "function", m.full, "function", target, "dotnet_call", line)
    for p in t.places():
        name = p.name.lower()
        if p.form != "call" or p.first is None or not (p.receiver or name.endswith("async")):
            continue
        if name.startswith("map") and name[3:] in VERBS and p.receiver:
            yield route_fact("DECLARES_ROUTE", ("file", path), name[3:].upper(), p.first, "dotnet_minimal_route", p.line)
        if name.endswith("async") and name[:-5] in CLIENT_VERBS:
            for near, context in _origins(unit, path, p.line):
                yield from http_facts(near, name[:-5].upper(), p.first, "dotnet_http", p.line, context)


# Visual Basic

def _vb_code(line: str) -> list[str]:
    """The words, literals and signs of a line, without its comment."""
    out = []
    for m in re.finditer(r'"(?:[^"]|"")*"|[A-Za-z_]\w*|\S', line):
        if m[0] == "'":
            break
        out.append(m[0])
    return out


def vb_unit(text: str) -> Unit:
    """J17. The types and methods of a Visual Basic file; attributes wait, over lines too, for the method that they stand before."""
    unit, namespace, kind, attributes, within, at = Unit(), "", "", [], False, None
    for n, line in enumerate(text.splitlines(), 1):
        words = _vb_code(line)
        if not words:
            continue
        if within or words[0] == "<":
            opened = 1
            for k, w in enumerate(words if within else words[1:], 0 if within else 1):
                opened += (w == "<") - (w == ">")
                if re.match(r"[A-Za-z_]", w) and (k == 0 or words[k - 1] in ("<", ",", ".", "_")):
                    if k and words[k - 1] == "." and attributes:
                        attributes.pop()
                    attributes.append(w.lower())
                if not opened:
                    words = words[k + 1 :]
                    break
            within = opened > 0
            words = [] if within else [w for w in words if w != "_"]
            if not words:
                continue
        low = [w.lower() for w in words]
        k = next((k for k, w in enumerate(low) if w not in VB_MODIFIERS), len(low))
        what, name = (low[k], words[k + 1]) if k + 1 < len(words) else ("", "")
        if k == 0 and what == "namespace":
            namespace = "".join(words[1:])
        elif what in ("class", "module", "interface") and re.match(r"[A-Za-z_]", name):
            kind = name
            unit.types.append((what, ".".join(p for p in (namespace, name) if p), n))
        elif what in ("function", "sub") and re.match(r"[A-Za-z_]", name):
            at = Method(name, kind, namespace, n, attributes, what, n, n)
            unit.methods.append(at)
        elif low[0] == "end" and low[1:2] in (["function"], ["sub"]) and at:
            at.last, at = n, None
        if at:
            at.last = n
        attributes = []
    return unit


@scanner("vb", lambda p: p.lower().endswith(".vb"))
def visual_basic(path: str, text: str) -> Iterator[Fact]:
    """B40. Types, methods, contract routes, literal HTTP, settings that name services, SQL commands, calls of the file's own methods."""
    unit = vb_unit(text)
    t = Tokens("\n".join(" ".join(_vb_code(line)) for line in text.splitlines()))
    yield from _symbols(unit, path, "vb_symbol", "method")
    for m in unit.methods:
        if suffix := next((s for a in m.attributes for c, s in CONTRACTS.items() if a.removesuffix("attribute") == c), None):
            base = path[: -len(".vb")]
            route = f"/{base if base.lower().endswith(suffix) else base + suffix}/{m.name}"
            yield route_fact("DECLARES_ROUTE", ("file", path), "POST", route, "vb_contract_route", m.line, operation_name=m.name)
            yield Fact("HANDLES_ROUTE", "api_route", f"POST {route}", "function", m.full, "vb_contract_route", m.line)
        inside = [i for i, line in enumerate(t.line) if m.line < line <= m.last]
        for line, target in _same_file_calls(unit, m, t, inside[0], inside[-1] + 1, "me") if inside else ():
            yield Fact("CALLS_SYMBOL", "function", m.full, "function", target, "vb_call", line)
    for p in t.places():
        name, receiver = p.name.lower(), p.receiver.lower()
        if p.form != "call" or p.first is None:
            continue
        for near, context in _origins(unit, path, p.line):
            if name in VB_READS or name == "create" and receiver.rsplit(".", 1)[-1] == "webrequest":
                yield from http_facts(near, "GET", p.first, "vb_http", p.line, context)
            if name == "appsettings" and receiver.rsplit(".", 1)[-1] == "configurationmanager":
                told = {"config_key": p.first, "target_boundary": "application", "dependency_scope": "runtime", "interaction_kind": "service_call", **context}
                yield Fact("CALLS_SERVICE", *near, "service", service_from_identifier(p.first), "vb_config_service", p.line, told)
            if name == "sqlcommand":
                yield from _command(near, p.first, p.line, context)
    for i, word in enumerate(t.text):
        if word.lower() == "commandtext" and t.at(i + 1) == "=" and t.is_(i + 2, "literal"):
            for near, context in _origins(unit, path, t.line[i]):
                yield from _command(near, t.literal(i + 2) or "", t.line[i], context)


def _command(near: tuple[str, str], sql: str, line: int, context: dict[str, str]) -> Iterator[Fact]:
    """A call of the procedure that a command executes, or whose dotted name is all of it."""
    part = r"(?:\[[^\]]+\]|\w+)"
    called = re.search(rf"(?i)\bexec(?:ute)?\s+({part}(?:\.{part})*)", sql) or re.fullmatch(rf"\s*({part}(?:\.{part})+)\s*", sql)
    if called:
        told = {"raw_target": sql, "sql_operation": "EXECUTE", "target_boundary": "database", "dependency_scope": "runtime", "interaction_kind": "sql_reference", **context}
        yield Fact("CALLS_SQL", *near, "stored_procedure", re.sub(r"[\[\]]", "", called[1]), "vb_sql_command", line, told)


def scopes(files: DataFrame) -> DataFrame:
    """(source_name, rel_path, line_number, function): the method that each line of C# and Visual Basic files stands in."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, path, text in zip(batch["source_name"], batch["rel_path"], batch["content"]):
                unit = cs_unit(Tokens(text or "", comments=False)) if path.lower().endswith(".cs") else vb_unit(text or "")
                rows += [(source, path, m.first, m.last, m.full) for m in unit.methods if m.last >= m.first]
            yield pd.DataFrame(rows, columns=["source_name", "rel_path", "first", "last", "function"])

    code = files.where(F.lower("rel_path").rlike(r"\.(cs|vb)$")).select("source_name", "rel_path", "content")
    found = code.mapInPandas(run, "source_name string, rel_path string, first int, last int, function string")
    lines = found.select("source_name", "rel_path", F.explode(F.sequence("first", "last")).alias("line_number"), "first", "function")
    # Of methods that share a line, the later one.
    return lines.groupBy("source_name", "rel_path", "line_number").agg(F.max_by("function", "first").alias("function"))

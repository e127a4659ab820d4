"""A small tokenizer of program text, and the places that rules look at: calls, decorators, imports and declarations.

It knows names, literals, arrows and brackets, in the way that C-like languages share, across
lines, but no grammar. Every step goes over the tokens once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<literal>[$@]{0,2}(?:"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`))|(?P<name>[A-Za-z_$][\w$]*)|(?P<other>=>|\d[\w.]*|\S)"""
)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: How far apart the parts of one declaration, import or type may stand, in tokens, and how many calls around a key are told of it.
REACH, AROUND = 200, 4


class Place(NamedTuple):
    """form: call, decorator, import, function or class. first: the first argument, or an import's module, where it is a literal; second: the second, where it is a name.

    values: the literals given to keys on a call's line, or, if that has neither these nor a literal as a first argument
    (of_line: that of the line's first call with one), those within the call (within).
    """

    line: int
    form: str
    name: str
    receiver: str = ""
    generic: str = ""
    first: str | None = None
    second: str | None = None
    values: tuple = ()
    within: tuple = ()
    of_line: str | None = None
    exported: bool = False


class Tokens:
    def __init__(self, text: str, comments: bool = True):
        """comments: whether what stands in comments counts as well."""
        self.text, self.kind, starts, at = [], [], [], 0
        while m := _TOKEN.search(text, at):
            at = m.end()
            if not comments and m[0] == "/" and (skipped := _COMMENT.match(text, m.start())):
                at = skipped.end()
                continue
            self.text.append(m[0])
            self.kind.append(m.lastgroup)
            starts.append(m.start())
        breaks = [m.start() for m in re.finditer("\n", text)]
        self.line = [bisect_right(breaks, at) + 1 for at in starts]
        self.match, waiting = {}, []
        for i, t in enumerate(self.text):
            if self.kind[i] == "other":
                if t in "([{":
                    waiting.append(i)
                elif t in _CLOSES and waiting and self.text[waiting[-1]] == _CLOSES[t]:
                    self.match[waiting.pop()] = i

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def is_(self, i: int, kind: str) -> bool:
        return 0 <= i < len(self.kind) and self.kind[i] == kind

    def literal(self, i: int) -> str | None:
        """What a literal that is not empty says."""
        return (self.text[i].lstrip("$@")[1:-1] or None) if self.is_(i, "literal") else None

    def exported(self, i: int) -> bool:
        """Whether export stands before token i, with nothing but modifiers between."""
        while self.at(i - 1) in ("async", "default", "abstract"):
            i -= 1
        return self.at(i - 1) == "export"

    def places(self) -> Iterator[Place]:
        """In the order of the text."""
        held: dict[int, list] = {}
        by_line: dict[int, list] = {}
        first: dict[int, str] = {}
        around: list[int] = []
        found: list[tuple[int, Place]] = []
        for i, t in enumerate(self.text):
            while around and self.match.get(around[-1], len(self.text)) < i:
                around.pop()
            if self.kind[i] == "name":
                found.extend((i, p) for p in (self._declared(i), self._imported(i)) if p)
            if t == "(":
                if value := self.literal(self._argument(i)):
                    first.setdefault(self.line[i], value)
                if p := self._called(i):
                    found.append((i, p))
                    around.append(i)
                    held[i] = []
            elif self.at(i + 1) in (":", "=") and self.kind[i] != "other":
                value = self.literal(i + 3 if self.at(i + 2) == "[" else i + 2)
                if value is not None:
                    pair = (self.literal(i) or t, value)
                    by_line.setdefault(self.line[i], []).append(pair)
                    for call in around[-AROUND:]:
                        held[call].append(pair)
        for i, p in found:
            if i in held:
                here = by_line.get(p.line) or ([] if p.line in first else held[i])
                p = p._replace(values=tuple(here), within=tuple(held[i]), of_line=first.get(p.line))
            yield p

    def _argument(self, i: int) -> int:
        """Where the first argument of the call that opens at i stands; a new list's is its first item."""
        i += 1
        while self.at(i) in ("new", "[", "]", "{"):
            i += 1
        return i

    def _called(self, i: int) -> Place | None:
        """The call whose arguments open at i."""
        end, generic = i - 1, ""
        if self.at(end) == ">":
            start = next((k for k in range(end - 1, max(-1, end - 16), -1) if self.at(k) == "<"), 0)
            generic, end = "".join(self.text[start + 1 : end]), start - 1
            if not re.fullmatch(r"[A-Za-z_][\w.]*", generic):
                generic = ""
        if not self.is_(end, "name") or self.at(end - 1) == "function" or self.at(end - 2) + self.at(end - 1) == "function*":
            return None
        k, parts = end, []
        while self.at(k - 1) == "." and self.is_(k - 3 if self.at(k - 2) in ("?", "!") else k - 2, "name"):
            k -= 3 if self.at(k - 2) in ("?", "!") else 2
            parts.insert(0, self.text[k])
        first = self._argument(i)
        value = self.literal(first)
        after = first + 2 if value is not None and self.at(first + 1) == "," else 0
        second = self.text[after] if after and self.is_(after, "name") and self.at(after + 1) in (",", ")") else None
        return Place(self.line[end], "decorator" if self.at(k - 1) == "@" else "call", self.text[end], ".".join(parts), generic, value, second)

    def _imported(self, i: int) -> Place | None:
        word = self.text[i]
        if word not in ("import", "export") or self.at(i - 1) == "." or word == "export" and self.at(i + 1) not in ("*", "{", "type"):
            return None
        if word == "import" and (raw := self.literal(i + 1)):
            return Place(self.line[i], "import", raw, first=raw)
        for k in range(i + 1, min(i + REACH, len(self.text))):
            if self.text[k] == "from" and (raw := self.literal(k + 1)):
                return Place(self.line[k], "import", raw, first=raw)
            if self.text[k] in (";", "(", "import") or self.is_(k, "literal"):
                return None
        return None

    def _declared(self, i: int) -> Place | None:
        word = self.text[i]
        if word == "function":
            name = i + 2 if self.at(i + 1) == "*" else i + 1
            return Place(self.line[name], "function", self.text[name], exported=self.exported(i)) if self.is_(name, "name") else None
        if word == "class" and self.is_(i + 1, "name") and self.at(i - 1) != ".":
            return Place(self.line[i + 1], "class", self.text[i + 1], exported=self.exported(i))
        if word in ("const", "let", "var") and self.is_(i + 1, "name"):
            equals = next((k for k in range(i + 2, min(i + REACH, len(self.text))) if self.text[k] in ("=", ";", "=>")), 0)
            if (self.at(i + 2) in ("=", ":")) and self.at(equals) == "=" and self._arrow(equals + 1):
                return Place(self.line[i + 1], "function", self.text[i + 1], exported=self.exported(i))
        return None

    def _arrow(self, i: int) -> bool:
        """Whether an arrow function begins at i."""
        i += self.at(i) == "async"
        if self.at(i) == "<":
            i = next((k + 1 for k in range(i, min(i + REACH, len(self.text))) if self.text[k] == ">" and self.at(k + 1) == "("), i)
        if self.at(i) != "(":
            return self.is_(i, "name") and self.at(i + 1) == "=>"
        end = self.match.get(i, -1) + 1
        if not end or self.at(end) == "=>":
            return bool(end)
        # A type may stand between the parameters and the arrow.
        return self.at(end) == ":" and any(self.text[k] == "=>" for k in range(end, min(end + REACH, len(self.text))) if ";" not in self.text[end:k])

"""The query language: text to a tree.

``a b`` and ``a OR b``; ``a AND b``; ``a NOT b``; ``( )`` nest. ``"a b"`` or ``<a b>``
is a sequence, ``"a b"~10`` words within 10 positions (with ``d`` in this order).
Flags after ``~`` hold for a term or a whole group: ``s`` case-sensitive, ``g`` ghost
(must match, isn't returned), ``{...}`` a condition on the token's columns, ``[...]``
one on the document's. ``column: ...`` searches another token column. ``*`` is any
characters, ``?`` one or none, a backslash escapes, ``{...}`` is verbatim.
``label# ...`` names a query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class QueryError(ValueError):
    """The text isn't a query."""


@dataclass
class Leaf:
    """Terms of which any may match; a term of several words is a sequence."""

    terms: list[str]
    feature: str = ""
    sensitive: bool = False
    ghost: bool = False
    token_expr: list[str] = field(default_factory=list)
    meta_expr: list[str] = field(default_factory=list)
    number: int = -1

    def conditions(self) -> tuple:
        return self.feature, self.sensitive, self.ghost, tuple(self.token_expr), tuple(self.meta_expr)


@dataclass
class Node:
    """``relation`` is OR, AND, NOT, sequence or proximity."""

    relation: str
    terms: list
    window: int = 0
    directed: bool = False


@dataclass
class _Flags:
    letters: set[str] = field(default_factory=set)
    number: int | None = None
    token_expr: list[str] = field(default_factory=list)
    meta_expr: list[str] = field(default_factory=list)


_BOOLEAN = ("AND", "OR", "NOT")
_CLOSES = {"(": ")", "<": ">", '"': '"'}


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def flags(self) -> _Flags:
        """What stands after a ``~``, up to a blank or a closing bracket."""
        out = _Flags()
        if self.peek() != "~":
            return out
        self.at += 1
        digits = ""
        while self.peek() and self.peek() not in ' )>"(<':
            c = self.peek()
            if c in "{[":
                end = self.text.find("}" if c == "{" else "]", self.at)
                if end < 0:
                    raise QueryError(f"a condition isn't closed: {self.text[self.at :]}")
                inner = self.text[self.at + 1 : end]
                if re.search(r"[{\[]" if c == "{" else r"[\[{]", inner):
                    raise QueryError(f"a condition within a condition: {inner}")
                (out.token_expr if c == "{" else out.meta_expr).append(inner)
                self.at = end + 1
                continue
            if c in "}]":
                raise QueryError(f"{c!r} closes nothing")
            if c.isdigit():
                digits += c
            else:
                out.letters.add(c)
            self.at += 1
        out.number = int(digits) if digits else None
        return out

    def verbatim(self) -> str:
        """A term within braces; wildcards in it are escaped."""
        end = self.text.find("}", self.at)
        if end < 0:
            raise QueryError("a verbatim term isn't closed")
        inner = self.text[self.at : end]
        if "{" in inner:
            raise QueryError("a verbatim term within a verbatim term")
        self.at = end + 1
        return re.sub(r"([*?])", r"\\\1", inner)

    def group(self, opened: str, quotes: int) -> Node:
        """Terms up to the sign that closes ``opened`` (or the end)."""
        begin = self.at - 1
        parts: list = []
        term, feature = "", ""
        own = _Flags()

        def done(closing: bool = False) -> None:
            nonlocal term
            if term:
                if term in _BOOLEAN:
                    parts.append(term)
                else:
                    f = _Flags() if closing else self.flags()
                    parts.append(Leaf([term], "", "s" in f.letters, "g" in f.letters, f.token_expr, f.meta_expr))
                term = ""

        while True:
            c = self.peek()
            if not c:
                if opened:
                    raise QueryError(f"{opened!r} isn't closed: {self.text[begin:]}")
                break
            self.at += 1
            if c == "\\":
                n = self.peek()
                self.at += 1
                term += "\\" + n if n in "*?" else n
            elif c == "{":
                term += self.verbatim()
            elif c == _CLOSES.get(opened):
                done(True)
                own = self.flags()
                break
            elif c in ")>":
                raise QueryError(f"{c!r} closes {opened!r}" if opened else f"{c!r} closes nothing")
            elif c in '("<':
                done()
                parts.append(self.group(c, quotes + (c != "(")))
            elif c == ":" and term and not parts:
                feature, term = term, ""
            elif c == ":":
                raise QueryError("a column is named at the start of a query or of a group; else escape the colon")
            elif c == " ":
                done()
            elif c == "~":
                self.at -= 1
                if not term:
                    raise QueryError("a flag without a term")
                done()
            else:
                term += c
            if self.peek() == "~" and term:
                done()
        done()
        node = self.node(parts, opened, own, quotes)
        self.inherit(node, feature, own)
        return node

    @staticmethod
    def node(parts: list, opened: str, own: _Flags, quotes: int) -> Node:
        """The relation of the parts; only one kind is allowed at a level."""
        kinds: set[str] = set()
        for k, p in enumerate(parts):
            if p in _BOOLEAN if isinstance(p, str) else False:
                if k in (0, len(parts) - 1) or isinstance(parts[k - 1], str):
                    raise QueryError("AND, OR and NOT stand between terms")
                kinds.add(p)
            elif k and not isinstance(parts[k - 1], str):
                kinds.add("OR")
        terms = [p for p in parts if not isinstance(p, str)]
        if not terms:
            raise QueryError("a query without a term")
        if opened in ('"', "<"):
            if kinds & {"AND", "NOT"}:
                raise QueryError("AND and NOT can't be used within quotes")
            relation = "sequence" if own.number is None else "proximity"
            if relation == "proximity" and quotes > 1:
                raise QueryError("a proximity search within quotes")
            return Node(relation, terms, own.number or 0, "d" in own.letters)
        if quotes and kinds & {"AND", "NOT"}:
            raise QueryError("AND and NOT can't be used within quotes")
        if len(kinds) > 1:
            raise QueryError("only one of AND, OR and NOT at a level; nest by parentheses")
        relation = kinds.pop() if kinds else "OR"
        if relation == "NOT" and len(terms) != 2:
            raise QueryError("NOT has one term before and one after it")
        return Node(relation, terms)

    @classmethod
    def inherit(cls, node: Node, feature: str, own: _Flags) -> None:
        """Hands a group's column and flags down to its leaves."""
        for t in node.terms:
            if isinstance(t, Node):
                cls.inherit(t, feature, own)
                continue
            t.feature = t.feature or feature
            t.sensitive |= "s" in own.letters
            t.ghost |= "g" in own.letters
            t.token_expr = list(dict.fromkeys([*t.token_expr, *own.token_expr]))
            t.meta_expr = list(dict.fromkeys([*t.meta_expr, *own.meta_expr]))


def simplified(x, feature: str):
    """Lower-cases terms, makes plain sequences one term of several words, and joins alternatives in one leaf."""
    if isinstance(x, Leaf):
        x.feature = x.feature or feature
        if not x.sensitive:
            x.terms = [t.lower() for t in x.terms]
        return x
    x.terms = [simplified(t, feature) for t in x.terms]
    plain = all(isinstance(t, Leaf) and len(t.terms) == 1 for t in x.terms)
    if x.relation == "sequence" and plain and len({t.conditions() for t in x.terms}) == 1:
        first = x.terms[0]
        return Leaf([" ".join(t.terms[0] for t in x.terms)], first.feature, first.sensitive, first.ghost, first.token_expr, first.meta_expr)
    if x.relation == "OR":
        joined: dict[tuple, Leaf] = {}
        rest = []
        for t in x.terms:
            if isinstance(t, Leaf):
                if t.conditions() in joined:
                    own = joined[t.conditions()]
                    own.terms = list(dict.fromkeys([*own.terms, *t.terms]))
                else:
                    joined[t.conditions()] = t
            else:
                rest.append(t)
        x.terms = [*joined.values(), *rest]
    if x.relation in ("OR", "AND") and len(x.terms) == 1:
        return x.terms[0]
    return x


def _checked(x, within: str = "") -> None:
    if isinstance(x, Leaf):
        return
    if within == "proximity" and x.relation in ("proximity", "AND"):
        raise QueryError("proximity and AND can't be nested in a proximity search")
    for t in x.terms:
        _checked(t, x.relation)


def parse(text: str, feature: str = "token"):
    """The simplified tree of a query: a ``Leaf`` or a ``Node``."""
    p = _Parser(" ".join(text.split()))
    x = simplified(p.group("", 0), feature)
    _checked(x)
    return x


_HASH = re.compile(r"(?<!\\)#")


def labelled(queries: list[str], codes: list[str] | None = None) -> list[tuple[str, str]]:
    """(code, query) of each; codes are given, or stand before a ``#``, or are ``query_<k>``."""
    if codes is not None and len(codes) != len(queries):
        raise QueryError("there must be as many codes as queries")
    out, unnamed = [], 0
    for k, q in enumerate(queries):
        parts = _HASH.split(q)
        if len(parts) > 2:
            raise QueryError("only one # can be used for a label; others must be escaped")
        code = codes[k] if codes is not None and codes[k] is not None else parts[0].strip() if len(parts) == 2 else None
        if code is None:
            unnamed += 1
            code = f"query_{unnamed}"
        out.append((code, parts[-1].strip()))
    if len({c for c, _ in out}) < len(out):
        raise QueryError("codes must be unique")
    return out


def leaves(x) -> list[Leaf]:
    if isinstance(x, Leaf):
        return [x]
    return [y for t in x.terms for y in leaves(t)]

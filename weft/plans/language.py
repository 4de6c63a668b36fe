"""The traversal language: text or a fluent API to steps.

    query     := 'g.V()' steps | 'g.E()' steps         steps := ('.' name '(' [argument (',' argument)*] ')')*
    argument  := literal | name | predicate | step ('.' step)*
    literal   := integer | number with a point | "string" | 'c'
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from weft.schema import TraversalError

EXPAND = ("in", "out", "both", "inE", "outE", "bothE", "inV", "outV", "bothV")
STEPS = frozenset((*EXPAND, *"and or not where union repeat has hasLabel hasKey hasValue hasNot is coin values properties key label as select count sum max min mean group groupCount dedup aggregate cap order limit range skip".split()))
PREDICATES = frozenset("eq neq lt lte gt gte inside outside between within without".split())


@dataclass(frozen=True)
class Literal:
    value: object
    type: str


@dataclass(frozen=True)
class Name:
    text: str


@dataclass(frozen=True)
class Predicate:
    name: str
    args: tuple


@dataclass(frozen=True)
class Step:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Sub:
    steps: tuple[Step, ...]


@dataclass(frozen=True)
class Query:
    source: str
    steps: tuple[Step, ...]


def literal(value) -> Literal:
    if isinstance(value, bool) or value is None:
        raise TraversalError(f"no literal: {value!r}")
    if isinstance(value, int):
        return Literal(value, "int" if -(2**31) <= value < 2**31 else "long")
    if isinstance(value, float):
        return Literal(value, "double")
    return Literal(str(value), "string")


_TOKEN = re.compile(r"""\s*(?:("(?:[^"])*")|('(?:[^'])*')|(-?\d+\.\d*(?:[eE][-+]?\d+)?|-?\.\d+)|(-?\d+)|([A-Za-z_][\w#]*)|([().,]))""")


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        if not (m := _TOKEN.match(text, at)):
            raise TraversalError(f"unexpected words at: {text[at:].strip()[:40]}")
        kind = ("string", "char", "double", "int", "name", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.todo = tokens(text)
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.todo[self.at + ahead] if self.at + ahead < len(self.todo) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.todo[self.at - 1] if self.at <= len(self.todo) else ("end", "")

    def steps(self) -> tuple[Step, ...]:
        out = [self.step()]
        while self.peek() == ("sign", "."):
            self.take()
            out.append(self.step())
        return tuple(out)

    def step(self) -> Step:
        kind, name = self.take()
        if kind != "name" or name not in STEPS:
            raise TraversalError(f"unexpected step: {name or 'nothing'}")
        return Step(name, self.arguments())

    def arguments(self) -> tuple:
        if self.take() != ("sign", "("):
            raise TraversalError("parentheses not balanced: expected '('")
        out: list = []
        if self.peek() == ("sign", ")"):
            self.take()
            return ()
        while True:
            if self.peek() in (("sign", ")"), ("sign", ",")):
                raise TraversalError("unexpected ',' at: an argument is missing")
            out.append(self.argument())
            sign = self.take()
            if sign == ("sign", ")"):
                return tuple(out)
            if sign != ("sign", ","):
                raise TraversalError("parentheses not balanced" if sign[0] == "end" else f"unexpected words at: {sign[1]}")

    def argument(self):
        kind, text = self.peek()
        if kind == "name" and self.peek(1) == ("sign", "("):
            if text in PREDICATES:
                self.take()
                return Predicate(text, self.arguments())
            return Sub(self.steps())
        self.take()
        if kind == "string":
            return Literal(text[1:-1], "string")
        if kind == "char":
            return Literal(text[1:-1], "char" if len(text) == 3 else "string")
        if kind == "double":
            return Literal(float(text), "double")
        if kind == "int":
            return literal(int(text))
        if kind == "name":
            return Name(text)
        raise TraversalError(f"unexpected words at: {text}" if kind != "end" else "parentheses not balanced")


def parse(text: str) -> Query:
    m = re.match(r"\s*g\.(V|E)\(\)", text)
    if not m:
        raise TraversalError("a query begins with g.V() or g.E(), or is BuildIndex(V|E, key) or SetConfig(name, value); emu <file> runs a benchmark")
    rest = text[m.end() :].strip()
    if not rest:
        return Query(m[1], ())
    if rest[0] != ".":
        raise TraversalError(f"unexpected words at: {rest[:40]}")
    if not rest[1:].strip():
        raise TraversalError("empty query")
    reader = _Reader(rest[1:])
    steps = reader.steps()
    if reader.peek()[0] != "end":
        raise TraversalError(f"unexpected words at the end: {reader.peek()[1]}")
    return Query(m[1], steps)


class P:
    """Predicates of the fluent API: ``P.gt(3)``, ``P.within('a', 'b')``."""


for _name in PREDICATES:
    setattr(P, _name, staticmethod(lambda *args, _n=_name: Predicate(_n, tuple(literal(a) for a in args))))


class Fluent:
    """Steps by method calls; names that Python reserves end in ``_``. Without a graph it is a sub-traversal."""

    def __init__(self, source: str | None, steps: tuple[Step, ...], graph=None):
        self.source, self.steps, self.graph = source, steps, graph

    def __getattr__(self, name: str):
        step = name.rstrip("_")
        if step not in STEPS:
            raise AttributeError(name)

        def add(*args) -> Fluent:
            own = tuple(Sub(a.steps) if isinstance(a, Fluent) else a if isinstance(a, (Predicate, Name)) else literal(a) for a in args)
            return Fluent(self.source, (*self.steps, Step(step, own)), self.graph)

        return add

    def query(self) -> Query:
        if self.source is None:
            raise TraversalError("a sub-traversal is no query")
        return Query(self.source, self.steps)

    def frame(self):
        return self.graph.traverse(self.query())


#: Begins a sub-traversal: ``sub.out('knows').count()``.
sub = Fluent(None, ())
#: The bare word ``label`` of group and order, and their directions.
label, incr, decr = Name("label"), Name("incr"), Name("decr")

"""has, hasKey, hasNot, hasValue, hasLabel, is, coin."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.predicates import comparable, test
from weft.operators.expand import text
from weft.plans.language import Literal, Name, Predicate, Step
from weft.plans.state import ELEMENTS, VERTEX, State
from weft.schema import TraversalError

PURE = frozenset(("has", "hasKey", "hasNot", "hasValue", "hasLabel", "is"))


def condition(s: State, step: Step) -> Column:
    """The step as an expression over an attached state."""
    args = step.args
    if step.name == "is":
        if s.kind in ELEMENTS or s.kind == "collection":
            raise TraversalError("unexpected input type for is")
        if len(args) != 1 or not isinstance(args[0], (Literal, Predicate)):
            raise TraversalError("expect one parameter for is")
        return test(F.col("cur"), s.kind, args[0])
    edge = s.element(step.name)
    schema = s.graph.schema
    if step.name == "hasLabel":
        if not args:
            raise TraversalError("expect at least one parameter for hasLabel")
        return s.label().isin(*[schema.label(text(a), edge) for a in args])
    if step.name == "hasValue":
        if not args or not all(isinstance(a, Literal) for a in args):
            raise TraversalError("expect values in hasValue")
        return reduce(Column.__and__, [_any(s, a, edge) for a in args])
    if step.name in ("hasKey", "hasNot"):
        if len(args) != 1:
            raise TraversalError(f"expect one parameter for {step.name}")
        column = s.property(text(args[0]))
        return column.isNotNull() if step.name == "hasKey" else column.isNull()
    if len(args) not in (1, 2):
        raise TraversalError("expect one or two parameters for has")
    if not isinstance(args[0], (Literal, Name)):
        raise TraversalError("expect a key in has")
    key = text(args[0])
    column = s.property(key)
    if len(args) == 1:
        return column.isNotNull()
    if isinstance(args[1], Name):
        raise TraversalError(f"unexpected value: {args[1].text}")
    return column.isNotNull() & test(column, schema.key(key, edge), args[1])


def _any(s: State, value: Literal, edge: bool) -> Column:
    keys = [k for k, t in s.graph.schema.keys(edge).items() if comparable(t, value.type)]
    return reduce(Column.__or__, [F.coalesce(s.property(k) == F.lit(value.value), F.lit(False)) for k in keys], F.lit(False))


def narrowed(s: State, step: Step) -> frozenset[str] | None:
    """Of a vertex, the labels it can have after hasLabel."""
    if s.kind != VERTEX or step.name != "hasLabel":
        return s.labels
    asked = frozenset(text(a) for a in step.args)
    return asked if s.labels is None else asked & s.labels


def apply(s: State, step: Step) -> State:
    if step.name == "hasLabel" and s.kind == VERTEX and not s.attached:
        if s.labels is not None and step.args and s.labels <= {s.graph.schema.label(text(a), False) for a in step.args}:
            return s  # known from the edges that led here
        return replace(s, labels=narrowed(s, step)).attach().keep(condition(replace(s, attached=True), step))
    s = s.attach() if step.name != "is" else s
    return replace(s.keep(condition(s, step)), labels=narrowed(s, step))


def coin(s: State, step: Step) -> State:
    if s.in_filter:
        raise TraversalError("coin inside and/or/not/where has no meaning for equal traversers")
    if len(step.args) != 1 or not isinstance(step.args[0], Literal) or step.args[0].type not in ("int", "double"):
        raise TraversalError("expect one parameter for coin")
    p = float(step.args[0].value)
    if not 0 <= p <= 1:
        raise TraversalError("expected a value in range [0.0, 1.0]")
    return replace(s.keep(F.rand(s.graph.seed) < p), unstable=True)




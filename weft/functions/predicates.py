"""Predicates as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.plans.language import Literal, Predicate
from weft.schema import TraversalError

NUMBERS = ("int", "double", "long")
_ORDER = {"lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__}
_ARITY = {"inside": 2, "outside": 2, "between": 2}


def comparable(a: str, b: str) -> bool:
    return (a in NUMBERS) == (b in NUMBERS)


def compare(name: str, value: Column, args: list[Column]) -> Column:
    """A predicate other than within and without; open bounds for inside and outside, closed ones for between."""
    if name == "eq":
        return value == args[0]
    if name == "neq":
        return value != args[0]
    if name in _ORDER:
        return _ORDER[name](value, args[0])
    low, high = args
    if name == "inside":
        return (value > low) & (value < high)
    if name == "outside":
        return (value < low) | (value > high)
    return (value >= low) & (value <= high)


def arity(p: Predicate) -> None:
    if p.name in ("within", "without"):
        if not p.args:
            raise TraversalError(f"expect at least one parameter for {p.name}")
    elif len(p.args) != (n := _ARITY.get(p.name, 1)):
        raise TraversalError(f"expect {'one parameter' if n == 1 else 'two parameters'} for {p.name}")


def test(value: Column, kind: str, p: Literal | Predicate) -> Column:
    """Does the value, of this type, fulfil a literal or predicate? Null if there is no value."""
    if isinstance(p, Literal):
        p = Predicate("eq", (p,))
    arity(p)
    if not all(isinstance(a, Literal) for a in p.args):
        raise TraversalError(f"expect values in {p.name}")
    fits = [comparable(kind, a.type) for a in p.args]
    if p.name in ("within", "without", *_ARITY) and not all(fits):
        raise TraversalError(f"predicate type not match: {p.name} on {kind}")
    literals = [F.lit(a.value) for a in p.args]
    if p.name in ("within", "without"):
        inside = reduce(Column.__or__, [value == x for x in literals]) if len(literals) < 2 else value.isin(*[a.value for a in p.args])
        return inside if p.name == "within" else ~inside
    if not all(fits):  # a string is no number: never equal, and no order between them
        return value.isNotNull() if p.name == "neq" else F.lit(False)
    return compare(p.name, value, literals)

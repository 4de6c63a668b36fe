"""A few steps by plain loops over lists, one traverser after the other: (current value, remembered values)."""

import operator

from toy import EDGES, VERTICES
from weft.plans.language import Literal, Predicate, Sub

_OPS = {"eq": operator.eq, "neq": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}


def holds(value, p, of=lambda a: a.value) -> bool:
    if isinstance(p, Literal):
        return value == p.value
    args = [of(a) for a in p.args]
    if p.name in _OPS:
        return _OPS[p.name](value, args[0])
    if p.name in ("within", "without"):
        return (value in args) == (p.name == "within")
    low, high = args
    return low < value < high if p.name == "inside" else low <= value <= high if p.name == "between" else value < low or value > high


def props(x) -> dict:
    return {"weight": x[3]} if isinstance(x, tuple) else {k: v for k, v in VERTICES[x].items() if k != "label"}


def label(x) -> str:
    return x[2] if isinstance(x, tuple) else VERTICES[x]["label"]


def incident(v, way, name):
    some = [e for e in EDGES if name in (None, e[2])]
    return ([(e, e[0]) for e in some if e[1] == v] if way in ("in", "both") else []) + ([(e, e[1]) for e in some if e[0] == v] if way in ("out", "both") else [])


def one(step, cur, past):
    """Results of a step that treats each traverser alone."""
    name, args = step.name, [getattr(a, "value", a) for a in step.args]
    if name in ("in", "out", "both", "inE", "outE", "bothE"):
        return [(e if name[-1] == "E" else far, past) for e, far in incident(cur, name.removesuffix("E"), args[0] if args else None)]
    if name in ("inV", "outV", "bothV"):
        return [(x, past) for x in {"inV": [cur[1]], "outV": [cur[0]], "bothV": [cur[1], cur[0]]}[name]]
    if name == "values":
        return [(props(cur)[k], past) for k in args if k in props(cur)]
    if name == "key":
        return [(k, past) for k in props(cur)]
    if name == "label":
        return [(label(cur), past)]
    if name == "as":
        return [(cur, past | {args[0]: cur})]
    if name == "select":
        return [(past[args[0]], past)]
    if name in ("and", "or", "not"):
        found = [bool(run([(cur, past)], a.steps)) for a in step.args]
        ok = all(found) if name == "and" else any(found) if name == "or" else not any(found)
    elif name == "where":
        ok = bool(run([(cur, past)], args[0].steps)) if isinstance(args[0], Sub) else holds(cur, args[0], lambda a: past[a.value])
    elif name == "hasLabel":
        ok = label(cur) in args
    elif name == "hasNot":
        ok = args[0] not in props(cur)
    elif name == "hasKey":
        ok = args[0] in props(cur)
    elif name == "hasValue":
        ok = all(a in props(cur).values() for a in args)
    elif name == "has":
        ok = args[0] in props(cur) and (len(args) == 1 or holds(props(cur)[args[0]], step.args[1]))
    elif name == "is":
        ok = holds(cur, step.args[0])
    else:
        raise ValueError(name)
    return [(cur, past)] if ok else []


def run(rows, steps):
    for s in steps:
        values = [c for c, _ in rows]
        if s.name == "count":
            rows = [(len(rows), {})]
        elif s.name in ("sum", "max", "min", "mean"):
            made = {"sum": sum, "max": max, "min": min, "mean": lambda x: sum(x) / len(x)}[s.name]
            rows = [(float(made(values)), {})] if rows else []
        elif s.name == "dedup":
            rows = list({c: (c, p) for c, p in reversed(rows)}.values())
        elif s.name in ("union", "repeat"):
            rows = [x for a in s.args for x in run(rows, a.steps)]
        else:
            rows = [x for c, p in rows for x in one(s, c, p)]
    return rows


def answer(query) -> list:
    return [c for c, _ in run([(x, {}) for x in (sorted(VERTICES) if query.source == "V" else EDGES)], query.steps)]


def predicate(name, *values):
    return Predicate(name, tuple(values))

"""Neighbours and incident edges: equi-joins with the edge arms that can match."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from weft.plans.language import Literal, Name, Step
from weft.plans.state import EDGE, VERTEX, State
from weft.schema import TraversalError


def expand(s: State, step: Step) -> State:
    way, to_edge = step.name.removesuffix("E"), step.name.endswith("E")
    if s.kind != VERTEX:
        raise TraversalError(f"expect vertex input for {step.name}")
    if len(step.args) > 1:
        raise TraversalError(f"expect at most one parameter for {step.name}")
    label = None
    if step.args:
        if not isinstance(step.args[0], (Literal, Name)):
            raise TraversalError(f"expect an edge label in {step.name}")
        label = s.graph.schema.label(text(step.args[0]), True)
    if way == "both":
        one, two = _one(s, "in", label, to_edge), _one(s, "out", label, to_edge)
        labels = None if one.labels is None or two.labels is None else one.labels | two.labels
        return replace(one, frame=one.frame.unionByName(two.frame), labels=labels, weight=2 * s.weight)
    return _one(s, way, label, to_edge)


def _one(s: State, way: str, label: str | None, to_edge: bool) -> State:
    near, far = ("e_src", "e_dst") if way == "out" else ("e_dst", "e_src")
    edges, reach = s.graph.edges(label, (s.labels, None) if way == "out" else (None, s.labels))
    joined = s.frame.join(edges, s.frame["cur"] == edges[near])
    cur = edges["edge"] if to_edge else edges[far]
    labels = None if to_edge else reach[1 if way == "out" else 0]
    return replace(s, frame=joined.select(cur.alias("cur"), *(s.frame[c] for c in s.carried())), kind=EDGE if to_edge else VERTEX, labels=labels, attached=False)


def ends(s: State, step: Step) -> State:
    """inV, outV, bothV: a projection, no join."""
    if s.kind != EDGE:
        raise TraversalError(f"expect edge input for {step.name}")
    if step.args:
        raise TraversalError(f"expect no parameter for {step.name}")
    src, dst = F.col("cur.src"), F.col("cur.dst")
    cur = {"inV": dst, "outV": src, "bothV": F.explode(F.array(dst, src))}[step.name]
    return s.value(cur, VERTEX)


def text(arg: Literal | Name) -> str:
    return arg.text if isinstance(arg, Name) else str(arg.value)

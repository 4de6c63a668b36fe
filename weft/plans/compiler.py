"""Steps to DataFrames: one lowering function per step; nothing runs until the result is read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.operators import barrier, branch, expand, filters, project
from weft.plans.language import EXPAND, Fluent, Literal, Name, Query, Step, Sub, parse
from weft.plans.state import EDGE, VERTEX, Context, State
from weft.schema import TraversalError

_LOWER = {
    **{n: expand.expand for n in EXPAND if not n.endswith("V")},
    **{n: expand.ends for n in EXPAND if n.endswith("V")},
    **{n: filters.apply for n in filters.PURE},
    "coin": filters.coin, "values": project.values, "properties": project.properties, "key": project.key, "label": project.label,
    "as": project.as_, "select": project.select, "count": barrier.count, "group": barrier.group, "groupCount": barrier.group,
    **{n: barrier.math for n in ("sum", "max", "min", "mean")},
    "dedup": barrier.dedup, "order": barrier.order, **{n: barrier.positions for n in ("limit", "range", "skip")},
    "aggregate": barrier.aggregate, "cap": barrier.cap,
}
_BRANCH = {"where": branch.where, "and": branch.branches, "or": branch.branches, "not": branch.branches, "union": branch.union, "repeat": branch.union}
STEPS = frozenset((*_LOWER, *_BRANCH))


_FILTERS = filters.PURE | {"where", "and", "or", "not"}
_MAPS = frozenset((*EXPAND, "values", "properties", "key", "label"))


def _every(steps: tuple[Step, ...]) -> Iterator[Step]:
    for step in steps:
        yield step
        for a in step.args:
            if isinstance(a, Sub):
                yield from _every(a.steps)


def _as_sets(context: Context, steps: tuple[Step, ...]) -> list[bool]:
    """Before which steps equal traversers are one: a dedup follows, and no step until there tells how many they are."""
    out, follows = [], False
    for step in reversed(steps):
        subs = [a for a in step.args if isinstance(a, Sub)]
        if step.name == "dedup":
            follows = not step.args
        elif step.name in ("union", "repeat"):
            follows = follows and all(t.name in _FILTERS | _MAPS for a in subs for t in a.steps)
        else:
            follows = follows and (step.name in _FILTERS | _MAPS or step.name == "aggregate" and not context.capped)
        out.append(follows)
    return out[::-1]


def _once(s: State) -> State:
    """Equal traversers as one; what they remember would tell them apart."""
    if s.history or s.order:
        return s
    s = s.bare()
    return replace(s, frame=s.frame.distinct())


def run(s: State, steps: tuple[Step, ...]) -> State:
    several = False  # can traversers be equal, by what these steps did?
    for step, as_set in zip(steps, _as_sets(s.context, steps), strict=True):
        if as_set and several and (step.name in EXPAND and not step.name.endswith("V") or step.name == "aggregate" and not s.attached):
            s, several = _once(s), False
        several = several or step.name in _MAPS or step.name in ("union", "repeat")
        if step.name in _BRANCH:
            s = _BRANCH[step.name](s, step, run)
        elif step.name in _LOWER:
            s = _LOWER[step.name](s, step)
        else:
            raise TraversalError(f"unexpected step: {step.name}")
    return s


def begin(graph: Graph, query: Query) -> tuple[State, tuple[Step, ...]]:
    """The scan, with the labels that the first filters leave."""
    context, steps = Context(graph, capped=any(t.name == "cap" for t in _every(query.steps))), query.steps
    if query.source == "E":
        label = None
        if steps and steps[0].name == "hasLabel" and len(steps[0].args) == 1:
            label = graph.schema.label(expand.text(steps[0].args[0]), True)
        edges, _ = graph.edges(label)
        return State(context, edges.select(F.col("edge").alias("cur")), EDGE), steps[1:] if label else steps
    labels = None
    while steps and steps[0].name == "hasLabel" and steps[0].args:
        asked = frozenset(graph.schema.label(expand.text(a), False) for a in steps[0].args)
        labels, steps = asked if labels is None else labels & asked, steps[1:]
    for step in steps:  # tables without a key that is asked for need not be opened
        if step.name not in ("has", "hasKey", "values") or not step.args or step.name == "values" and len(step.args) > 1:
            break
        if isinstance(step.args[0], (Literal, Name)) and (key := expand.text(step.args[0])) in graph.schema.vertex_keys:
            labels = graph.having(key) if labels is None else labels & graph.having(key)
        if step.name == "values":
            break
    frame = graph.vertices(labels).withColumnRenamed("vid", "cur")
    return State(context, frame, VERTEX, labels if labels is not None else frozenset(graph.schema.vertex_labels), attached=True), steps


def compile_query(graph: Graph, query: str | Query | Fluent) -> DataFrame:
    """Column ``value``; for maps and several labels the columns of each entry; for edges also source and destination."""
    query = parse(query) if isinstance(query, str) else query.query() if isinstance(query, Fluent) else query
    s = run(*begin(graph, query))
    frame = s.frame
    if s.order:
        frame = frame.orderBy(*barrier.sorting(s))
    if s.kind == EDGE:
        src, dst = F.col("cur.src"), F.col("cur.dst")
        packed = F.when((src < 1 << 26) & (dst < 1 << 26), F.shiftleft(dst, 26).bitwiseOR(src))
        return frame.select(packed.alias("value"), src.alias("src"), dst.alias("dst"), F.col("cur.label").alias("label"))
    if dict(frame.dtypes)["cur"].startswith("struct"):
        return frame.select("cur.*")
    return frame.select(F.col("cur").alias("value"))


def explain(graph: Graph, query: str) -> str:
    return compile_query(graph, query)._jdf.queryExecution().toString()


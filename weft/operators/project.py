"""values, properties, key, label, as, select."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from weft.functions.render import shown
from weft.operators.expand import text
from weft.plans.language import Step
from weft.plans.state import COLLECTION, Memory, State
from weft.schema import TraversalError, common


def _keys(s: State, step: Step) -> list[str]:
    edge = s.element(step.name)
    keys = [text(a) for a in step.args] or list(s.graph.schema.keys(edge))
    for k in keys:
        s.graph.schema.key(k, edge)
    return keys


def values(s: State, step: Step) -> State:
    keys = _keys(s, step)
    types = [s.graph.schema.key(k, s.element("values")) for k in keys]
    kind = common(types) if types else "string"
    if kind is None and step.args:
        raise TraversalError("expect same type of key in values")
    s = s.attach()
    if len(keys) == 1:
        return s.value(s.property(keys[0]), kind, where=F.col("cur").isNotNull())
    columns = [s.property(k) if kind else shown(s.property(k), t) for k, t in zip(keys, types, strict=True)]
    return s.value(F.explode(F.array_compact(F.array(*columns))), kind or "string")


def properties(s: State, step: Step) -> State:
    keys = _keys(s, step)
    s = s.attach()
    schema = s.graph.schema.keys(s.element("properties"))
    each = [F.when(s.property(k).isNotNull(), F.concat(F.lit("{" + k + ":"), shown(s.property(k), schema[k]), F.lit("}"))) for k in keys]
    return s.value(F.explode(F.array_compact(F.array(*each))), COLLECTION)


def key(s: State, step: Step) -> State:
    none(step)
    keys = _keys(s, step)
    s = s.attach()
    return s.value(F.explode(F.array_compact(F.array(*(F.when(s.property(k).isNotNull(), F.lit(k)) for k in keys)))), "string")


def label(s: State, step: Step) -> State:
    none(step)
    s.element("label")
    s = s.attach()
    return s.value(s.label(), "string")


def none(step: Step) -> None:
    if step.args:
        raise TraversalError(f"expect no parameter for {step.name}")


def as_(s: State, step: Step) -> State:
    if len(step.args) != 1:
        raise TraversalError("expect one parameter for as")
    name = text(step.args[0])
    if name in s.remembered or name in s.forgotten:
        raise TraversalError(f"duplicated key: {name}")
    return replace(s, frame=s.frame.withColumn(f"h_{name}", F.col("cur")), history=(*s.history, (name, Memory(s.kind, s.labels))))


def select(s: State, step: Step) -> State:
    if not step.args:
        raise TraversalError("expect at least one parameter for select")
    names = [text(a) for a in step.args]
    memories = {n: s.recall(n) for n in names}
    if len(names) == 1:
        m = memories[names[0]]
        return s.value(F.col(f"h_{names[0]}"), m.kind, m.labels)
    defined = [n for n, _ in s.history if n in memories]
    return s.value(F.struct(*(F.col(f"h_{n}").alias(n) for n in defined)), COLLECTION)

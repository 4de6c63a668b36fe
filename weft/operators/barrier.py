"""Aggregations, order and positions: over all traversers, or inside a filter branch over those of its key."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from weft.operators.expand import text
from weft.operators.project import none
from weft.plans.language import Literal, Name, Step
from weft.plans.state import COLLECTION, EDGE, State
from weft.schema import TraversalError


def _after(s: State, frame, kind: str) -> State:
    """What was remembered before is gone: there is no one traverser it belongs to."""
    return replace(s, frame=frame, kind=kind, labels=None, attached=False, history=(), forgotten=s.forgotten | set(s.remembered), order=())


def count(s: State, step: Step) -> State:
    none(step)
    n = F.count(F.lit(1)).cast("long").alias("cur")
    if not s.scope:
        return _after(s, s.frame.agg(n), "long")
    counted = s.frame.groupBy(*s.scope).agg(n)
    keys = s.scope_keys
    same = [keys[c].eqNullSafe(counted[c]) for c in s.scope]
    zero = keys.join(counted, same, "left").select(F.coalesce(counted["cur"], F.lit(0)).cast("long").alias("cur"), *(keys[c] for c in s.scope))
    return replace(_after(s, zero, "long"), weight=2 * s.weight)


def math(s: State, step: Step) -> State:
    none(step)
    if s.kind not in ("int", "double", "long"):
        raise TraversalError("expect number input for math related step")
    f = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}[step.name]
    value = f("cur").cast("double").alias("cur")
    frame = s.frame.groupBy(*s.scope).agg(value) if s.scope else s.frame.agg(value)
    return _after(s, frame.select("cur", *s.scope).where(F.col("cur").isNotNull()), "double")


def _projected(s: State, arg) -> Column:
    """A bare ``label`` is the label, anything else a key."""
    s.element("group")
    return s.label() if isinstance(arg, Name) and arg.text == "label" else s.property(text(arg))


def group(s: State, step: Step) -> State:
    if len(step.args) > 2:
        raise TraversalError(f"expect at most two parameters for {step.name}")
    s = s.attach() if step.args else s
    key = _projected(s, step.args[0]) if step.args else F.col("cur")
    value = _projected(s, step.args[1]) if len(step.args) > 1 else F.col("cur")
    rows = s.frame.select(key.alias("key"), value.alias("value"), *s.scope).where("key is not null and value is not null")
    made = F.count(F.lit(1)).alias("count") if step.name == "groupCount" else F.sort_array(F.collect_list("value")).alias("values")
    out = rows.groupBy("key", *s.scope).agg(made)
    return _after(s, out.select(F.struct("key", "count" if step.name == "groupCount" else "values").alias("cur"), *s.scope), COLLECTION)


def dedup(s: State, step: Step) -> State:
    names = [text(a) for a in step.args]
    for n in names:
        s.recall(n)
    s = replace(s.bare(), order=())
    frame = s.frame.select("cur", *s.carried())
    if not names and not s.history:
        return replace(s, frame=frame.distinct())
    return replace(s, frame=frame.dropDuplicates([*(f"h_{n}" for n in names)] + list(s.scope) if names else ["cur", *s.scope]))


def order(s: State, step: Step) -> State:
    up, key = True, None
    for a in step.args:
        if isinstance(a, Name) and a.text in ("incr", "decr"):
            up = a.text == "incr"
        elif key is None:
            key = a
        else:
            raise TraversalError("expect at most one key for order")
    if key is not None:
        s = s.attach()
        by = _projected(s, key)
    else:
        by = F.col("cur")
    frame = s.frame.withColumns({"o_0": by, "o_1": F.col("cur")}).where(F.col("o_0").isNotNull())
    return replace(s, frame=frame, order=(("o_0", up), ("o_1", up)))


def sorting(s: State) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in s.order]


def positions(s: State, step: Step) -> State:
    """limit, range and skip."""
    numbers = [a.value for a in step.args if isinstance(a, Literal) and a.type in ("int", "long")]
    if len(numbers) != len(step.args) or len(numbers) != (2 if step.name == "range" else 1):
        raise TraversalError(f"expect {'two parameters' if step.name == 'range' else 'one parameter'} for {step.name}")
    if min(numbers) < 0:
        raise TraversalError(f"expect no negative parameter for {step.name}")
    start = numbers[0] if step.name != "limit" else 0
    n = numbers[0] if step.name == "limit" else numbers[1] - start + 1 if step.name == "range" else None
    if n is not None and n <= 0:
        return s.keep(F.lit(False))
    if s.scope:
        at = F.row_number().over(Window.partitionBy(*s.scope).orderBy(*(sorting(s) or [F.col("cur").asc()])))
        frame = s.frame.withColumn("at", at).where((F.col("at") > start) & (F.lit(True) if n is None else F.col("at") <= start + n)).drop("at")
        return replace(s, frame=frame)
    if n is None:
        return _skip(s, start) if start else s
    frame = s.frame.orderBy(*sorting(s)) if s.order else s.frame
    return replace(s, frame=(frame.offset(start) if start else frame).limit(n), unstable=s.unstable or not s.order)


def _skip(s: State, n: int) -> State:
    """All rows but the first n: only those n are gathered, where an offset would bring all rows to one task."""
    s = s.bare()
    frame = s.frame.persist() if s.unstable else s.frame
    first = frame.orderBy(*sorting(s)).limit(n) if s.order else frame.limit(n)
    return replace(s, frame=frame.exceptAll(first), unstable=s.unstable or not s.order, weight=2 * s.weight)


def aggregate(s: State, step: Step) -> State:
    if s.in_filter:
        raise TraversalError("aggregate inside and/or/not/where has no meaning for equal traversers")
    if len(step.args) != 1:
        raise TraversalError("expect one parameter for aggregate")
    frame = s.frame
    if s.unstable:  # read twice: what a coin or an unordered limit chose must not be chosen anew
        frame = s.frame.persist()
    name, held = text(step.args[0]), s.context.effects
    mine = frame.select("cur")
    held[name] = (held[name][0].unionByName(mine) if name in held and held[name][1] == s.kind else mine, s.kind)
    return replace(s, frame=frame)


def effect(s: State, name: str):
    if name not in s.context.effects:
        raise TraversalError(f"unexpected key: {name}; expected one of: {', '.join(s.context.effects) or 'none'}")
    return s.context.effects[name]


def cap(s: State, step: Step) -> State:
    if s.in_filter:
        raise TraversalError("cap inside and/or/not/where belongs to no traverser")
    if not step.args:
        raise TraversalError("expect at least one parameter for cap")
    out = None
    kinds = {effect(s, text(a))[1] for a in step.args}
    for a in step.args:
        frame, kind = effect(s, text(a))
        value = F.col("cur") if len(kinds) == 1 else (F.to_json("cur") if kind == EDGE else F.col("cur").cast("string"))
        row = frame.agg(F.sort_array(F.collect_list(value)).alias("values")).select(F.struct(F.lit(text(a)).alias("key"), "values").alias("cur"))
        out = row if out is None else out.unionByName(row)
    return _after(s, out, COLLECTION)



"""where, and, or, not, union, repeat.

The outcome of a filter branch depends on the current value and on what the branch remembers. So a branch runs once for
each distinct key of these, not for each traverser, and the traversers meet the outcome by a semi or anti join.
Branches that only test the current element become a condition without any join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.predicates import arity, compare
from weft.operators import filters
from weft.operators.barrier import effect
from weft.operators.expand import text
from weft.plans.language import Literal, Name, Predicate, Step, Sub
from weft.plans.state import State
from weft.schema import TraversalError

Run = Callable[[State, tuple[Step, ...]], State]


def where(s: State, step: Step, run: Run) -> State:
    args = step.args
    if len(args) == 1 and isinstance(args[0], Sub):
        return branches(s, Step("and", args), run)
    if not 1 <= len(args) <= 2 or not isinstance(args[-1], Predicate) or len(args) == 2 and not isinstance(args[0], (Name, Literal)):
        raise TraversalError("expect a predicate, a label and a predicate, or a sub query for where")
    p = args[-1]
    arity(p)
    left, kind = "cur", s.kind
    if len(args) == 2:
        left, kind = f"h_{text(args[0])}", s.recall(text(args[0])).kind
    if p.name in ("within", "without"):
        sets = [effect(s, text(a)) for a in p.args]
        wanted = [f for f, k in sets if k == kind or {k, kind} <= {"int", "long", "double"}]  # a set of another type holds none of these
        how = "left_semi" if p.name == "within" else "left_anti"
        if not wanted:
            return s.keep(F.lit(p.name == "without"))
        every = wanted[0]
        for f in wanted[1:]:
            every = every.union(f)
        every = every.select(F.col("cur").alias("x")).distinct()
        return replace(s, frame=s.frame.join(every, s.frame[left] == every["x"], how))
    others = [s.recall(text(a)) for a in p.args]
    numbers = {"int", "long", "double"}
    if any(m.kind != kind and not {m.kind, kind} <= numbers for m in others):
        return s.keep(F.lit(p.name == "neq"))
    return s.keep(compare(p.name, F.col(left), [F.col(f"h_{text(a)}") for a in p.args]))


def _refers(steps: tuple[Step, ...]) -> set[str]:
    """Names that steps may read from what was remembered before."""
    found: set[str] = set()
    for st in steps:
        for a in st.args:
            if isinstance(a, Sub):
                found |= _refers(a.steps)
            elif st.name in ("where", "select", "dedup"):
                found |= {text(x) for x in (a.args if isinstance(a, Predicate) else (a,)) if isinstance(x, (Name, Literal))}
    return found


def _pure(sub: Sub) -> bool:
    return all(st.name in filters.PURE for st in sub.steps)


def branches(s: State, step: Step, run: Run) -> State:
    subs = [a for a in step.args if isinstance(a, Sub)]
    if not subs or len(subs) != len(step.args):
        raise TraversalError(f"expect sub queries for {step.name}")
    if all(map(_pure, subs)):
        if any(st.name != "is" for x in subs for st in x.steps):
            s = s.attach()
        tests = [_all(s, x) for x in subs]
        test = tests[0]
        for t in tests[1:]:
            test = test & t if step.name == "and" else test | t
        return s.keep(~test if step.name == "not" else test)
    s = s.light()
    names = [n for n, _ in s.history if n in set().union(*(_refers(x.steps) for x in subs))]
    depth = 1 + max((int(c[1:].split("_")[0]) for c in s.scope), default=0)
    scope = {"cur": f"s{depth}_cur"} | {f"h_{n}": f"s{depth}_h_{n}" for n in names}
    keys = s.frame.select("cur", *(f"h_{n}" for n in names)).distinct()
    keys = keys.select("*", *(F.col(c).alias(k) for c, k in scope.items()))
    begin = replace(s, frame=keys, attached=False, history=tuple((n, m) for n, m in s.history if n in names), scope=tuple(scope.values()), scope_keys=keys.select(*scope.values()), order=(), in_filter=True)
    ended = [run(begin, x.steps) for x in subs]
    outcomes: list[DataFrame] = [o.frame.select(*scope.values()) for o in ended]
    s = replace(s, weight=s.weight + sum(o.weight for o in ended))
    if step.name == "and":
        for o in outcomes:
            s = replace(s, frame=_meet(s.frame, o, scope, "left_semi"))
        return s
    every = outcomes[0]
    for o in outcomes[1:]:
        every = every.unionByName(o)
    return replace(s, frame=_meet(s.frame, every, scope, "left_semi" if step.name == "or" else "left_anti"))


def _all(s: State, sub: Sub) -> Column:
    test = F.lit(True)
    for st in sub.steps:
        test = test & F.coalesce(filters.condition(s, st), F.lit(False))
    return test


def _meet(frame: DataFrame, outcome: DataFrame, scope: dict[str, str], how: str) -> DataFrame:
    return frame.join(outcome, [frame[c].eqNullSafe(outcome[k]) for c, k in scope.items()], how)


def union(s: State, step: Step, run: Run) -> State:
    """A copy of each traverser goes through each branch; ``repeat`` is one pass, so the same."""
    subs = [a for a in step.args if isinstance(a, Sub)]
    if not subs or len(subs) != len(step.args):
        raise TraversalError(f"expect sub queries for {step.name}")
    s = replace(s.bare(), order=())
    s = replace(s, frame=s.frame.select("cur", *s.carried()))
    s = s.light()
    outs = [run(s, x.steps) for x in subs]
    numbers = {"int", "long"}
    if len({o.kind if o.kind not in numbers else "long" for o in outs}) > 1:
        raise TraversalError("expect same output type in sub queries")
    shared = [(n, m) for n, m in outs[0].history if all(n in o.remembered and o.remembered[n].kind == m.kind for o in outs)]
    shared = [(n, replace(m, labels=_either([o.remembered[n].labels for o in outs]))) for n, m in shared]
    columns = ["cur", *(f"h_{n}" for n, _ in shared), *s.scope]
    frames = [o.frame.select(*columns) for o in outs]
    if len({f.schema["cur"].dataType.simpleString() for f in frames}) > 1:
        if outs[0].kind not in numbers:
            raise TraversalError("expect same output type in sub queries")
        frames = [f.withColumn("cur", F.col("cur").cast("long")) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    kind = outs[0].kind if len({o.kind for o in outs}) == 1 else "long"
    gone = frozenset().union(*(o.forgotten | set(o.remembered) for o in outs)) - {n for n, _ in shared}
    return replace(s, frame=out, kind=kind, labels=_either([o.labels for o in outs]), history=tuple(shared), forgotten=s.forgotten | gone, unstable=any(o.unstable for o in outs), weight=sum(o.weight for o in outs))


def _either(labels: list[frozenset[str] | None]) -> frozenset[str] | None:
    return None if None in labels else frozenset().union(*labels)



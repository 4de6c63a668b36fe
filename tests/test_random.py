"""Random traversals against plain loops."""

import random

import pytest

from interpreter import answer
from weft.plans.language import parse

VALUES = {"name": ['"marko"', '"lop"', '"josh"', '"zoe"'], "age": ["27", "29", "32", "35", "-1"], "lang": ['"java"', '"c"'], "weight": ["0.2", "0.4", "1.0", "2.5"]}
KINDS = {"name": "text", "lang": "text", "age": "number", "weight": "number"}


class Maker:
    def __init__(self, seed):
        self.r = random.Random(seed)
        self.names = 0

    def predicate(self, key):
        v, r = VALUES[key], self.r
        kind = r.choice(["", "eq", "neq", "lt", "lte", "gt", "gte", "inside", "outside", "between", "within", "without"])
        if kind == "":
            return r.choice(v)
        n = {"inside": 2, "outside": 2, "between": 2, "within": 3, "without": 2}.get(kind, 1)
        return f"{kind}({','.join(r.choice(v) for _ in range(n))})"

    def step(self, kind, past, depth):
        """(text, kind after)"""
        r = self.r
        if depth and r.random() < 0.25:
            sub = lambda: self.chain(kind, past, r.randint(1, 3), depth - 1)[0]
            name = r.choice(["and", "or", "not", "where"])
            return f"{name}({','.join(sub() for _ in range(1 if name == 'where' else r.randint(1, 2)))})", kind
        if past and r.random() < 0.2:
            name, was = r.choice(past)
            if was == kind and kind in ("vertex", "text", "number") and r.random() < 0.6:
                return f'where({r.choice(["eq", "neq", "lt", "gte"])}("{name}"))', kind
            if was != "edge":
                return f'select("{name}")', was
        if r.random() < 0.12 and kind != "edge" and len(past) < 3:
            self.names += 1
            past.append((f"n{self.names}", kind))
            return f'as("n{self.names}")', kind
        if r.random() < 0.12 and kind != "edge" and not past:
            return "dedup()", kind
        if kind in ("vertex", "edge"):
            keys = ["name", "age", "lang"] if kind == "vertex" else ["weight"]
            key = r.choice(keys)
            some = [(f'has("{key}",{self.predicate(key)})', kind), (f'has("{key}")', kind), (f'hasKey("{key}")', kind), (f'hasNot("{key}")', kind), (f'hasValue({r.choice(VALUES[key])})', kind), (f'values("{key}")', KINDS[key]), ("label()", "text"), ("key()", "text")]
            if kind == "vertex":
                some += [(f"{w}({l})", "vertex") for w in ("in", "out", "both") for l in ("", '"knows"', '"created"')] * 2
                some += [(f"{w}({l})", "edge") for w in ("inE", "outE", "bothE") for l in ("", '"knows"')]
                some += [(f'hasLabel("{x}")', kind) for x in ("person", "software")]
            else:
                some += [(f"{w}()", "vertex") for w in ("inV", "outV", "bothV")] * 3
            return r.choice(some)
        key = "age" if kind in ("number", "count") else "name"
        some = [(f"is({self.predicate(key)})", kind)]
        if kind == "number":
            some += [("max()", "math"), ("min()", "math"), ("count()", "count")]
        return r.choice(some) if kind != "math" else ("is(gte(20))", "math")

    def chain(self, kind, past, n, depth):
        past, texts = list(past), []
        for _ in range(n):
            if len(texts) and texts[-1].startswith(("count", "max", "min")):
                past.clear()
            text, kind = self.step(kind, past, depth)
            texts.append(text)
        return ".".join(texts), kind

    def query(self):
        source = self.r.choice("VVVE")
        text, kind = self.chain("vertex" if source == "V" else "edge", [], self.r.randint(1, 6), 1)
        return f"g.{source}().{text}", kind


@pytest.mark.parametrize("seed", range(6))
def test_random_chains(toy, seed):
    maker = Maker(seed)
    for _ in range(6):
        text, kind = maker.query()
        got = toy.traverse(text)
        rows = [(r.src, r.dst, r.label) if kind == "edge" else r[0] for r in got.collect()]
        want = [x[:3] if kind == "edge" else x for x in answer(parse(text))]
        assert sorted(map(str, rows)) == sorted(map(str, want)), text

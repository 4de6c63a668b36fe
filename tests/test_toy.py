"""Results worked out by hand over the graph of six vertices."""

import pytest

from weft.schema import TraversalError


def shown(frame):
    return [r[0] if len(r) == 1 else tuple(r) for r in frame.collect()]


BAGS = [
    ("g.V().count()", [6]),
    ("g.E().count()", [6]),
    ("g.V()", [1, 2, 3, 4, 5, 6]),
    ('g.V().hasLabel("person").count()', [4]),
    ('g.V().has("name","marko").out().values("name")', ["vadas", "lop", "josh"]),
    ('g.V().has("name","marko").out("knows").values("name")', ["vadas", "josh"]),
    ('g.V().hasLabel("software").in("created").values("name")', ["marko", "josh", "peter", "josh"]),
    ('g.V().hasLabel("software").in("created").dedup().values("name")', ["marko", "josh", "peter"]),
    ('g.V().has("name","josh").both().values("name")', ["marko", "lop", "ripple"]),
    ('g.V().has("age",between(27,32)).values("name")', ["marko", "vadas", "josh"]),
    ('g.V().has("age",inside(27,32)).values("name")', ["marko"]),
    ('g.V().has("age",outside(27,32)).values("name")', ["peter"]),
    ('g.V().has("age",neq(29)).values("name")', ["vadas", "josh", "peter"]),
    ('g.V().has("age",within(27,35)).values("name")', ["vadas", "peter"]),
    ('g.V().has("age",without(27,35)).values("name")', ["marko", "josh"]),
    ('g.V().has("age",29.0).values("name")', ["marko"]),
    ('g.V().has("name",eq(29)).count()', [0]),
    ('g.V().has("age",gt(-5)).count()', [4]),
    ('g.V().hasNot("age").values("name")', ["lop", "ripple"]),
    ('g.V().hasKey("lang").values("name")', ["lop", "ripple"]),
    ('g.V().hasValue("java").values("name")', ["lop", "ripple"]),
    ('g.V().hasValue("java","lop").values("name")', ["lop"]),
    ('g.V().hasValue(29).values("name")', ["marko"]),
    ('g.V().hasLabel("person").hasLabel("software").count()', [0]),
    ('g.V().hasLabel("person").values("age").sum()', [123.0]),
    ('g.V().hasLabel("person").values("age").mean()', [30.75]),
    ('g.V().hasLabel("person").values("age").max()', [35.0]),
    ('g.V().hasLabel("person").values("age").min()', [27.0]),
    ('g.V().hasLabel("software").values("age").sum()', []),
    ('g.V().hasLabel("software").values("age").count()', [0]),
    ('g.E().values("weight").sum()', [3.5]),
    ('g.E().has("weight",gte(1.0)).inV().values("name")', ["josh", "ripple"]),
    ('g.E().hasLabel("knows").bothV().values("name")', ["marko", "vadas", "marko", "josh"]),
    ('g.E().hasLabel("knows").outV().dedup().values("name")', ["marko"]),
    ('g.E().hasLabel("created","knows").label().dedup()', ["created", "knows"]),
    ('g.V().has("name","lop").inE().values("weight")', [0.4, 0.4, 0.2]),
    ('g.V().has("name","josh").bothE("created").values("weight")', [1.0, 0.4]),
    ("g.V().groupCount(label)", [("person", 4), ("software", 2)]),
    ('g.V().group(label,"name")', [("person", ["josh", "marko", "peter", "vadas"]), ("software", ["lop", "ripple"])]),
    ('g.V().values("lang").group()', [("java", ["java", "java"])]),
    ('g.V().where(out("created").count().is(gt(1))).values("name")', ["josh"]),
    ('g.V().hasLabel("person").where(out("created").count().is(0)).values("name")', ["vadas"]),
    ('g.V().not(out()).values("name")', ["vadas", "lop", "ripple"]),
    ('g.V().and(out("created"),in("knows")).values("name")', ["josh"]),
    ('g.V().or(out("knows"),in("knows")).values("name")', ["marko", "vadas", "josh"]),
    ('g.V().or(has("age",gt(30)),has("lang","java")).values("name")', ["josh", "peter", "lop", "ripple"]),
    ('g.V().not(has("age")).values("name")', ["lop", "ripple"]),
    ('g.V().as("a").out("created").in("created").where(neq("a")).values("name")', ["josh", "peter", "marko", "peter", "marko", "josh"]),
    ('g.V().as("a").out("knows").as("b").where("a",lt("b")).count()', [2]),
    ('g.V().hasLabel("person").values("age").as("x").is(lt(30)).where(inside("x","x")).count()', [0]),
    ('g.V().has("name","marko").out("created").in("created").aggregate("x").out("knows").where(without("x")).values("name")', ["vadas"]),
    ('g.V().has("name","peter").out("knows").aggregate("x").where(within("x")).count()', [0]),
    ('g.V().has("name","josh").union(out(),in()).values("name")', ["ripple", "lop", "marko"]),
    ('g.V().has("name","marko").repeat(out(),out("knows")).values("name")', ["vadas", "lop", "josh", "vadas", "josh"]),
    ("g.V().union(count(),count())", [6, 6]),
    ('g.V().has("name","marko").properties()', ["{name:marko}", "{age:29}"]),
    ('g.E().has("weight",0.2).properties("weight")', ["{weight:0.2}"]),
    ('g.V().hasLabel("software").key().dedup()', ["name", "lang"]),
    ('g.V().has("name","marko").values()', ["marko", "29"]),
    ('g.V().hasLabel("software").values("name","lang")', ["lop", "java", "ripple", "java"]),
    ('g.V().hasLabel("software").values("name").aggregate("x").cap("x")', [("x", ["lop", "ripple"])]),
    ('g.V().has("name","marko").as("a").out("created").as("b").select("a","b")', [(1, 3)]),
    ('g.V().has("name","marko").as("a").out("created").select("a").values("age")', [29]),
    ('g.V().as("a").out("created").as("b").dedup("b").count()', [2]),
    ("g.V().coin(1.0).count()", [6]),
    ("g.V().coin(0.0).count()", [0]),
    ("g.V().limit(0)", []),
    ("g.V().limit(4).count()", [4]),
    ('g.V().where(out().order("name",decr).limit(1).has("name","vadas")).values("name")', ["marko"]),
    ('g.V().where(out().values("age").max().is(32.0)).values("name")', ["marko"]),
    ('g.V().where(out().where(out("created").count().is(2))).values("name")', ["marko"]),
    ('g.V().not(out().not(has("lang","java"))).values("name")', ["josh", "peter", "vadas", "lop", "ripple"]),
    ('g.V().where(out().skip(2)).values("name")', ["marko"]),
    ('g.V().where(out().label().dedup().count().is(2)).values("name")', ["marko"]),
    ('g.V().as("a").where(out("created").in("created").where(neq("a"))).values("name")', ["marko", "josh", "peter"]),
]
IN_ORDER = [
    ('g.V().order("age",decr).limit(2).values("name")', ["peter", "josh"]),
    ('g.V().values("name").order(incr).range(1,2)', ["lop", "marko"]),
    ('g.V().values("name").order(incr).skip(4)', ["ripple", "vadas"]),
    ('g.V().values("name").order(decr)', ["vadas", "ripple", "peter", "marko", "lop", "josh"]),
    ('g.V().order(label,decr).values("name").limit(2)', ["ripple", "lop"]),
    ('g.E().order("weight").values("weight").limit(3)', [0.2, 0.4, 0.4]),
    ('g.V().hasLabel("person").order("name").has("age",gt(28)).values("name")', ["josh", "marko", "peter"]),
]
WRONG = {
    "g.V().foo()": "unexpected step",
    'g.V().has("nokey")': "unexpected key: nokey; expected one of: name, age, lang",
    'g.V().hasLabel("robot")': "unexpected label: robot; expected one of: person, software",
    'g.V().out("likes")': "unexpected label",
    'g.V().values("name").sum()': "expect number input",
    "g.V().inV()": "expect edge input",
    "g.E().out()": "expect vertex input",
    'g.V().values("name").has("age")': "expect vertex/edge input",
    "g.V().is(3)": "unexpected input type for is",
    'g.V().as("a").as("a")': "duplicated key",
    "g.V().union(count(),label())": "expect same output type in sub queries",
    "g.V().coin(2)": "0.0, 1.0",
    'g.V().values("name","age")': "expect same type of key in values",
    'g.V().has("age",within("a","b"))': "predicate type not match",
    'g.V().has("age",inside(1))': "two parameters",
    'g.V().has("age",lt(1,2))': "one parameter",
    'g.V().select("a")': "unexpected label step",
    'g.V().as("a").count().select("a")': "forgotten",
    'g.V().where(within("x"))': "unexpected key: x",
    'g.V().cap("x")': "unexpected key: x",
    'g.V().dedup("x")': "unexpected label step",
    "g.V().where(cap())": "cap inside",
    "g.V().range(1)": "two parameters",
    "g.V().limit(-1)": "negative",
    "g.V().count(1)": "no parameter",
    "g.V().": "empty query",
    "V().count()": "a query begins with",
    "g.V().count(": "parentheses not balanced",
    "g.V().count() x": "unexpected words at the end",
    'g.V().has("name",)': "unexpected ','",
    "g.V()count()": "unexpected words",
    "g.V().order(incr,label,label)": "at most one key",
    "g.V().out(in())": "edge label",
}


@pytest.mark.parametrize(("query", "want"), BAGS)
def test_bags(toy, query, want):
    assert sorted(shown(toy.traverse(query)), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("query", "want"), IN_ORDER)
def test_in_order(toy, query, want):
    assert shown(toy.traverse(query)) == want


@pytest.mark.parametrize("query", WRONG)
def test_wrong(toy, query):
    with pytest.raises(TraversalError) as e:
        toy.traverse(query)
    assert WRONG[query] in str(e.value)


def test_edges_as_results(toy):
    rows = toy.traverse('g.V().has("name","marko").outE("knows")').collect()
    assert sorted((r.value, r.src, r.dst, r.label) for r in rows) == [((2 << 26) | 1, 1, 2, "knows"), ((4 << 26) | 1, 1, 4, "knows")]


def test_fluent(toy):
    from weft.plans.language import P, decr, label, sub

    by_hand = [
        (toy.V().has("age", P.gt(28)).out("created").values("name"), 'g.V().has("age",gt(28)).out("created").values("name")'),
        (toy.V().not_(sub.out()).count(), "g.V().not(out()).count()"),
        (toy.V().as_("a").in_("created").where(P.neq("a")).group(label, "name"), 'g.V().as("a").in("created").where(neq("a")).group(label,"name")'),
        (toy.V().values("name").order(decr).limit(2), 'g.V().values("name").order(decr).limit(2)'),
    ]
    for made, text in by_hand:
        assert sorted(shown(made.frame()), key=str) == sorted(shown(toy.traverse(text)), key=str)
    with pytest.raises(AttributeError):
        toy.V().nothing()
    with pytest.raises(TraversalError):
        sub.query()

"""Before a dedup equal traversers are merged where they would multiply, and only where nothing counts them."""

import pytest

from interpreter import answer
from weft.catalogue import CATALOGUE
from weft.plans import compiler
from weft.plans.language import parse
from weft.sources.tables import from_tables


def merges(graph, query):
    return graph.traverse(query)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [cur#")


def test_traversers_of_a_nation_do_not_meet_each_of_its_suppliers(spark):
    """Customers times suppliers of a nation are 432 million at sixty times sf0.1."""
    graph = from_tables(spark, "/root/testdata/sf0.001")
    query = CATALOGUE["where_within"][0]
    assert "aggregate" in query and merges(graph, query) >= 3
    inner = query.replace(".dedup()", "")
    assert merges(graph, inner) == 0


@pytest.mark.parametrize(
    "query",
    [
        'g.V().both().both().dedup().count()',
        'g.V().both().both().count()',
        'g.V().both().dedup().both().count()',
        'g.V().both().union(out(),in()).out().dedup().count()',
        'g.V().both().union(out().count(),in().count()).dedup()',
        'g.V().both().outE().inV().in().dedup().values("name")',
        'g.V().where(both().both().dedup().count().is(gt(2))).values("name")',
        'g.V().both().both().count().dedup()',
    ],
)
def test_against_loops(toy, query):
    got = [r[0] for r in toy.traverse(query).collect()]
    assert sorted(map(str, got)) == sorted(map(str, answer(parse(query)))), query


@pytest.mark.parametrize(
    "query",
    [
        'g.V().out().aggregate("x").in().where(within("x")).dedup()',
        'g.V().out().aggregate("x").in().out().dedup().cap("x")',
        'g.V().out().as("a").in().dedup("a").count()',
    ],
)
def test_side_effects_and_memories_as_without_merging(toy, monkeypatch, query):
    merged = toy.traverse(query).collect()
    monkeypatch.setattr(compiler, "_once", lambda s: s)
    assert sorted(map(str, merged)) == sorted(map(str, toy.traverse(query).collect()))

"""The plans are those one would want: pruned scans, semi joins, top-k without a sort of everything."""

import re

import pytest

from weft.sources.tables import from_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    return from_tables(spark, SF)


def plan(graph, query):
    return graph.traverse(query)._jdf.queryExecution().executedPlan().toString()


def scans(text):
    return [m for m in re.findall(r"FileScan parquet \[([^\]]*)\]", text)]


def test_a_label_reads_one_table_and_the_columns_needed(graph):
    text = plan(graph, 'g.V().hasLabel("order").has("status","F").values("priority")')
    assert [re.sub(r"#\d+L?", "", s) for s in scans(text)] == ["o_orderstatus,o_orderpriority"]
    assert "EqualTo(o_orderstatus,F)" in text and "Exchange" not in text


def test_a_key_reads_only_tables_that_have_it(graph):
    assert len(scans(plan(graph, 'g.V().has("size",gt(3)).count()'))) == 1
    assert len(scans(plan(graph, 'g.V().hasKey("name").count()'))) == 5


def test_edges_lead_to_known_labels(graph):
    text = plan(graph, 'g.V().hasLabel("customer").out("placed").values("status")')
    assert len(scans(text)) == 3 and "Union" not in text
    assert len(scans(plan(graph, 'g.V().hasLabel("customer").out("placed").hasLabel("order").count()'))) == 2


def test_edges_need_no_join_for_their_ends_and_properties(graph):
    text = plan(graph, 'g.E().hasLabel("contains").has("quantity",gt(45.0)).inV()')
    assert "Join" not in text and "GreaterThan(l_quantity,45.0)" in text


def test_filters_are_semi_and_anti_joins(graph):
    assert "LeftSemi" in plan(graph, 'g.V().hasLabel("customer").where(out("placed"))')
    assert "LeftAnti" in plan(graph, 'g.V().hasLabel("customer").not(out("placed"))')
    assert "Join" not in plan(graph, 'g.V().hasLabel("customer").not(has("mktsegment","BUILDING"))')


def test_order_and_limit_are_a_top_k(graph):
    text = plan(graph, 'g.V().hasLabel("part").values("size").order(decr).limit(5)')
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_nothing_is_a_cross_join_or_python(graph):
    from weft.catalogue import CATALOGUE

    for name, (query, _) in CATALOGUE.items():
        text = plan(graph, query)
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas", text), name


def test_labels_of_documents_are_joined_only_when_asked_for(graph):
    assert "Join" not in plan(graph, 'g.V().hasLabel("document").has("lang","en").count()')
    assert "Join" in plan(graph, 'g.V().hasLabel("document").has("toxic",1).count()')


def test_skip_brings_no_more_than_the_skipped_rows_to_one_task(graph):
    text = plan(graph, 'g.V().hasLabel("part").values("size").order(incr).skip(5)')
    assert "TakeOrderedAndProject" in text and "Offset" not in text and "SinglePartition" not in text


def test_all_labels_of_a_file_are_one_scan(spark, toy_files):
    from weft.sources.files import from_files

    g = from_files(spark, toy_files)
    for query in ("g.V().label()", 'g.V().has("age",gt(3))', "g.E()", 'g.E().hasLabel("knows","created").inV()'):
        assert plan(g, query).count("FileScan text") == 1, query
    assert sorted(r.value for r in g.traverse("g.V().label().dedup()").collect()) == ["person", "software"]

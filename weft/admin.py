"""BuildIndex and SetConfig, and commands as text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.plans.compiler import compile_query
from weft.schema import TraversalError

OPTIONS = ("caching", "core_bind", "expert_division", "step_reorder", "indexing", "stealing", "data_size")
_SPARK_DOES = ("core_bind", "expert_division", "step_reorder", "indexing", "stealing", "data_size")
_YES, _NO = ("y", "t", "yes", "true", "enable"), ("n", "f", "no", "false", "disable")


def build_index(graph: Graph, element: str, key: str) -> DataFrame:
    """Counts the elements with the key and its values, and remembers them; once more switches the index off or on.

    Spark needs no index: filters reach the Parquet scan, whose row groups have statistics. Results never change.
    """
    if element not in ("V", "E"):
        raise TraversalError("expect V or E in BuildIndex")
    edge = element == "E"
    if key != "label":
        graph.schema.key(key, edge)
    name = (element, key)
    if name not in graph.indexes:
        frame = graph.edges()[0] if edge else graph.vertices()
        column = F.col(f"edge.{key}") if edge else F.col(f"a_{key}")
        row = frame.agg(F.count(F.lit(1)).alias("total"), F.count(column).alias("with_key"), F.approx_count_distinct(column).alias("values")).first()
        graph.indexes[name] = {"enabled": False, **row.asDict()}
    index = graph.indexes[name]
    index["enabled"] = not index["enabled"]
    said = f"{element} index of {key} {'enabled' if index['enabled'] else 'disabled'}: {index['with_key']} of {index['total']} elements have it, about {index['values']} values"
    return graph.spark.createDataFrame([(said,)], "value string")


def set_config(graph: Graph, name: str, value: str) -> DataFrame:
    """Sets an option and shows all. ``caching`` persists the arms of the graph; what Spark decides itself has no effect."""
    if name not in OPTIONS:
        raise TraversalError(f"unexpected config: {name}; expected one of: {', '.join(OPTIONS)}")
    low = value.strip().lower()
    if name == "data_size":
        if not low.isdigit():
            raise TraversalError("expect a number for data_size")
        graph.options[name] = int(low)
    elif low in (*_YES, *_NO) or low.isdigit():
        on = low in _YES or low.isdigit() and int(low) > 0
        if name == "caching" and on and not graph.options["caching"]:
            held = graph.persist()
            graph.vertex_arms, graph.edge_arms, graph.one_scan = held.vertex_arms, held.edge_arms, held.one_scan
        graph.options[name] = on
    else:
        raise TraversalError(f"unexpected value: {value}")
    rows = [(f"{k}: {v}" + (" (decided by Spark)" if k in _SPARK_DOES else ""),) for k, v in graph.options.items()]
    return graph.spark.createDataFrame(rows, "value string")


def execute(graph: Graph, text: str) -> DataFrame:
    """A traversal or an admin command."""
    if m := re.fullmatch(r"\s*(BuildIndex|SetConfig)\s*\(([^,()]*),([^,()]*)\)\s*", text):
        args = [x.strip().strip("\"'") for x in m.groups()[1:]]
        return build_index(graph, *args) if m[1] == "BuildIndex" else set_config(graph, *args)
    return compile_query(graph, text)

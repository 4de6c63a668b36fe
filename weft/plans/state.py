"""What a traversal is at one step: a DataFrame of traversers and what is known about its columns.

Columns: ``cur`` (vertex id, edge struct, or scalar), ``h_<name>`` (remembered values), ``s<n>_*`` (the key of the
enclosing filter branch), ``o_*`` (sort keys), and ``a_*`` (attributes of the current vertex, if attached).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.schema import TYPES, TraversalError

VERTEX, EDGE, COLLECTION = "vertex", "edge", "collection"
ELEMENTS = (VERTEX, EDGE)


@dataclass(frozen=True)
class Memory:
    """The kind of a remembered value, and the labels it can have if it is a vertex."""

    kind: str
    labels: frozenset[str] | None = None


@dataclass(frozen=True)
class Context:
    """What all parts of one query share: the graph, the side effects by name, and whether a ``cap`` shows them."""

    graph: Graph
    effects: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    capped: bool = True


@dataclass(frozen=True)
class State:
    context: Context
    frame: DataFrame
    kind: str
    labels: frozenset[str] | None = None
    attached: bool = False
    history: tuple[tuple[str, Memory], ...] = ()
    forgotten: frozenset[str] = frozenset()
    scope: tuple[str, ...] = ()
    scope_keys: DataFrame | None = None
    order: tuple[tuple[str, bool], ...] = ()
    in_filter: bool = False
    unstable: bool = False
    #: How many scans the plan has, about. A filter branch reads its traversers once more.
    weight: int = 1

    @property
    def graph(self) -> Graph:
        return self.context.graph

    @property
    def remembered(self) -> dict[str, Memory]:
        return dict(self.history)

    def recall(self, name: str) -> Memory:
        if name not in self.remembered:
            gone = " (forgotten by an aggregation)" if name in self.forgotten else ""
            raise TraversalError(f"unexpected label step: {name}{gone}; expected one of: {', '.join(self.remembered) or 'none'}")
        return self.remembered[name]

    def carried(self, *without: str) -> list[str]:
        """The columns beside ``cur`` that map-like steps keep."""
        return [c for c in (*(f"h_{n}" for n, _ in self.history), *self.scope, *(o for o, _ in self.order)) if c not in without]

    def element(self, step: str) -> bool:
        """True for edges; an error for what is no element."""
        if self.kind not in ELEMENTS:
            raise TraversalError(f"expect vertex/edge input for {step}")
        return self.kind == EDGE

    def attach(self) -> State:
        """The attributes of the current vertex as columns: one join, from which Catalyst prunes what no step reads."""
        if self.kind != VERTEX or self.attached:
            return self
        v = self.graph.vertices(self.labels)
        return replace(self, frame=self.frame.join(v, self.frame["cur"] == v["vid"]).drop("vid"), attached=True)

    def bare(self) -> State:
        """Without attributes."""
        return replace(self, frame=self.frame.select("cur", *self.carried()), attached=False)

    def light(self, most: int = 4) -> State:
        """Itself, or, where the plan has grown, with its traversers kept in memory or on disk: chained filter branches
        would double the plan each time."""
        if self.weight <= most:
            return self
        bare = self.bare()
        return replace(bare, frame=bare.frame.persist(), weight=1)

    def property(self, key: str) -> Column:
        """A property of the current element; of a vertex, once attached."""
        self.graph.schema.key(key, self.kind == EDGE)
        return F.col("cur").getField(key) if self.kind == EDGE else F.col(f"a_{key}")

    def label(self) -> Column:
        return F.col("cur").getField("label") if self.kind == EDGE else F.col("a_label")

    def value(self, column: Column, kind: str, labels: frozenset[str] | None = None, where: Column | None = None) -> State:
        """Another current value for each traverser."""
        frame = self.frame.select(column.alias("cur"), *self.carried())
        return replace(self, frame=frame if where is None else frame.where(where), kind=kind, labels=labels, attached=False)

    def keep(self, condition: Column) -> State:
        return replace(self, frame=self.frame.where(condition))


def type_of(schema_type: str) -> str:
    return TYPES[schema_type]

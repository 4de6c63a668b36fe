"""What a graph may hold: labels, property keys and their types."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Types of property values and their Spark types; a character is a string of length one.
TYPES = {"int": "int", "double": "double", "char": "string", "string": "string", "long": "bigint"}
CODES = {1: "int", 2: "double", 3: "char", 4: "string"}


class TraversalError(ValueError):
    """A traversal that cannot be compiled."""


@dataclass(frozen=True)
class Schema:
    """Key types, the same for every label, in the order of the keys; the labels of vertices and edges."""

    vertex_keys: dict[str, str] = field(default_factory=dict)
    edge_keys: dict[str, str] = field(default_factory=dict)
    vertex_labels: tuple[str, ...] = ()
    edge_labels: tuple[str, ...] = ()

    def keys(self, edge: bool) -> dict[str, str]:
        return self.edge_keys if edge else self.vertex_keys

    def labels(self, edge: bool) -> tuple[str, ...]:
        return self.edge_labels if edge else self.vertex_labels

    def key(self, name: str, edge: bool) -> str:
        if name not in self.keys(edge):
            raise TraversalError(f"unexpected key: {name}; expected one of: {', '.join(self.keys(edge)) or 'none'}")
        return self.keys(edge)[name]

    def label(self, name: str, edge: bool) -> str:
        if name not in self.labels(edge):
            raise TraversalError(f"unexpected label: {name}; expected one of: {', '.join(self.labels(edge)) or 'none'}")
        return name


def common(types: list[str]) -> str | None:
    """The one type that values of these types can share without a change of meaning."""
    if len(set(types)) == 1:
        return types[0]
    return None

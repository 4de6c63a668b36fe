"""A property graph as two sets of lazy DataFrames, one arm per label, so that a label filter prunes whole scans."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.schema import TYPES, Schema


@dataclass(frozen=True)
class VertexArm:
    """Vertices of one label: ``vid`` and a column per property key. The table is opened when a query first needs it."""

    label: str
    frame: Callable[[], DataFrame]
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class EdgeArm:
    """Edges of one label: ``src``, ``dst`` and properties. ``ends`` are the labels of source and destination, if known."""

    label: str
    frame: Callable[[], DataFrame]
    keys: tuple[str, ...] = ()
    ends: tuple[str | None, str | None] = (None, None)


@dataclass
class Graph:
    spark: SparkSession
    schema: Schema
    vertex_arms: list[VertexArm]
    edge_arms: list[EdgeArm]
    options: dict = field(default_factory=lambda: {"caching": False, "core_bind": False, "expert_division": False, "step_reorder": True, "indexing": True, "stealing": False, "data_size": 524288})
    indexes: dict = field(default_factory=dict)
    seed: int = 42
    #: Where all labels lie in the same files: vertices (vid, label, keys) and edges (src, dst, label, keys) in one scan.
    one_scan: tuple[Callable[[], DataFrame], Callable[[], DataFrame]] | None = None

    def _typed(self, keys: Iterable[str], edge: bool, own: tuple[str, ...], prefix: str) -> list[Column]:
        types = self.schema.keys(edge)
        return [(F.col(k) if k in own else F.lit(None)).cast(TYPES[types[k]]).alias(f"{prefix}{k}") for k in keys]

    def vertices(self, labels: frozenset[str] | None = None) -> DataFrame:
        """vid, a_label and a_<key> of the vertices with these labels (all, if None)."""
        arms = [a for a in self.vertex_arms if labels is None or a.label in labels]
        keys = list(self.schema.vertex_keys)
        if self.one_scan and len(arms) > 1:
            found = self.one_scan[0]().where(F.col("label").isin([a.label for a in arms]))
            return found.select(F.col("vid").cast("long"), F.col("label").alias("a_label"), *self._typed(keys, False, tuple(keys), "a_"))
        frames = [a.frame().select(F.col("vid").cast("long"), F.lit(a.label).alias("a_label"), *self._typed(keys, False, a.keys, "a_")) for a in arms]
        if not frames:
            fields = ", ".join(["vid long", "a_label string", *(f"a_{k} {TYPES[t]}" for k, t in self.schema.vertex_keys.items())])
            return self.spark.createDataFrame([], fields)
        return _union(frames)

    def edges(self, label: str | None = None, ends: tuple[frozenset | None, frozenset | None] = (None, None)) -> tuple[DataFrame, tuple[frozenset | None, frozenset | None]]:
        """(e_src, e_dst and the edge as a struct; the labels that sources and destinations can have)."""
        fits = lambda own, want: own is None or want is None or own in want
        arms = [a for a in self.edge_arms if label in (None, a.label) and fits(a.ends[0], ends[0]) and fits(a.ends[1], ends[1])]
        keys = list(self.schema.edge_keys)
        if self.one_scan and len(arms) > 1:
            found = self.one_scan[1]().where(F.col("label").isin([a.label for a in arms]))
            frames = [self._edge(found, F.col("label"), keys, tuple(keys))]
        else:
            frames = [self._edge(a.frame(), F.lit(a.label), keys, a.keys) for a in arms]
        reach = tuple(None if any(a.ends[k] is None for a in arms) else frozenset(a.ends[k] for a in arms) for k in (0, 1))
        if not frames:
            props = "".join(f", {k}: {TYPES[t]}" for k, t in self.schema.edge_keys.items())
            return self.spark.createDataFrame([], f"e_src long, e_dst long, edge struct<src: bigint, dst: bigint, label: string{props}>"), reach
        return _union(frames), reach

    def _edge(self, rows: DataFrame, label: Column, keys: list[str], own: tuple[str, ...]) -> DataFrame:
        src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
        edge = F.struct(src.alias("src"), dst.alias("dst"), label.alias("label"), *self._typed(keys, True, own, ""))
        return rows.select(src.alias("e_src"), dst.alias("e_dst"), edge.alias("edge"))

    def persist(self) -> Graph:
        """A graph whose arms stay in memory or on local disk after first use."""
        held = lambda arms: [replace(a, frame=cache(lambda a=a: a.frame().persist())) for a in arms]
        return replace(self, vertex_arms=held(self.vertex_arms), edge_arms=held(self.edge_arms), one_scan=None)

    def having(self, key: str) -> frozenset[str]:
        """The labels whose vertices can have the key."""
        return frozenset(a.label for a in self.vertex_arms if key in a.keys)

    def traverse(self, query) -> DataFrame:
        """The result of a traversal, given as text or built by ``V()`` or ``E()``."""
        from weft.plans.compiler import compile_query

        return compile_query(self, query)

    def V(self):  # noqa: N802
        from weft.plans.language import Fluent

        return Fluent("V", (), self)

    def E(self):  # noqa: N802
        from weft.plans.language import Fluent

        return Fluent("E", (), self)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

"""Closed-loop benchmark: a mix of query templates kept at a fixed parallelism for a time.

The file has ``seconds parallelism templates`` in its first line, then for each template a line with the text, in which
``$RAND`` stands for a random value of a key, and tab-separated the element (V or E), that key and the share of the mix.
"""

from __future__ import annotations

import random
import time
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark.sql import functions as F

from weft.admin import execute
from weft.graph import Graph
from weft.schema import TraversalError


@dataclass(frozen=True)
class Template:
    text: str
    element: str
    key: str
    share: float


def read_mix(lines: list[str]) -> tuple[float, int, list[Template]]:
    head = lines[0].split()
    if len(head) != 3:
        raise TraversalError("expect: seconds parallelism templates")
    rows = [x.rstrip("\n").split("\t") for x in lines[1:] if x.strip()]
    if len(rows) != int(head[2]) or any(len(r) != 4 for r in rows):
        raise TraversalError(f"expect {head[2]} lines of text, element, key and share")
    return float(head[0]), int(head[1]), [Template(t, e, k, float(s)) for t, e, k, s in rows]


def random_values(graph: Graph, element: str, key: str, n: int = 100) -> list:
    """Up to n distinct values of a key, drawn with the graph's seed."""
    frame, column = (graph.edges()[0], F.col(f"edge.{key}")) if element == "E" else (graph.vertices(graph.having(key)), F.col(f"a_{key}"))
    rows = frame.select(column.alias("v")).where("v is not null").distinct().orderBy(F.rand(graph.seed), "v").limit(n).collect()
    return [r.v for r in rows]


def emulate(graph: Graph, lines: list[str]) -> dict:
    """Throughput, and for each template its count and 25 points of the latency distribution."""
    seconds, parallelism, templates = read_mix(lines)
    draw = random.Random(graph.seed)
    values = {t: random_values(graph, t.element, t.key) for t in templates if "$RAND" in t.text}
    taken: dict[Template, list[float]] = {t: [] for t in templates}

    def one(t: Template, text: str) -> tuple[Template, float]:
        began = time.perf_counter()
        execute(graph, text).collect()
        return t, time.perf_counter() - began

    def begin(pool: ThreadPoolExecutor):
        t = draw.choices(templates, [x.share for x in templates])[0]
        v = draw.choice(values[t]) if values.get(t) else ""
        return pool.submit(one, t, t.text.replace("$RAND", f'"{v}"' if isinstance(v, str) else str(v)))

    began = time.perf_counter()
    with ThreadPoolExecutor(parallelism) as pool:
        running = {begin(pool) for _ in range(parallelism)}
        while running:
            done, running = wait(running, return_when=FIRST_COMPLETED)
            for f in done:
                t, took = f.result()
                taken[t].append(took)
                if time.perf_counter() - began < seconds:
                    running.add(begin(pool))
    spent, total = time.perf_counter() - began, sum(map(len, taken.values()))
    points = lambda x: [sorted(x)[min(len(x) - 1, k * len(x) // 25)] for k in range(25)] if x else []
    return {"queries_per_second": total / spent, "queries": total, "templates": [{"text": t.text, "count": len(x), "latency": points(x)} for t, x in taken.items()]}

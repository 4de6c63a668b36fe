"""python -m weft.cli --tables DIR | --files DIR | --graph DIR  [-q QUERY | -f FILE | -b DIR] [-o OUTPUT]"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from weft.admin import OPTIONS, execute
from weft.emulator import emulate
from weft.functions.render import lines
from weft.graph import Graph
from weft.plans.language import PREDICATES, STEPS
from weft.schema import TraversalError
from weft.sources.files import from_files, read_graph
from weft.sources.tables import from_tables

HELP = {
    "": "a traversal, BuildIndex(V|E, key), SetConfig(name, value), emu <file>, help [index|config|emu|steps], quit",
    "index": "BuildIndex(V|E, key|label): statistics of a key; once more switches it off",
    "config": f"SetConfig(name, y|n|number), names: {', '.join(OPTIONS)}",
    "emu": "emu <file>: 'seconds parallelism templates', then per template: text, V|E, key of $RAND, share, tab-separated",
    "steps": f"steps: {', '.join(sorted(STEPS))}; predicates: {', '.join(sorted(PREDICATES))}",
}


def answer(graph: Graph, text: str) -> list[str]:
    """The lines to show for a command; an error is shown, not raised."""
    text = text.strip()
    began = time.perf_counter()
    try:
        if text == "help" or text.startswith("help "):
            return [HELP.get(text[4:].strip(), HELP[""])]
        if text.startswith("emu "):
            return [json.dumps(emulate(graph, Path(text[4:].strip()).read_text().splitlines()))]
        found = [f"=>{r.line}" for r in lines(execute(graph, text)).toLocalIterator()] or ["=>Empty"]
    except TraversalError as e:
        return [f"error: {e}"]
    return [*found, f"[{(time.perf_counter() - began) * 1000:.0f} ms]"]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weft", description=__doc__)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables"), source.add_argument("--files"), source.add_argument("--graph")
    p.add_argument("-q", action="append", default=[], help="a query"), p.add_argument("-f", help="a file with a query in each line")
    p.add_argument("-b", help="a folder of such files"), p.add_argument("-o", help="write what is shown to this file")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("weft").getOrCreate()
    graph = from_tables(spark, a.tables) if a.tables else from_files(spark, a.files) if a.files else read_graph(spark, a.graph)
    files = [a.f] if a.f else sorted(map(str, Path(a.b).iterdir())) if a.b else []
    texts = [*a.q, *(x for f in files for x in Path(f).read_text().splitlines() if x.strip())]
    batch = bool(texts)
    out = open(a.o, "w") if a.o else sys.stdout  # noqa: SIM115
    try:
        while True:
            if batch and not texts:
                return 0
            text = texts.pop(0) if batch else input("weft> ")
            if text.strip() in ("quit", "exit"):
                return 0
            if text.strip():
                print(*answer(graph, text), sep="\n", file=out, flush=True)
    except EOFError:
        return 0
    finally:
        if a.o:
            out.close()


if __name__ == "__main__":
    sys.exit(main())

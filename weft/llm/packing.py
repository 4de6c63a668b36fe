"""Hierarchical residual packing of documents into sequences.

Documents are tokenized where they lie; what is kept of them are thin rows, one per piece: id, place, length, digest.
Pieces of full length are sequences of their own. Round 0: the others are dealt by hash to nodes of about ``node_rows``
pieces, so that every node gets the same mix of lengths however the input was sorted, and each node packs best-fit,
longest first. Bins with less than ``slack`` tokens left are done. Later rounds merge ``fan_in`` nodes into one and pack
their underfull bins, as items, best-fit again, until one node is left. After best-fit any two bins of a node hold more
than one sequence together, so at most one of them is half full or less: only that one and the ``carry`` emptiest others
go up; the rest is written as it stands. So no task ever gets more than ``fan_in * (carry + 1)`` bins, and no piece is
ever left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import keep, table, text_of
from weft.llm.tokens import default_vocabulary, encoded

NODE_ROWS = 1 << 17
_PIECE = np.dtype([("doc", "<i8"), ("no_id", "?"), ("piece", "<i8"), ("start", "<i8"), ("length", "<i4"), ("crc", "<i8")])
_BIN = "node int, seq long, fill int, done boolean, members binary"
_BIN_ARROW = pa.schema({"node": pa.int32(), "seq": pa.int64(), "fill": pa.int32(), "done": pa.bool_(), "members": pa.binary()})
_THIN = pa.schema({"node": pa.int32(), "doc": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "crc": pa.int64()})
_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indexes; longest first, each into the fullest bin that has room, ties by index."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has r tokens left
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _rows_of(pieces: np.ndarray, seq: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(pieces["doc"], mask=pieces["no_id"]), *(pa.array(pieces[c].astype(k)) for c, k in (("piece", "i4"), ("start", "i8"), ("length", "i8"), ("crc", "i8"))), pa.array(seq), pa.array(offset)]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _OUT.split(", ")])


def _packed(items: list[np.ndarray], fills: list[int], node: int, level: int, capacity: int, slack: int, carry: int | None) -> Iterator[pa.RecordBatch]:
    bins = best_fit(fills, capacity)
    fill = [sum(fills[i] for i in b) for b in bins]
    open_ = sorted((k for k in range(len(bins)) if capacity - fill[k] >= slack), key=fill.__getitem__)
    up = set() if carry is None else set(open_[: carry + 1])
    for at in range(0, len(bins), 5000):
        some = range(at, min(at + 5000, len(bins)))
        rows = [[node] * len(some), [level << 56 | node << 28 | k for k in some], [fill[k] for k in some], [k not in up for k in some], [b"".join(items[i].tobytes() for i in bins[k]) for k in some]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _BIN_ARROW, strict=True)], schema=_BIN_ARROW)


def pieces_of(docs: DataFrame, *, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; texts are tokenized in place, nothing is shuffled."""

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, at in encoded(batches, vocabulary, end_id):
            rows = np.array([(r, k, s, n) for r, total in enumerate(np.diff(at).tolist()) for k, (s, n) in enumerate(cut(total, capacity))], np.int64).reshape(-1, 4)
            raw, begin = memoryview(tokens.astype("<u4").tobytes()), 4 * (at[rows[:, 0]] + rows[:, 2])
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * rows[:, 3]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[:, 0])), pa.array(rows[:, 1].astype("i4")), pa.array(rows[:, 2]), pa.array(rows[:, 3]), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t"))
    return rows.mapInArrow(tokenized, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, *, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", slack: int = 16, fan_in: int = 8, carry: int = 1024, node_rows: int = NODE_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; only documents over the capacity are cut. Null text: empty, a piece of one
    token. Null ids are allowed, and rows that repeat an id are packed each for itself. Other columns are ignored. An
    empty table gives an empty result.
    """
    pieces = keep(pieces_of(docs, vocabulary=vocabulary, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "op10-pieces")
    full, short = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    nodes = max(1, -(-short.count() // node_rows))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, _THIN).sort_by([(c, "ascending") for c in ("node", "doc", "piece", "start", "length", "crc")])
        own = np.empty(rows.num_rows, _PIECE)
        own["no_id"] = rows["doc"].is_null()
        for c in ("doc", "piece", "start", "length", "crc"):
            own[c] = rows[c].fill_null(0)
        node = rows["node"].to_numpy()
        cuts = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else []
        for a, b in zip(cuts, [*cuts[1:], len(node)], strict=False):
            yield from _packed(np.split(own[a:b], b - a), own["length"][a:b].tolist(), int(node[a]), 0, capacity, slack, carry)

    dealt = short.select(F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(nodes)).cast("int").alias("node"), F.col("doc_id").alias("doc"), "piece", "start", "length", F.col("ids_crc32").alias("crc"))
    bins = keep(dealt.repartition(nodes, "node").mapInArrow(local, _BIN), "op10-round-0")
    level, done = 0, [bins.where("done")]
    while True:
        nodes, level, last = -(-nodes // fan_in), level + 1, nodes <= fan_in

        def merge(batches: Iterator[pa.RecordBatch], level: int = level, last: bool = last) -> Iterator[pa.RecordBatch]:
            own, items, fills = None, [], []
            for batch in batches:
                for node, fill, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if node != own and items:
                        yield from _packed(items, fills, own, level, capacity, slack, None if last else carry)
                        items, fills = [], []
                    own = node
                    items.append(np.frombuffer(members, _PIECE))
                    fills.append(fill)
            if items:
                yield from _packed(items, fills, own, level, capacity, slack, None if last else carry)

        left = bins.where("not done").withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
        left = left.repartition(nodes, "node").sortWithinPartitions("node", F.desc("fill"), "seq").select("node", "fill", "members")
        bins = keep(left.mapInArrow(merge, _BIN), f"op10-round-{level}")
        done.append(bins.where("done"))
        if last:
            break

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                each = [np.frombuffer(m, _PIECE) for m in part.column(1).to_pylist()]
                if each:
                    offset = np.concatenate([np.cumsum(e["length"], dtype="i8") - e["length"] for e in each])
                    yield _rows_of(np.concatenate(each), np.repeat(np.array(part.column(0)), [len(e) for e in each]), offset)

    everything = done[0]
    for more in done[1:]:
        everything = everything.unionByName(more)
    alone = full.select("*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return everything.select("seq", "members").mapInArrow(members, _OUT).unionByName(alone)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary=default_vocabulary())

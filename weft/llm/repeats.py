"""Removal of byte strings that repeat from documents with smaller ids.

Depth-limited radix sort on sampled suffixes. To order all suffixes through ``DEPTH`` bytes, a record for each byte of the
corpus would be shuffled. Instead suffixes are sampled where the text itself says so: of the 33 places in a window of
50 bytes where 18 bytes begin, the one with the smallest hash is an anchor. Equal windows have equal anchors, so the sort
of anchors finds every repeated window, with one record for about 17 bytes. Four passes go from the most significant
digit to the full depth, and groups of one leave after each:

1. the 18 bytes at the anchor;
2. its context, the 82 bytes that all windows over the anchor lie in: where it is that of the smallest document, all
   these windows repeat, and nothing more is asked;
3. at the remaining anchors, where contexts differ, 16 bytes more on either side: each window has one of the two;
4. the windows of 50 bytes on the sides that are left.

Digits are 64-bit hashes (48 bits in the first pass, whose groups later passes split again). Each pass combines in the
input part first: a part sends one record for each digit it has, with its smallest document, so a passage that a third of all
documents share is one record per part. Answers go back to the part as one file under the shared
folder; what a pass has shuffled is deleted when it ends. Anchors are looked for once and lie beside the texts, as a byte
for each: the gap to the one before. What meets at a key's bucket is cut by where it came from in one go, so that time is
linear in the records, however many partitions there are.

A Python worker's memory is to depend neither on the size of the table nor on how it is partitioned: a part is ``CHUNK``
bytes of text of one input partition, and the rest of its last text; its questions leave it in blocks of ``BLOCK`` records, and the
number of buckets comes from the bytes of text, with more in the last pass, which can have a record for each byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import file_system, put_whole, scratch, shuffles_freed, table, tasks, text_of
from weft.llm.words import _powers_to, mix, series, slices

DEPTH, GRAM = 50, 18
WIDTH = DEPTH - GRAM + 1
SIDE = (DEPTH - GRAM) // 2
_LOW = np.uint64((1 << 48) - 1)
_VALUES = series(256, 21)
_NO_ID = np.iinfo(np.int64).min
#: Bytes of text of a part, and of what is unpacked at once; records that a part sends together.
CHUNK, UNPACKED, BLOCK = 8 << 20, 4 << 20, 1 << 21
#: Bytes of text for each bucket, where there is a record for about 17 bytes, and where there can be one for each.
SPARSE, DENSE = 32 << 20, 4 << 20


def _sliding(x: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """best of x[i : i + width] for each i."""
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


class Part:
    """Some documents as one run of bytes, with anchors; places are in the run. ``gaps``: what ``gaps()`` gave for each document."""

    def __init__(self, docs: list[bytes], ids: np.ndarray, gaps: list[bytes] | None = None):
        self.ids, self.at = ids, np.cumsum([0, *map(len, docs)])
        self.data = np.frombuffer(b"".join(docs), np.uint8)
        n = len(self.data)
        up, self.down = _powers_to(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[self.data] * up[:n], out=self.sums[1:])
        if gaps is None:
            self.anchors = self._anchors()
            self.owner = np.searchsorted(self.at, self.anchors, "right") - 1
        else:
            first = np.cumsum([0, *map(len, gaps)])
            way = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(gaps), np.uint8), dtype=np.int64)])
            self.owner = np.repeat(np.arange(len(docs)), np.diff(first))
            self.anchors = way[1:] + np.repeat(self.at[:-1] - way[first[:-1]], np.diff(first))
        self.keys = self.digest(self.anchors, self.anchors + GRAM) & _LOW
        self.begin = np.maximum(self.at[self.owner], self.anchors - WIDTH + 1)
        self.ends = np.minimum(self.at[self.owner + 1], self.anchors + DEPTH)

    def _anchors(self) -> np.ndarray:
        n = len(self.data)
        if n < DEPTH:
            return np.empty(0, np.int64)
        grams = np.arange(n - GRAM + 1)
        h = self.digest(grams, grams + GRAM)
        top = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)  # 0 marks the windows that cross documents
        low = _sliding(top, WIDTH, np.minimum)  # of each window
        crossing = self.at[1:-1]
        for c in np.unique(crossing[(crossing > 0) & (crossing < n)]):
            low[max(0, c - DEPTH + 1) : c] = 0
        most = _sliding(np.concatenate([np.zeros(WIDTH - 1, np.uint32), low, np.zeros(WIDTH - 1, np.uint32)]), WIDTH, np.maximum)
        return np.flatnonzero((most == top) & (most > 0))

    def gaps(self) -> list[bytes]:
        """For each document its anchors, each as the way from the one before or from the text's begin; under ``WIDTH`` + 1, as any window has one."""
        first = np.searchsorted(self.owner, np.arange(len(self.ids) + 1))
        before = np.concatenate([[0], self.anchors[:-1]]) if len(self.anchors) else self.anchors
        start = first[:-1][first[:-1] < first[1:]]
        before[start] = self.at[self.owner[start]]
        raw = (self.anchors - before).astype(np.uint8).tobytes()
        return [raw[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def contexts(self, some: np.ndarray) -> np.ndarray:
        return self.digest(self.begin[some], self.ends[some]) ^ (self.ends[some] - self.begin[some]).astype(np.uint64)

    def doc(self, some: np.ndarray) -> np.ndarray:
        return self.ids[self.owner[some]]


class Keys:
    """Sorted hashes, with the place where each of their first digits begins: a look-up reads a few places, not log n far apart."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys)
        n = len(keys)
        if n:
            bits = int(keys[-1]).bit_length()
            digits = min(bits, max(1, n.bit_length() - 1))
            self.shift, self.most = np.uint64(bits - digits), np.uint64(1 << digits)
            self.index = np.searchsorted(self.keys >> self.shift, np.arange((1 << digits) + 2, dtype=np.uint64)).astype(np.int32 if n < 1 << 31 else np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of wanted are among the keys, their places)."""
        n = len(self.keys)
        if not n or not len(wanted):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        digit = np.minimum(wanted >> self.shift, self.most).astype(np.int64)
        at, end = self.index[digit].astype(np.int64), self.index[digit + 1]
        if (end - at).max() > 64:  # hashes are even; other numbers need not be
            at = np.searchsorted(self.keys, wanted)
        else:
            left = np.flatnonzero(at < end)
            while len(left):
                left = left[self.keys[at[left]] < wanted[left]]
                at[left] += 1
                left = left[at[left] < end[left]]
        at = np.minimum(at, n - 1)
        return self.keys[at] == wanted, at


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, begin of groups of a key, group of each in order)."""
    order = np.argsort(keys)
    k = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return order, begin, np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))


class Resolved:
    """What pass 2 tells about a part's anchors."""

    def __init__(self, part: Part, answer: np.ndarray, keys: Keys):
        has, at = keys.find(part.keys)
        some = np.flatnonzero(has)
        context, doc, own = part.contexts(some), part.doc(some), answer[at[some]]
        self.gone = some[(context == own["context"]) & (doc > own["doc"])]
        left = (own["mixed"]) & ((context != own["context"]) | (doc <= own["doc"]))
        self.open, self.context = some[left], context[left]


def _sides(part: Part, anchors: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For either side of these anchors: (digit, is it whole, first and last start of the windows that have it)."""
    p, begin, end = part.anchors[anchors], part.at[part.owner[anchors]], part.at[part.owner[anchors] + 1]
    low, high = np.maximum(begin, p - WIDTH + 1), np.minimum(p, end - DEPTH)
    out = []
    for left, right, first, last, mark in ((0, SIDE, p - (DEPTH - GRAM - SIDE), p, 0), (SIDE, 0, p - WIDTH + 1, p - SIDE, 1)):
        a, b = p - left, p + GRAM + right
        ok = (a >= begin) & (b <= end)
        digit = part.digest(np.where(ok, a, p), np.where(ok, b, p)) ^ np.uint64(mark)
        out.append((digit, ok, np.maximum(first, low), np.minimum(last, high)))
    return out


def _inside(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of these ranges."""
    return np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0


def _windows(part: Part, anchors: np.ndarray, gone: np.ndarray, known: Keys) -> np.ndarray:
    """Starts of the windows over these anchors whose side more than one document has, and that do not lie in a context that goes anyway."""
    n, firsts, ends = len(part.data), [], []
    for digit, ok, first, last in _sides(part, anchors):
        some = ok & (first <= last)
        some[some] = known.find(digit[some])[0]
        firsts.append(first[some])
        ends.append(last[some] + 1)
    asked = _inside(np.concatenate(firsts), np.concatenate(ends), n)
    return np.flatnonzero(asked & ~_inside(part.begin[gone], part.ends[gone] - DEPTH + 1, n))


_FIRST = np.dtype([("key", "<u8"), ("many", "?")])
_SECOND = np.dtype([("key", "<u8"), ("doc", "<i8"), ("context", "<u8"), ("mixed", "?")])
_LAST = np.dtype([("key", "<u8"), ("doc", "<i8"), ("many", "?")])


def _packed(x: np.ndarray) -> bytes:
    """Column by column, which compresses better."""
    return b"".join(x[f].tobytes() for f in x.dtype.names)


def _unpacked(raw: bytes, kind: np.dtype) -> np.ndarray:
    n = len(raw) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for f in kind.names:
        size = kind[f].itemsize * n
        out[f] = np.frombuffer(raw[at : at + size], kind[f])
        at += size
    return out


def _answer(folder: str, step: int, part: int, kind: np.dtype) -> np.ndarray:
    fs, path = file_system(f"{folder}/answer-{step}/{part:08d}")
    if fs.get_file_info(path).type == FileType.NotFound:
        return np.empty(0, kind)
    with fs.open_input_stream(path) as file:
        return _unpacked(file.read(), kind)


def _small(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows, of the bytes of a column about ``UNPACKED`` in each batch."""
    for b in batches:
        for s in slices(pc.binary_length(b.column(column)).to_pylist(), UNPACKED):
            yield b.slice(s.start, len(s))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[Part]]]:
    """The columns are part, i, t and, if anchors are known, a."""

    def each() -> Iterator[tuple[int, Part]]:
        for b in _small(batches, 2):
            of, ids = b.column(0).to_pylist(), np.array([_NO_ID if i is None else i for i in b.column(1).to_pylist()], np.int64)
            raw = b.column(2).cast(pa.large_binary() if pa.types.is_large_string(b.column(2).type) else pa.binary()).to_pylist()
            gaps = b.column(3).to_pylist() if b.num_columns > 3 else None
            at = 0
            for part, run in groupby(of):
                n = len(list(run))
                for s in slices(list(map(len, raw[at : at + n])), 1 << 17):  # their arrays stay in the cache
                    own = slice(at + s.start, at + s.stop)
                    yield part, Part(raw[own], ids[own], gaps and gaps[own])
                at += n

    for part, run in groupby(each(), key=lambda x: x[0]):
        yield part, (p for _, p in run)


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with their anchors and bytes; the part, so far that of Spark, is cut into those of ``CHUNK`` bytes."""
    done = 0
    for b in _small(batches, 2):
        sizes = pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (b.column(0).to_numpy() << 32) + (done + np.cumsum(sizes) - sizes) // CHUNK
        done += int(sizes.sum())
        b = pa.RecordBatch.from_arrays([pa.array(part), *b.columns[1:]], ["part", "i", "t"])
        found = [g for _, run in _parts(iter([b])) for p in run for g in p.gaps()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary()), pa.array(sizes)], ["part", "i", "t", "a", "n"])


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of numbers and, last, bytes; of those some megabytes in a batch, as each batch has a cost of its own."""

    def batch() -> pa.RecordBatch:
        *numbers, data = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(data, pa.binary())], names)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of batches whose last column has bytes."""
    return (r for b in batches for s in _small(iter([b]), b.num_columns - 1) for r in zip(*(c.to_pylist() for c in s.columns), strict=True))


def _met(sent: list[tuple[int, np.ndarray]], settle: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """What is settled of all that has met, by (part, its questions); the answers are in the order of the questions, so one cut for each part."""
    use, out = settle(np.concatenate([x for _, x in sent]))
    cuts = np.concatenate([[0], np.cumsum(use)])[np.cumsum([0, *(len(x) for _, x in sent)])]
    for (part, _), a, b in zip(sent, cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield part, out[a:b]


def _blocks(found: Iterator, combine: Callable[[list], np.ndarray]) -> Iterator[np.ndarray]:
    """What is found, an array or several of the same length at a time, combined for each ``BLOCK`` records. A document's are found together."""
    held, size = [], 0
    for x in found:
        held.append(x)
        size += len(x[0] if isinstance(x, tuple) else x)
        if size >= BLOCK:
            yield combine(held)
            held, size = [], 0
    if size:
        yield combine(held)


class _Job:
    """The passes over the laid out documents; ``rows`` has part, i, t, a, the rows of a part together; ``size``: the bytes of all texts."""

    def __init__(self, rows: DataFrame, folder: str, size: int):
        self.rows, self.folder, self.size, self.tasks = rows, folder, size, tasks(rows.sparkSession)

    def buckets(self, share: int) -> int:
        return max(self.tasks, -(-self.size // share))

    def ask(self, step: int, share: int, questions: Callable[[int, Iterator[Part]], Iterator[np.ndarray]], settle: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], asked: np.dtype, told: np.dtype) -> None:
        """Each part's questions go to a bucket by key, where all of a key meet; what is settled goes back to the part.

        There is a bucket for each ``share`` bytes of text. ``questions`` gives blocks; a key can be in several.
        ``settle`` gives which of its rows have an answer, and the answers in the order of these.
        """
        n, to_tasks, folder = self.buckets(share), self.tasks, f"{self.folder}/answer-{step}"

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for part, run in _parts(batches):
                for found in questions(part, run):
                    to = (found["key"] % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int64)
                    order = np.argsort(to, kind="stable")
                    cuts = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=n))])
                    for k in np.flatnonzero(np.diff(cuts)).tolist():
                        yield k, part, _packed(found[order[cuts[k] : cuts[k + 1]]])

        def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for _, run in groupby(_rows(batches), key=lambda r: r[0]):
                for part, own in _met([(p, _unpacked(d, asked)) for _, p, d in run], settle):
                    yield part, _packed(own)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _batches(pieces(batches), ["bucket", "part", "data"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _batches(answers(batches), ["part", "data"])

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, run in groupby(_rows(batches), key=lambda r: r[0]):
                found = np.concatenate([_unpacked(d, told) for _, d in run])
                order, begin, _ = _groups(found["key"])
                put_whole(f"{folder}/{part:08d}", lambda out, x=_packed(found[order[begin]]): out.write(x))
                yield pa.RecordBatch.from_arrays([pa.array([len(begin)], pa.int64())], ["n"])

        sent = self.rows.mapInArrow(send, "bucket long, part long, data binary").repartition(to_tasks, "bucket").sortWithinPartitions("bucket", "part")
        back = sent.mapInArrow(meet, "part long, data binary").repartition(to_tasks, "part").sortWithinPartitions("part")
        with shuffles_freed(back.sparkSession):
            back.mapInArrow(store, "n long").agg(F.sum("n")).collect()


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per input row: the id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts`` also the bytes ``kept``.

    Bytes covered by a 50-byte string that also starts in a document with a smaller id go; strings are judged on the
    input. Null text: empty. Null ids are smaller than any other. Rows with the same id are no smaller than each other,
    so both keep what only they share. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "op9")
    laid = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t"))
    kinds = "part long, i long, t string, a binary, n long"
    laid.mapInArrow(_lay, kinds).write.option("compression", "zstd").parquet(f"{folder}/documents")
    rows = spark.read.schema(kinds).parquet(f"{folder}/documents")
    job = _Job(rows.drop("n"), folder, rows.agg(F.sum("n")).first()[0] or 0)

    def held(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of (keys, ids): each key, and whether more than one id has it."""
        keys, ids = (np.concatenate([f[k] for f in found]) if found else np.empty(0, kind) for k, kind in ((0, np.uint64), (1, np.int64)))
        order, begin, _ = _groups(keys)
        out = np.empty(len(begin), _FIRST)
        if len(begin):
            ids = ids[order]
            out["key"], out["many"] = keys[order[begin]], np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)
        return out

    def first(part: int, run: Iterator[Part]) -> Iterator[np.ndarray]:
        return _blocks(((p.keys, p.ids[p.owner]) for p in run), held)

    def known(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, begin, group = _groups(every["key"])
        use = np.zeros(len(every), bool)
        if len(begin):
            use[order] = ((np.diff(np.append(begin, len(order))) > 1) | np.logical_or.reduceat(every["many"][order], begin))[group]
        return use, every[use]

    job.ask(1, SPARSE, first, known, _FIRST, _FIRST)

    def second(part: int, run: Iterator[Part]) -> Iterator[np.ndarray]:
        alive = Keys(_answer(folder, 1, part, _FIRST)["key"])

        def found() -> Iterator[np.ndarray]:
            for p in run:
                some = np.flatnonzero(alive.find(p.keys)[0])
                x = np.empty(len(some), _SECOND)
                x["key"], x["doc"], x["context"], x["mixed"] = p.keys[some], p.doc(some), p.contexts(some), False
                yield x

        return _blocks(found(), lambda x: smallest(np.concatenate(x))[0])

    def smallest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(for each key its smallest document, that one's smallest context, and whether there are others; order, group of each in order)."""
        order, begin, group = _groups(x["key"])
        out = np.empty(len(begin), _SECOND)
        if len(begin):
            doc, context = x["doc"][order], x["context"][order]
            out["key"], out["doc"] = x["key"][order[begin]], np.minimum.reduceat(doc, begin)
            out["context"] = np.minimum.reduceat(np.where(doc == out["doc"][group], context, ~np.uint64(0)), begin)
            out["mixed"] = np.logical_or.reduceat(x["mixed"][order] | (context != out["context"][group]), begin)
        return out, order, group

    def alike(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, order, group = smallest(every)
        out = np.empty(len(every), _SECOND)
        out[order] = found[group]
        return np.ones(len(every), bool), out

    job.ask(2, SPARSE, second, alike, _SECOND, _SECOND)

    def third(part: int, run: Iterator[Part]) -> Iterator[np.ndarray]:
        answer = _answer(folder, 2, part, _SECOND)
        keys = Keys(answer["key"])

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for p in run:
                r = Resolved(p, answer, keys)
                both = [(digit[ok], p.doc(r.open[ok])) for digit, ok, _, _ in _sides(p, r.open)]
                yield tuple(np.concatenate(x) for x in zip(*both, strict=True))

        return _blocks(found(), held)

    job.ask(3, SPARSE, third, known, _FIRST, _FIRST)

    def last(part: int, run: Iterator[Part]) -> Iterator[np.ndarray]:
        answer, sides = _answer(folder, 2, part, _SECOND), Keys(_answer(folder, 3, part, _FIRST)["key"])
        keys = Keys(answer["key"])

        def found() -> Iterator[np.ndarray]:
            for p in run:
                r = Resolved(p, answer, keys)
                if len(r.open):
                    starts = _windows(p, r.open, r.gone, sides)
                    x = np.empty(len(starts), _LAST)
                    x["key"], x["doc"], x["many"] = p.digest(starts, starts + DEPTH), p.ids[np.searchsorted(p.at, starts, "right") - 1], False
                    yield x

        return _blocks(found(), lambda x: least(np.concatenate(x))[0])

    def least(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(for each key its smallest document, and whether there are others; order, group of each in order)."""
        order, begin, group = _groups(x["key"])
        out = np.empty(len(begin), _LAST)
        if len(begin):
            doc = x["doc"][order]
            out["key"], out["doc"] = x["key"][order[begin]], np.minimum.reduceat(doc, begin)
            out["many"] = np.logical_or.reduceat(x["many"][order] | (doc != out["doc"][group]), begin)
        return out, order, group

    def repeated(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, order, group = least(every)
        to = np.empty(len(every), np.int64)
        to[order] = group
        use = found["many"][to] if len(every) else np.zeros(0, bool)
        return use, found[to[use]]

    job.ask(4, DENSE, last, repeated, _LAST, _LAST)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts]
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, run in _parts(batches):
            answer, sides, windows = _answer(folder, 2, part, _SECOND), Keys(_answer(folder, 3, part, _FIRST)["key"]), _answer(folder, 4, part, _LAST)
            keys, whole = Keys(answer["key"]), Keys(windows["key"])
            for p in run:
                r = Resolved(p, answer, keys)
                n = len(p.data)
                gone = _inside(p.begin[r.gone], p.ends[r.gone], n)
                if len(r.open):
                    starts = _windows(p, r.open, r.gone, sides)
                    has, at = whole.find(p.digest(starts, starts + DEPTH))
                    starts = starts[has]
                    starts = starts[windows["doc"][at[has]] < p.ids[np.searchsorted(p.at, starts, "right") - 1]]
                    gone |= _inside(starts, starts + DEPTH, n)
                rows = []
                for k, i in enumerate(p.ids.tolist()):
                    a, b = p.at[k], p.at[k + 1]
                    own = gone[a:b]
                    kept = p.data[a:b][~own].tobytes() if own.any() else p.data[a:b].tobytes()
                    spans = int((own[1:] & ~own[:-1]).sum() + own[0]) if b > a else 0
                    rows.append((None if i == _NO_ID else i, int(b - a), int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), *[kept] * texts))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    out = job.rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
    return out.withColumnRenamed("doc_id", id_col)


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))

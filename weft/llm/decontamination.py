"""Benchmark decontamination: which benchmark items stand in which documents.

MinHash containment search, with items partitioned by size. If a document holds at least the given share of an item's
n shingles, no more than m - 1 are missing, m = n - ceil(share * n) + 1; so of the item's m smallest shingle hashes the
document has one. Those m are the item's sketch, m being that of the largest item of its size partition. Each document's
shingles are looked up in the sketches, whatever its length, so no window of it is passed over; what is found is counted
by hash and then verified by the shingles' words.

Items of one to four words have no shingle of five. With ``short_items`` such an item is one shingle of its own length,
looked up among the documents' runs of that many words.

The benchmark goes to the executors in blocks of a fixed size, one pass over the documents for each; documents are
never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import table, text_of
from weft.llm.words import SHINGLE, WORD_RE2, shingle_hashes, shingles, slices, word_hashes, words_of

SHARE = 0.8
BLOCK_BYTES = 16 << 20


def grams(words: list[str], n: int) -> frozenset[tuple]:
    return frozenset(zip(*(words[j:] for j in range(n)), strict=False))


class Block:
    """Items (id, text) and their sketches, by hash."""

    def __init__(self, items: list[tuple], share: float = SHARE, short_items: bool = False):
        self.items, self.needed, self.hashes = [], [], []
        sketch: dict[int, list[int]] = {}
        every, at = shingles([t or "" for _, t in items])
        self.short: dict[int, dict[int, list[int]]] = {}
        words, word_at = word_hashes([t or "" for _, t in items])
        for k, (i, text) in enumerate(items):
            if short_items and 0 < (n := int(word_at[k + 1] - word_at[k])) < SHINGLE:
                self.short.setdefault(n, {}).setdefault(int(shingle_hashes(words[word_at[k] : word_at[k + 1]], n)[0]), []).append(len(self.items))
                self.items.append((i, frozenset([tuple(words_of(text))])))
                self.needed.append(1)
                self.hashes.append(None)
                continue
            own = np.unique(every[at[k] : at[k + 1]])
            if len(own):
                need = lambda n: math.ceil(share * n - 1e-9)
                largest = (1 << len(own).bit_length()) - 1
                m = min(len(own), largest - need(largest) + 1)
                for h in own[:m].tolist():
                    sketch.setdefault(h, []).append(len(self.items))
                self.items.append((i, grams(words_of(text), SHINGLE)))
                self.needed.append(need(len(self.items[-1][1])))
                self.hashes.append(own)
        self.short_keys = {n: np.array(sorted(of), np.uint64) for n, of in self.short.items()}
        self.keys = np.array(sorted(sketch), np.uint64)
        self.of = [sketch[int(h)] for h in self.keys]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys & np.uint64((1 << 20) - 1)] = True

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(row, item, shingles found) of the items that a text holds."""
        yield from self._find_short(texts)
        every, at = shingles(texts)
        if not len(self.keys):
            return
        maybe = np.flatnonzero(self.bits[every & np.uint64((1 << 20) - 1)])
        place = np.minimum(np.searchsorted(self.keys, every[maybe]), len(self.keys) - 1)
        real = self.keys[place] == every[maybe]
        rows = np.searchsorted(at, maybe[real], "right") - 1
        for row in np.unique(rows):
            own = np.unique(every[at[row] : at[row + 1]])
            sides = None
            for k in sorted({k for p in np.unique(place[real][rows == row]) for k in self.of[p]}):
                h = self.hashes[k]
                j = np.minimum(np.searchsorted(own, h), len(own) - 1)
                if (own[j] == h).sum() >= self.needed[k]:
                    if sides is None:
                        sides = grams(words_of(texts[row]), SHINGLE)
                    if (n := len(self.items[k][1] & sides)) >= self.needed[k]:
                        yield int(row), k, n


    def _find_short(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        words, at = word_hashes(texts) if self.short else (None, None)
        for n, keys in self.short_keys.items():
            every = shingle_hashes(words, n)
            place = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == every)
            row = np.searchsorted(at, hit, "right") - 1
            within = hit + n <= at[row + 1]
            for r in np.unique(row[within]).tolist():
                sides = grams(words_of(texts[r]), n)
                for p in np.unique(place[hit][within & (row == r)]):
                    yield from ((r, k, 1) for k in self.short[n][int(keys[p])] if self.items[k][1] <= sides)


def blocks(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", share: float = SHARE, block_bytes: int = BLOCK_BYTES, short_items: bool = False) -> Iterator[Block]:
    """The benchmark, dealt by hash to as many blocks as its size asks for."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        yield Block([tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()], share, short_items)


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for b in batches:
        texts = [t or "" for t in b.column(text).to_pylist()]
        for s in slices(list(map(len, texts)), 1 << 20):
            yield b.slice(s.start, len(s)), texts[s.start : s.stop]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, n_shingles (of the item), n_found, containment.

    Shingles are of five words and distinct. With ``short_items`` an item of one to four words is one shingle of its
    own length, else it has none and is never found, nor are items without words; null texts
    are empty. Null ids come back null, and repeated rows are each reported. Other columns are ignored. Without
    documents or items the result is empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t"))
    out = None
    for block in blocks(benchmark, **how):

        def search(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for part, texts in _parts(batches, 1):
                ids = part.column(0).to_pylist()
                found = [(ids[r], block.items[k][0], len(block.items[k][1]), n, n / len(block.items[k][1])) for r, k, n in block.find(texts)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int64()] * 4 + [pa.float64()], strict=True)], ["doc_id", "item_id", "n_shingles", "n_found", "containment"])

        some = rows.mapInArrow(search, "doc_id long, item_id long, n_shingles long, n_found long, containment double")
        out = some if out is None else out.unionByName(some)
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The documents that hold no item, with their own columns, whatever their names.

    Null and empty texts hold nothing and stay, as do rows without an id; rows that repeat are judged each for itself.
    Without items all documents stay; an empty table gives an empty result.
    """
    names = docs.columns
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))
    for block in blocks(benchmark, **how):

        def clean(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for part, texts in _parts(batches, names.index(text_col)):
                bad = {r for r, _, _ in block.find(texts)}
                yield part.filter(pa.array([k not in bad for k in range(len(texts))], pa.bool_())) if bad else part

        rows = rows.mapInArrow(clean, rows.schema)
    return rows.toDF(*names)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = rf"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE2}') as w from documents),
     b as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE2}') as w from benchmark),
     ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from d),
     bs as (select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from b),
     n as (select item_id, count(*) as n_shingles from bs group by item_id),
     f as (select doc_id, item_id, count(*) as n_found from ds join bs using (s) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_found, n_found / n_shingles as containment
from f join n using (item_id) where n_found >= ceil({SHARE} * n_shingles - 1e-9)
"""

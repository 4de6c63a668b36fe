"""Token ids in flat binary files.

A dataset is a folder: per shard ``part-N.bin`` (ids, unsigned 16 or 32 bit little-endian), ``part-N.idx`` (64-bit
offsets, one more than documents) and ``part-N.doc`` (64-bit document ids), and ``manifest.json`` with the id width and
the base of each shard, the prefix sum of the shards' token counts. Readers memory-map local files.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import file_system, put_whole, scratch, size_of, table, tasks, text_of
from weft.llm.words import mix, slices

_NO_ID = np.iinfo(np.int64).min
#: Input of a shard, by Spark's estimate of the table, when there are more shards than shuffle partitions.
SHARD_BYTES = 256 << 20
#: Classes of bytes: part of what may be white space, a space or line end, a letter of ASCII or Latin-1, any other character.
_DOUBT, _SPACE, _LETTER, _SOLID = range(4)
_KIND = np.full(256, _SOLID, np.uint8)
_KIND[[*range(33), 127, 0xC2, 0xE1, 0xE2, 0xE3]] = _DOUBT  # Unicode's white space begins with one of the last four bytes
_KIND[[32, 10]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_SHORT = 23  # bytes of the longest piece that is held: with its length, three words of 64 bits
#: One word for the splitter: a space or none, then letters of ASCII and Latin-1 only.
_PLAIN = r"^ ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+$"
_JOINT = re.compile(rb"[ \n].*[!-~]", re.S).fullmatch


def _letters() -> np.ndarray:
    """Code points of the letters that stand for the bytes in byte-level vocabularies: printable ones for themselves, the
    others from 256 on, in order. The zero byte stays, as the mark between words."""
    shown = np.zeros(256, bool)
    shown[[*range(33, 127), *range(161, 173), *range(174, 256)]] = True
    out = np.where(shown, np.arange(256), 256 + np.cumsum(~shown) - 1).astype("<u4")
    out[0] = 0
    return out


_LETTERS = _letters()


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all strings in a row, place of each string and the end)"""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type) else np.int32
    _, at, data = values.buffers()
    at = np.frombuffer(at, kind)[values.offset : values.offset + len(values) + 1].astype(np.int64, copy=False)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Encoder:
    """Byte-level BPE ids of whole texts, exactly those of the tokenizers library, added tokens within texts included.

    Such a tokenizer splits a text into words before it merges; some word ends can be seen in the bytes alone:

    * between a letter and any ASCII character that is none;
    * before a space or line end after a character that is no white space, whatever follows;
    * after a line end between two characters that are no white space.

    Texts are cut there, a few megabytes at a time. Pieces of up to 23 bytes are looked up by all their bytes in a table of
    ``1 << bits`` places; of the others Arrow finds the distinct ones, which the library encodes. Plain words skip its
    splitter, as they are one word each; all other pieces pass through it. A new piece takes the place of that which has
    the same hash, and the table is emptied when the ids held reach ``most``: memory depends on no count of words.
    Texts that hold an added token, and all texts if the vocabulary has another splitter, are encoded whole.
    """

    def __init__(self, path: str, bits: int = 20, most: int = 12 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        split = shape["pre_tokenizer"] or {}
        self.cuts = shape["normalizer"] is None and shape["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.added = [t["content"].encode() for t in shape["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\0")
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # byte-level vocabularies have a letter for each byte
        self.bits, self.most = bits, most
        self.keys = np.zeros((3, 1 << bits), np.uint64)
        self.place, self.count = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8)
        self.pool, self.held = np.empty(most, self.dtype), 0

    def _flat(self, tokenizer, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.empty(0, self.dtype), *(np.array(e.ids, self.dtype) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))])

    def _apart(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The ids of each piece, from those of all pieces in a row and the pieces' numbers of bytes."""
        ends, cuts = np.cumsum(self.sizes[ids]), np.cumsum(sizes)
        at = np.searchsorted(ends, cuts) + 1
        if len(sizes) and (at[-1] != len(ids) or (ends[at - 1] != cuts).any()):
            raise ValueError("the tokens do not add up to the pieces: this vocabulary is not supported")
        return _binary(ids, np.concatenate([[0], at]) * self.dtype.itemsize)

    def _words(self, words: pa.Array, run: int = 200) -> pa.Array:
        """Plain words in long runs, as the letters that stand for their bytes."""
        data, at = _bytes_of(words)
        letters, at = _LETTERS[np.insert(data, at[1:-1], 0)], at + np.arange(len(at))
        cuts = [*at[:-1:run].tolist(), len(letters) + 1]
        runs = [letters[a : b - 1].tobytes().decode("utf-32-le") for a, b in zip(cuts, cuts[1:])]
        return self._apart(self._flat(self.plain, runs), np.diff(at) - 1)

    def _others(self, pieces: pa.Array, run: int = 100) -> pa.Array:
        """Pieces that begin with a space or line end and do not end with white space are whole words for the splitter
        whatever stands beside them, so they pass through it in runs; the rest alone."""
        raw = pieces.to_pylist()
        joint = [k for k, p in enumerate(raw) if len(p) < 200 and _JOINT(p)]
        alone = sorted(set(range(len(raw))).difference(joint))
        text = lambda some: b"".join(raw[k] for k in some).decode("utf-8", "replace")
        both = self._apart(self._flat(self.tokenizer, [text(joint[k : k + run]) for k in range(0, len(joint), run)]), np.array([len(raw[k]) for k in joint], np.int64)).to_pylist()
        found = dict(zip(joint, both, strict=True))
        found.update((k, self._flat(self.tokenizer, [text([k])]).tobytes()) for k in alone)
        return pa.array([found[k] for k in range(len(raw))], pa.large_binary())

    def _encoded(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces, as bytes."""
        plain = np.asarray(pc.match_substring_regex(pieces, _PLAIN))
        words, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        order = np.empty(len(pieces), np.int64)
        order[np.concatenate([words, others])] = np.arange(len(pieces))
        return pa.concat_arrays([self._words(pieces.take(pa.array(words))), self._others(pieces.take(pa.array(others)))]).take(pa.array(order))

    def _looked_up(self, data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number) of the ids of each piece."""
        if self.held > self.most // 2:
            self.keys[:], self.held = 0, 0
        start, size = cut[:-1], np.diff(cut)
        eight = np.lib.stride_tricks.as_strided(np.append(data, np.zeros(32, np.uint8)).view(np.uint8)[:8].view("<u8"), (len(data) + 24,), (1,))
        keys = [eight[start] & _MASK[np.minimum(size, 8)], eight[start + 8] & _MASK[np.clip(size - 8, 0, 8)], eight[start + 16] & _MASK[np.clip(size - 16, 0, 7)] | np.minimum(size, _SHORT + 1).astype(np.uint64) << np.uint64(56)]
        slot = (mix(keys[0] ^ mix(keys[1] ^ keys[2])) >> np.uint64(64 - self.bits)).astype(np.int64)
        short = size <= _SHORT
        hit = short.copy()
        for held, own in zip(self.keys, keys, strict=True):
            hit &= held[slot] == own
        place, count = self.place[slot].astype(np.int64), self.count[slot].astype(np.int64)
        missed = np.flatnonzero(~hit)
        if len(missed):
            some = _binary(data, cut).take(pa.array(missed)).dictionary_encode()
            which = some.indices.to_numpy()
            ids, at = _bytes_of(self._encoded(some.dictionary))
            at = at // self.dtype.itemsize
            while len(self.pool) < self.held + at[-1]:
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[self.held : self.held + at[-1]] = np.frombuffer(ids, self.dtype)
            at += self.held
            self.held = int(at[-1])
            place[missed], count[missed] = at[which], np.diff(at)[which]
            new = missed[short[missed]]
            to = slot[new]
            for held, own in zip(self.keys, keys, strict=True):
                held[to] = own[new]
            self.place[to], self.count[to] = place[new], count[new]
        return place, count

    def _cut(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pieces begin, and the end; ``at`` has the begin of each text and the end."""
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        if not self.cuts:
            return np.flatnonzero(cut)
        kind, last = _KIND[data], len(data) - 1
        high = np.flatnonzero(data >= 0xC2)
        lead = data[high]
        for own, long in ((high[lead == 0xC2], 1), (high[(lead >= 0xE1) & (lead <= 0xE3)], 2)):
            for k in range(1, long + 1):
                kind[np.minimum(own + k, last)] = _DOUBT
        latin = high[lead == 0xC3] + 1
        latin = latin[latin <= last]
        kind[latin] = np.where(data[latin] & 0xDF == 0x97, _SOLID, _LETTER)  # multiplication and division signs
        letter, solid, space = kind == _LETTER, kind >= _LETTER, kind == _SPACE
        new = (letter[:-1] & ~letter[1:] & (data[1:] < 0x80)) | (space[1:] & solid[:-1])
        line = np.flatnonzero(data[1:-1] == 10)
        line = line[solid[line] & solid[line + 2] & ~(cut[line + 1] | cut[line + 2])] + 2
        cut[1:-1] |= new
        cut[line] = True
        for token in self.added:
            if (raw := data.tobytes()).find(token) >= 0:
                for m in re.finditer(re.escape(token), raw):
                    text = np.searchsorted(at, m.start(), "right") - 1
                    cut[at[text] + 1 : at[text + 1]] = False
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, place of each text's first and the end); after each text the id ``end``."""
        data, at = _bytes_of(texts)
        cut = self._cut(data, at)
        place, count = self._looked_up(data, cut)
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(place - ends[:-1], count) + np.arange(ends[-1])]
        places = ends[np.searchsorted(cut, at)]
        if end is not None:
            ids, places = np.insert(ids, places[1:], end), places + np.arange(len(places))
        return ids, places


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker: what it has learned serves later tasks."""
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int, most: int = 4 << 20) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(row ids, ids of all texts and ``end`` after each, places of the texts) for a few megabytes at a time, from batches of (id, text)."""
    enc = encoder(path)
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_pylist()
        for s in slices(sizes, most):
            yield batch.column(0).slice(s.start, len(s)), *enc.encode(batch.column(1).slice(s.start, len(s)), end)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, folder: str, *, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[tuple[int, int, int]]:
    """Write the dataset in ascending order of the integer id; returns (shard, base, tokens) per shard, also in the manifest.

    Each document ends with ``end_id``. Null text: empty, so only the end id. Null ids come first; rows that repeat an
    id follow each other by text. Other columns are ignored. An empty table gives a dataset without shards. The driver
    gets three numbers per shard.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t"))
    shards = shards or max(tasks(docs.sparkSession), -(-size_of(docs) // SHARD_BYTES))
    rows = rows.repartitionByRange(shards, "i").sortWithinPartitions("i", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name, width = f"{folder}/part-{shard:06d}", encoder(vocabulary).dtype.itemsize
        ids, sizes = [np.empty(0, "<i8")], [np.zeros(1, np.int64)]

        def flow(out) -> None:
            for some, tokens, at in encoded(batches, vocabulary, end_id):
                ids.append(some.fill_null(_NO_ID).to_numpy().astype("<i8"))
                sizes.append(np.diff(at))
                out.write(tokens.astype(f"<u{width}", copy=False).tobytes())

        put_whole(f"{name}.bin", flow)
        places = np.cumsum(np.concatenate(sizes), dtype="<i8")
        put_whole(f"{name}.idx", lambda out: out.write(places.tobytes()))
        put_whole(f"{name}.doc", lambda out: out.write(np.concatenate(ids).tobytes()))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(places) - 1], "tokens": [int(places[-1])]}, pa.schema({"shard": pa.int32(), "docs": pa.int64(), "tokens": pa.int64()}))

    counts = sorted(tuple(r) for r in rows.mapInArrow(write, "shard int, docs long, tokens long").collect() if r.docs)
    bases = [0, *accumulate(n for _, _, n in counts)]
    found = [(shard, base, n) for (shard, _, n), base in zip(counts, bases, strict=False)]
    width = encoder(vocabulary).dtype.itemsize
    put_whole(f"{folder}/manifest.json", lambda out: out.write(json.dumps({"width": width, "end_id": end_id, "shards": found}).encode()))
    return found


def _mapped(uri: str, dtype: str) -> np.ndarray:
    fs, path = file_system(uri)
    if fs.type_name == "local":
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of 32-bit ids)."""
    fs, path = file_system(f"{folder}/manifest.json")
    with fs.open_input_stream(path) as file:
        manifest = json.loads(file.read())
    width, shards = manifest["width"], manifest["shards"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"{folder}/part-{shard:06d}"
                ids, at, docs = _mapped(f"{name}.bin", f"<u{width}"), _mapped(f"{name}.idx", "<i8"), _mapped(f"{name}.doc", "<i8")
                for k in range(0, len(docs), 2000):
                    some = range(k, min(k + 2000, len(docs)))
                    crc = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4").tobytes()) for i in some]
                    own, cut = np.asarray(docs[k : k + 2000]), np.asarray(at[k : k + len(crc) + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == _NO_ID), pa.array(base + cut[:-1]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    if not shards:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame(spark.sparkContext.parallelize([(s, b) for s, b, _ in shards], len(shards)), "shard int, base long")
    return todo.mapInArrow(read, schema)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "op5-tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary=default_vocabulary())
    return read_tokens(spark, folder)

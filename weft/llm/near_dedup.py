"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its sequence of words. Its k-mers are the runs of five words, labelled with their number of occurrence. Each of
``sketches`` random orders picks the ``2`` smallest labelled k-mers; their hash *in the order of the text* is a sketch, so
texts with the same k-mers in another order seldom share one. ``depth`` neighbouring sketches make a band. Two texts are
compared by the exact number of word edits within a diagonal band of the alignment; they are linked if the similarity,
1 - edits / words of the longer, is at least ``share``. Classes are the connected components of the links.

Identical texts are one text from the start. In each bucket, texts with the same sketch or band, the first round compares
all with one leader: the text that meets most others in all its buckets, since the original of a group of copies meets
more than each copy. So a passage that a third of all texts share costs a comparison for each of them, not for each pair.
Buckets of sketches whose texts are in more than one class then go on: the first 15, the next 240, .. texts lead, against
the texts of other classes only, until each text of such a bucket has led. So every two texts that share a sketch
end in one class or have been compared, or their lengths or numbers of words by bin show that they are not similar:
an edit changes the sum of the differences between the numbers in ``BINS`` bins of words by two at most; pairs that these
leave are held against ``FINE`` bins, since a long text fills the few.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import keep, only, table, text_of
from weft.llm.words import mix, series, shingle_hashes, slices, word_hashes, words_of

SHARE, SKETCHES, DEPTH, BINS, FINE = 0.8, 32, 4, 64, 1024
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def labelled(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the values with their number of occurrence within their owner; ``n`` owners. Whatever else is in the batch, equal values with equal numbers have equal hashes."""
    seen = mix(x + series(n, 10)[owner]) if n else x
    order = np.argsort(seen, kind="stable")
    at = np.arange(len(seen))
    again = np.zeros(len(seen), bool)
    again[1:] = seen[order][1:] == seen[order][:-1]
    label = np.empty(len(seen), np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(again, 0, at))).astype(np.uint64)
    return mix(x + label * np.uint64(0x9E3779B97F4A7C15))


def kmers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(labelled k-mers of all texts in order, place of each text's first); a text of 1 to 4 words is one k-mer."""
    words, at = word_hashes(texts)
    every, counts = shingle_hashes(words), np.diff(at)
    n = np.where(counts >= 5, counts - 4, (counts > 0).astype(counts.dtype))
    first = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(texts)), n)
    place = at[:-1][owner] + np.arange(first[-1]) - first[:-1][owner]
    out = np.zeros(first[-1], np.uint64)
    long = counts[owner] >= 5
    out[long] = every[place[long]]
    for row in np.flatnonzero((counts > 0) & (counts < 5)):
        own = words[at[row] : at[row + 1]]
        out[first[row]] = mix((own * series(len(own), 9)).sum(keepdims=True))[0]
    return labelled(out, owner, len(texts)), first


def order_minhash(texts: list[str], n: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """(sketches, a row for each text that has words; which texts these are)."""
    x, first = kmers(texts)
    rows = np.flatnonzero(np.diff(first))
    starts, sizes = first[:-1][rows], np.diff(first)[rows]
    out = np.empty((len(rows), n), np.uint64)
    if len(rows):
        for k, (flip, times) in enumerate(zip(series(n, 11), series(n, 12) | np.uint64(1), strict=True)):
            v = (x ^ flip) * times
            a = np.flatnonzero(v == np.repeat(np.minimum.reduceat(v, starts), sizes))
            v[a] = _MOST
            low = np.minimum.reduceat(v, starts)
            b = np.flatnonzero((v == np.repeat(low, sizes)) & (np.repeat(low, sizes) != _MOST))
            second = a.copy()
            second[np.searchsorted(starts, b, "right") - 1] = b
            out[:, k] = mix(x[np.minimum(a, second)] * np.uint64(3) + mix(x[np.maximum(a, second)] + np.uint64(k)))
    return out, rows


def masks(words: list[str]) -> dict[str, int]:
    """For each word the places where it stands, as bits."""
    out: dict[str, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def edits(a: dict[str, int], n: int, b: list[str], most: int) -> int | None:
    """The number of insertions, deletions and replacements between two sequences, if it is ``most`` or less.

    ``a`` has the masks of a sequence of n words. Alignment within the band of 2 * most + 1 diagonals, a column at a time:
    the differences between neighbouring cells of a column are the bits of two integers (Myers; Hyyrö for the band).
    Bit t of column j belongs to row j - most + t, so the bit of the last cell's diagonal stays the same; the count on
    that diagonal never falls, so it ends the search as soon as it is too large.
    """
    m = len(b)
    if abs(n - m) > most:
        return None
    width = 2 * most + 1
    full = (1 << width) - 1
    end = 1 << (n - m + most)
    up, down, count = full >> most << most, 0, max(0, n - m)  # column 0: each row from 1 on is one more than the row before
    get = a.get
    for j, w in enumerate(b, 1):
        same = get(w, 0)
        if same:
            shift = j - most - 1
            same = (same >> shift if shift > 0 else same << -shift) & full
        level = (((same & up) + up) ^ up) | same | down
        if not level & end:
            count += 1
            if count > most:
                return None
        more = (down | ~(level | up)) & full
        less = level & up
        level = (level & full) >> 1
        up = (less | ~(level | more)) & full
        down = level & more
    return count


class Similar:
    """Is the edit similarity of texts with the held one at least ``share``? Texts are lists of words."""

    def __init__(self, share: float):
        self.share = share

    def hold(self, words: list[str]) -> None:
        self.words, self.masks, self.counts = words, masks(words), Counter(words)

    def __call__(self, words: list[str]) -> bool:
        longer = max(len(self.words), len(words))
        most = int((1 - self.share) * longer + 1e-9)
        if abs(len(self.words) - len(words)) > most:
            return False
        if self.words == words:
            return True
        if longer > 64:  # words that the other lacks cost an edit each
            other = Counter(words)
            if max((self.counts - other).total(), (other - self.counts).total()) > most:
                return False
        return edits(self.masks, len(self.words), words, most) is not None


def buckets(texts: list[str], sketches: int = SKETCHES, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(sketches, then as many bands, a row for each text that has words; which texts these are)."""
    found, rows = order_minhash(texts, sketches)
    bands = found
    for k in range(1, depth):
        bands = mix(bands * np.uint64(3) + np.roll(found, -k, axis=1))
    return np.hstack([found, mix(bands + np.uint64(depth))]), rows


def bins(texts: list[str], n: int = BINS, most: int = 32767) -> np.ndarray:
    """The number of words in each of ``n`` bins, a row for each text; numbers above ``most`` are cut, which only makes differences smaller."""
    words, at = word_hashes(texts)
    place = np.repeat(np.arange(len(texts)), np.diff(at)) * n + (mix(words) % np.uint64(n)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=len(texts) * n), most).astype(np.int8 if most < 128 else np.int16).reshape(-1, n)


def _bucketed(rows: DataFrame, sketches: int) -> DataFrame:
    """(key, words, buckets, bins, fine) of rows (key, text)."""

    def numbers(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in slices(list(map(len, texts)), 1 << 20):
                some = texts[s.start : s.stop]
                found, which = buckets(some, sketches)
                counts = np.diff(word_hashes(some)[1])
                sizes = np.zeros(len(some) + 1, np.int32)
                sizes[which + 1] = 2 * sketches
                lists = pa.ListArray.from_arrays(np.cumsum(sizes, dtype=np.int32), pa.array(found.view(np.int64).ravel()))
                out = [b.column(0).slice(s.start, len(s)), pa.array(counts, pa.int64()), lists, numbers(bins(some)), numbers(bins(some, FINE, 127))]
                yield pa.RecordBatch.from_arrays(out, ["key", "words", "buckets", "bins", "fine"])

    return rows.mapInArrow(work, "key binary, words long, buckets array<long>, bins array<short>, fine array<byte>")


def _verified(pairs: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """Of pairs (a, b) those that are similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, held = Similar(share), None
        for b in batches:
            good = []
            for at in range(0, b.num_rows, 200):
                for a, _, ta, tb in zip(*(c.to_pylist() for c in b.slice(at, 200).columns), strict=True):
                    if held != a:
                        held = a
                        test.hold(words_of(ta))
                    good.append(test(words_of(tb)))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], ["a", "b"])

    both = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(work, "a binary, b binary")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(key, class) of all keys in links (a, b); the class is the smallest key that can be reached.

    Each level joins every key to the first of its neighbours by a hash, itself included, and goes on with the links
    between different firsts: whatever the order of the keys, a level leaves a fraction of them.
    """
    ends = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    edges, levels = keep(ends(links), f"{name}-links"), []
    while not levels or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("k"))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("key"), F.least("m", rank("a"))["k"].alias("class"))
        first = keep(first, f"{name}-level-{len(levels)}")
        levels.append(first)
        of = lambda end: first.select(F.col("key").alias(end), F.col("class").alias(f"{end}_first"))  # noqa: B023, E731
        edges = keep(ends(edges.join(of("a"), "a").join(of("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))), f"{name}-links-{len(levels)}")
    now = levels.pop()
    while levels:
        now = levels.pop().join(now.select(F.col("key").alias("class"), F.col("class").alias("to")), "class", "left").select("key", F.coalesce("to", "class").alias("class"))
    now = keep(now, f"{name}-firsts")
    least = now.groupBy("class").agg(F.min("key").alias("least"))
    return keep(now.join(least, "class").select("key", F.col("least").alias("class")), name)


def _merged(classes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The classes after more links: only the classes that these touch are looked at."""
    of = lambda end: classes.select(F.col("key").alias(end), F.col("class").alias(f"{end}_class"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b"))
    moved = components(ends, f"{name}-moved")
    old = classes.join(moved.select(F.col("key").alias("class"), F.col("class").alias("to")), "class", "left").select("key", F.coalesce("to", "class").alias("class"))
    return keep(old.unionByName(moved.join(classes, "key", "left_anti")), name)


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).withColumn("key", _key(F.col("text")))


def _texts(rows: DataFrame, share: float, sketches: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (_id, text, key): (key, low, copies and class of each text; the links found).

    The first text of a pair is the one that meets more others. So a pair that shares many sketches is made once, in the
    first of them, when that text leads.
    """
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))
    known = keep(_bucketed(texts.select("key", "text"), sketches), "op4-buckets")
    entries = known.select("key", F.posexplode("buckets").alias("nth", "bucket"))
    full = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keep(entries.join(full, "bucket").select("key", "bucket", (F.col("nth") >= sketches).alias("band"), "n"), "op4-members")
    info = keep(members.groupBy("key").agg(F.sum("n").alias("meets")).join(known, "key"), "op4-info")
    members = keep(members.join(info.select("key", "words", "meets"), "key"), "op4-known")
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= (1 - share) * F.greatest(x, y) + 1e-9
    lead = members.groupBy("bucket").agg(F.max(F.struct("meets", "key", "words")).alias("m")).select("bucket", F.col("m.key").alias("a"), F.col("m.words").alias("w"))
    pairs = keep(members.join(lead, "bucket").where((F.col("key") != F.col("a")) & near("words", "w")).select("a", F.col("key").alias("b")).distinct(), "op4-pairs-0")
    texts = keep(texts.join(info.select("key"), "key", "left_semi"), "op4-texts")
    links = keep(_verified(pairs, texts, share), "op4-links-0")
    step, low, classes = 0, 1, components(links, "op4-classes-0")
    members = members.where("not band").select("key", "bucket", "words", "meets", "n")
    while True:
        of = members.where(f"n >= {low}").join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
        mixed = of.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("bucket")
        ranked = keep(of.join(mixed, "bucket", "left_semi").join(info.select("key", F.slice("buckets", 1, sketches).alias("sketches"), "bins", "fine"), "key"), f"op4-mixed-{step}")
        if ranked.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("meets"), F.desc("key")))
        lead = ranked.withColumn("r", place).where(f"r >= {max(low, 2)} and r < {16 * low}").select("bucket", *(F.col(c).alias(f"l_{c}") for c in ("key", "words", "class", "meets", "sketches", "bins", "fine")))
        shared = F.array_compact(F.zip_with("l_sketches", "sketches", lambda x, y: F.when(x == y, x)))
        below = F.struct("meets", "key") < F.struct(F.col("l_meets").alias("meets"), F.col("l_key").alias("key"))
        apart = lambda c: F.aggregate(F.zip_with(f"l_{c}", c, lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda x, y: x + y) + F.abs(F.col("words") - F.col("l_words"))
        like = lambda c: apart(c) <= 2 * ((1 - share) * F.greatest("words", "l_words") + 1e-9)
        first = F.get(shared, F.lit(0)) == F.col("bucket")
        more = lead.join(ranked, "bucket").where((F.col("l_class") != F.col("class")) & below & near("words", "l_words") & like("bins") & first & like("fine"))
        more = more.select(F.col("l_key").alias("a"), F.col("key").alias("b"))
        step, low = step + 1, 16 * low
        new = keep(_verified(keep(more.join(pairs, ["a", "b"], "left_anti"), f"op4-pairs-{step}"), texts, share), f"op4-links-{step}")
        if not new.isEmpty():
            links = links.unionByName(new)
            classes = _merged(classes, new, f"op4-classes-{step}")
    sums = rows.groupBy("key").agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    of = sums.join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    return keep(of, "op4-texts-classes"), links


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, sketches: int = SKETCHES) -> DataFrame:
    """One row per input row: the id, ``class_id`` (smallest id of the class), ``class_size`` (rows) and ``n_links`` (verified
    comparisons of its text with other texts).

    Null text: empty. Texts without words are in a class only with texts identical to them; texts of 1 to 4 words are
    compared as one k-mer. Null ids are larger than any other, so a class of null ids only has a null ``class_id``. Rows
    that repeat count each. Other columns are ignored. An empty table gives an empty result.
    """
    rows = _rows(docs, id_col, text_col)
    of, links = _texts(rows, share, sketches)
    ends = links.select(F.col("a").alias("key")).unionAll(links.select(F.col("b").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sizes = of.groupBy("class").agg(F.min("low").alias("class_id"), F.sum("copies").alias("class_size"))
    final = keep(of.select("key", "class").join(sizes, "class").join(ends, "key", "left").select("key", "class_id", "class_size", F.coalesce("n", F.lit(0)).alias("n_links")), "op4-final")
    return rows.select("_id", "key").join(final, "key").select(F.col("_id").alias(id_col), "class_id", "class_size", "n_links")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, sketches: int = SKETCHES) -> DataFrame:
    """Of each class the row with the smallest id (nulls last; of equal ids that with the smallest digest), with its own
    columns. Rows that repeat both id and text become one."""
    names = docs.columns
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))
    i, t = (f"c{names.index(c)}" for c in (id_col, text_col))
    of, _ = _texts(_rows(docs, i, t), share, sketches)
    first = of.groupBy("class").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "key")).alias("m"))
    return only(docs, _key(text_of(t)), i, first.select(F.col("m.low").alias("i"), F.col("m.key").alias("key"))).toDF(*names)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))

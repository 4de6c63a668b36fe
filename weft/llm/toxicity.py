"""Toxicity scores: a lexicon trie walked together with Levenshtein automata, and scores of the words around.

The lexicon has given terms, and whole words and stems learned from labelled rows: those that many toxic documents and
few others have. A misspelled term is found by running the automaton of the text's word along the trie of terms. Each
find is weighed by its surroundings: matching quotation marks around it, however many words they hold, or words of
reporting near it speak for quotation, else second person near it for abuse. A logistic model over these features gives the score.

Learning reads ``sample`` labelled rows at most, chosen by a hash of their id; scoring reads every word of every text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import keep, table, text_of
from weft.llm.words import slices

TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "vermin", "dimwit", "halfwit", "degenerate", "subhuman")
WORD = re.compile(r"[^\W\d_]+")
NEAR = 6
YOU = frozenset("you your yours yourself ur u youre tu te toi ton vous votre du dich dein ihr sie tú vos usted".split())
SAID = frozenset("said says quote quoted quoting wrote writes called calling term word phrase slur reported alleged".split())
#: A quotation: matching marks within a line.
QUOTED = re.compile("|".join([*(f"{a}[^{a}{b}\n]{{1,400}}{b}" for a, b in ('""', "“”", "„“", "„”", "«»", "»«", "‘’")), r"(?<!\w)'[^'\n]{1,400}'(?!\w)"]))
SAMPLE, CUT = 20_000, 0.3
_SEEN_MOST = 1 << 18


class Automaton:
    """Levenshtein automaton of a word: states are errors by position, at most ``most``.

    A state is (base, ((place after the base, errors), ..)); without any place it is empty. How it goes on depends only
    on the places after the base, on which of the next letters of the word are the one read, and on whether the word
    ends among them. So the transitions of all words are one finite table, filled as they are met.
    """

    _known: dict[tuple, tuple] = {}

    def __init__(self, word: str, most: int):
        self.word, self.most, self.size, self.window = word, most, len(word), 2 * most + 1
        self.start = (0, tuple((i, i) for i in range(min(most, len(word)) + 1)))
        self.has: dict[str, int] = {}
        for i, c in enumerate(word):
            self.has[c] = self.has.get(c, 0) | 1 << i

    def step(self, state: tuple, letter: str) -> tuple:
        if not state:
            return ()
        base, places = state
        key = (self.most, places, self.has.get(letter, 0) >> base & (1 << self.window) - 1, min(self.size - base, self.window))
        if (after := self._known.get(key)) is None:
            after = self._known[key] = self._after(*key)
        return (base + after[0], after[1]) if after else ()

    @staticmethod
    def _after(most: int, places: tuple, same: int, size: int) -> tuple:
        new: dict[int, int] = {}
        for i, e in places:
            if e < most:  # the letter is not in the word
                new[i] = min(new.get(i, e + 1), e + 1)
            for skip in range(most - e + 1):  # letters of the word that are left out
                j = i + skip
                if j < size:
                    cost = e + skip + (not same >> j & 1)
                    if cost <= most:
                        new[j + 1] = min(new.get(j + 1, cost), cost)
        base = min(new, default=0)
        return (base, tuple((i - base, e) for i, e in sorted(new.items()))) if new else ()

    def errors(self, state: tuple) -> int | None:
        base, places = state or (0, ())
        rest = [e + self.size - base - i for i, e in places if e + self.size - base - i <= self.most]
        return min(rest, default=None)


class Trie:
    def __init__(self, terms: Iterable[str]):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def near(self, word: str, most: int) -> Iterator[tuple[str, int]]:
        """(term, errors) of all terms within ``most`` edits: the trie and the automaton go forward together."""
        automaton = Automaton(word, most)
        todo = [(self.root, automaton.start)]
        while todo:
            node, state = todo.pop()
            for c, below in node.items():
                if c:
                    if after := automaton.step(state, c):
                        todo.append((below, after))
                elif (e := automaton.errors(state)) is not None:
                    yield below, e


def allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Weights of words: 1 for a term, less for a misspelling; stems by their learned weight."""

    def __init__(self, terms: Iterable[str], stems: dict[str, float], innocent: Iterable[str] = ()):
        self.terms, self.stems, self.innocent = frozenset(terms), stems, frozenset(innocent) - frozenset(terms)
        self.trie = Trie(self.terms)
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        #: Of a term's parts, one more than the errors allowed, a misspelling has one unchanged: the first, the last or,
        #: moved by 2 at most, the middle one. Each part is held with the lengths of such words.
        self.heads: dict[str, set[int]] = {}
        self.tails: dict[str, set[int]] = {}
        self.cores: dict[str, set[int]] = {}
        for t in self.terms:
            n, k = len(t) // (allowed(t) + 1), allowed(t)
            lengths = range(len(t) - k, len(t) + k + 1)
            for parts, part in ((self.heads, t[:n]), (self.tails, t[-n:]), *([(self.cores, t[n : 2 * n])] if k == 2 else [])):
                parts.setdefault(part, set()).update(lengths)
        self.sizes = sorted({len(x) for x in (*self.heads, *self.tails)})
        self.least, self.most = min(map(len, self.terms), default=0) - 1, max(map(len, self.terms), default=0) + 2
        self.seen: set[str] = set()
        self.bad: dict[str, tuple[str, float]] = {}

    def _maybe(self, word: str) -> bool:
        """False only for words that are no misspelling of any term."""
        n = len(word)
        for k in self.sizes:
            if n in self.heads.get(word[:k], ()) or n in self.tails.get(word[-k:], ()):
                return True
        return any(n in lengths and core in word for core, lengths in self.cores.items())

    def kind(self, word: str) -> tuple[str, float] | None:
        """("exact" | "near" | "stem", weight)"""
        if word in self.terms:
            return "exact", 1.0
        for k in self.lengths:
            if (w := self.stems.get(word[:k])) is not None and len(word) >= k:
                return "stem", w
        if word in self.innocent or not self.least <= len(word) <= self.most:
            return None
        if not self._maybe(word):
            return None
        found = [e for t, e in self.trie.near(word, 2) if e <= allowed(t)]
        return ("near", 1 / (1 + min(found))) if found else None

    def learn(self, words: set[str]) -> None:
        if len(self.seen) > _SEEN_MOST:
            self.seen.clear()
            self.bad.clear()
        new = words - self.seen
        self.seen |= new
        self.bad.update((w, k) for w in new if (k := self.kind(w)))


FEATURES = 10
#: Weights that the data have to speak against: finds and abuse raise a score, quotation lowers it.
PRIOR = (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.5, 1.0, -1.0, 0.0)


def features(text: str, words: list[str], lexicon: Lexicon) -> list[float]:
    n = len(words)
    out = [0.0] * FEATURES
    out[9] = math.log1p(n) / 10
    if lexicon.bad.keys().isdisjoint(words):
        return out
    exact = near = stem = weight = top = abuse = quoted = hits = 0.0
    spans = [m.span() for m in WORD.finditer(text)]
    marks = [m.span() for m in QUOTED.finditer(text)]
    opens = [a for a, _ in marks]
    for i, w in enumerate(words):
        if found := lexicon.bad.get(w):
            kind, x = found
            hits += 1
            exact, near, stem = exact + (kind == "exact"), near + x * (kind == "near"), stem + (kind == "stem")
            if kind == "stem":
                weight, top = weight + x, max(top, x)
            around = words[max(0, i - NEAR) : i + NEAR + 1]
            k = bisect_right(opens, spans[i][0]) - 1
            if (k >= 0 and spans[i][1] <= marks[k][1]) or not SAID.isdisjoint(around):
                quoted += 1
            elif not YOU.isdisjoint(around):
                abuse += 1
    return [math.log1p(exact), float(exact > 0), near, math.log1p(stem), min(weight, 30) / 10, top / 5, min(10.0, 100 * hits / n), math.log1p(abuse), math.log1p(quoted), out[9]]


def _described(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    lower = [t.lower() for t in texts]
    words = [WORD.findall(t) for t in lower]
    lexicon.learn(set().union(*words))
    return np.array([features(t, w, lexicon) for t, w in zip(lower, words, strict=True)]).reshape(-1, FEATURES)


def _batches(batches: Iterator[pa.RecordBatch], text: int = 0, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices with about ``most`` bytes of text, one row at least."""
    for b in batches:
        for s in slices(pc.binary_length(b.column(text)).fill_null(0).to_pylist(), most):
            yield b.slice(s.start, len(s))


def logistic(x: np.ndarray, y: np.ndarray, prior: Iterable[float] | None = None, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps, halved while they go up; the last weight is the constant. Weights are drawn to ``prior``, or to zero.
    Without rows of both labels every score is the share of ones."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -3.0
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    middle = np.append(np.zeros(len(w) - 1) if prior is None else np.array(tuple(prior), float), 0.0)
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + (penalty * (w - middle) ** 2).sum() / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * (w - middle))
        while loss(w - step) > loss(w) and np.abs(step).max() >= 1e-8:  # a step too far, where the curve is flat
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_described(texts, self.lexicon) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _grams(words: set[str]) -> set[str]:
    """Whole words, and prefixes of 4 to 8 letters with a mark."""
    return words | {f"{w[:k]}*" for w in words for k in range(4, 9) if len(w) > k}


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, terms: Iterable[str] = TERMS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from labelled rows that are not held out, ``sample`` at most, the first by a hash of their id.

    Rows with a null id or label teach nothing; of labels that repeat an id the largest counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("i")).agg(F.max("toxic").cast("int").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample)
    rows = docs.select(F.col(id_col).alias("i"), text_of(text_col).alias("t"))
    rows = keep(rows.join(F.broadcast(known), "i").select("t", "y"), "op6-sample")  # two numbers a row, ``sample`` rows
    total = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)

    def counted(label: int, only: frozenset | None, least: int) -> dict[str, int]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for b in _batches(batches):
                for t in b.column(0).to_pylist():
                    grams = _grams(set(WORD.findall(t.lower())))
                    found.update(grams if only is None else grams & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["g", "n"])

        some = rows.where(F.col("y") == label).select("t").mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
        return {r.g: r.n for r in some.where(F.col("n") >= least).collect()}

    mine = counted(1, None, max(4, toxic // 100))
    other = counted(0, frozenset(mine), 1)
    odds = {g: math.log((n + 0.5) / (toxic + 1)) - math.log((other.get(g, 0) + 0.5) / (clean + 1)) for g, n in mine.items()}
    strong = {g for g, x in odds.items() if x > math.log(20)}
    stems = {g[:-1]: odds[g] for g in strong if g[-1] == "*" and not any(f"{g[:k]}*" in strong for k in range(4, len(g) - 1))}
    words = {g for g in strong if g[-1] != "*" and len(g) > 3 and mine[g] >= toxic / 20 and not any(g[:k] in stems for k in range(4, 9))}
    stems = {s: x for s, x in stems.items() if s not in words and not any(w.startswith(s) for w in {*words, *terms})}
    lexicon = Lexicon({*terms, *words}, stems)
    lexicon.innocent = _innocent(rows, lexicon)
    fresh = Lexicon(lexicon.terms, stems, lexicon.innocent)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_described(b.column(0).to_pylist(), fresh).tolist(), pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = rows.mapInArrow(describe, "x array<double>, y int").collect()
    x, y = np.array([r.x for r in got]).reshape(-1, FEATURES), np.array([r.y for r in got], float)
    return Model(fresh, logistic(x, y, PRIOR))


def _innocent(rows: DataFrame, lexicon: Lexicon) -> frozenset:
    """Words near a term that documents without toxicity have about as often."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for b in _batches(batches):
            for t, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = set(WORD.findall(t.lower()))
                lexicon.learn(words)
                for w in words & lexicon.bad.keys():
                    if lexicon.bad[w][0] == "near":
                        found.setdefault(w, [0, 0])[y > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([n[k] for n in found.values()], pa.int64()) for k in (0, 1))], ["w", "n", "p"])

    sums = rows.mapInArrow(find, "w string, n long, p long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    return frozenset(r.w for r in sums.where("n > p").collect())


def toxicity(docs: DataFrame, model: Model, *, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``held_out``, ``score`` and ``predicted``.

    Null text: empty; it gets the score of a text without words. A null id counts as the empty text for ``held_out``.
    Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(text_of(text_col).alias("t"), F.col(id_col).alias("i"))
    kind = rows.select("i", F.lit(0.0).alias("s")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(model.scores(b.column(0).to_pylist()))], ["i", "s"])

    return rows.mapInArrow(score, kind).select(F.col("i").alias(id_col), held_out(F.col("i")).alias("held_out"), F.col("s").alias("score"), (F.col("s") >= cut).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, *, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows whose score is under the cut, with their own columns, whatever their names.

    Null text: empty, scored as a text without words and kept as null. Ids are not read, so rows with null or repeated
    ids are judged each for itself. An empty table gives an empty result. The columns go through Python once, the text
    among them.
    """
    names, text = docs.columns, docs.columns.index(text_col)
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, text):
            low = model.scores([t or "" for t in b.column(text).to_pylist()]) < cut
            yield b if low.all() else b.filter(pa.array(low))

    return rows.mapInArrow(clean, rows.schema).toDF(*names)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))

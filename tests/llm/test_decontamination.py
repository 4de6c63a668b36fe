import math
import random

import pytest

from weft.llm.decontamination import contaminated, keep_uncontaminated
from weft.llm.words import shingle_hashes, shingles, word_hashes, words_of


def grams(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_hashes_follow_words():
    r = random.Random(1)
    texts = ["".join(r.choice(["ab", "Éa", " ", ", ", "x9", "\n", "日本 ", "...", "İ"]) for _ in range(r.randint(0, 40))) for _ in range(500)] + [""]
    hashes, at = word_hashes(texts)
    known = {}
    for k, t in enumerate(texts):
        own = hashes[at[k] : at[k + 1]].tolist()
        assert len(own) == len(words_of(t))
        for w, h in zip(words_of(t), own):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    every, first = shingles(texts)
    for k, t in enumerate(texts):
        assert every[first[k] : first[k + 1]].tolist() == shingle_hashes(hashes[at[k] : at[k + 1]]).tolist()


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_against_brute_force(spark, block_bytes):
    r = random.Random(7)
    say = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    items = [(k, say(r.randint(3, 40))) for k in range(40)] + [(None, say(9)), (50, None), (51, "")]
    docs = []
    for k in range(150):
        item = (r.choice(items)[1] or "").split()
        if item and k % 4 == 0:
            item[r.randrange(len(item))] = "z"
        docs.append((k, say(r.randint(0, 30)) + " " + ", ".join(item).upper() + " " + say(r.randint(0, 60))))
    docs += [(None, docs[1][1]), (1, docs[1][1]), (200, None), (201, "")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, c0 int").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, i int")
    want = []
    for i, t in docs:
        for j, u in items:
            g = grams(u)
            if g and len(g & grams(t)) >= math.ceil(0.8 * len(g) - 1e-9):
                want.append((i, j, len(g), len(g & grams(t))))
    got = contaminated(d, b, block_bytes=block_bytes).collect()
    assert sorted((tuple(x)[:4] for x in got), key=str) == sorted(want, key=str) and len(want) > 60
    clean = keep_uncontaminated(d, b, block_bytes=block_bytes)
    bad = {w[0] for w in want}
    assert clean.columns == d.columns and sorted((x.doc_id for x in clean.collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)


def test_odd_rows(spark, odd, none):
    b = spark.createDataFrame([(1, "x x x x x x"), (2, None)], "item_id long, text string")
    assert sorted(tuple(x) for x in contaminated(odd, b).collect()) == [(7, 1, 1, 1, 1.0)] * 2
    assert contaminated(none, b).count() == 0 and contaminated(odd, b.limit(0)).count() == 0
    assert keep_uncontaminated(odd, b.limit(0)).count() == 10


def test_short_items_and_small_blocks(spark):
    """Items of one to four words are found as they stand, in one block or many, if asked for."""
    r = random.Random(4)
    pool = ["Alpha", "beta", "gamma", "delta", "Épsilon"]
    say = lambda n: " ".join(r.choice(pool) for _ in range(n))
    docs = [(k, say(r.randint(0, 9))) for k in range(120)] + [(200, None), (201, ""), (202, "...")]
    items = [(k, say(r.randint(1, 4))) for k in range(25)] + [(30, say(7)), (31, None), (32, "?!")]
    words = lambda t: words_of(t)
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for i, a in items:
        n = min(5, len(words_of(a)))
        own = runs(words_of(a), n) if n else set()
        for d, t in docs:
            if own and len(own & runs(words_of(t), n)) >= 0.8 * len(own) - 1e-9:
                want.add((d, i, len(own), len(own & runs(words_of(t), n))))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 200):
        assert {tuple(x)[:4] for x in contaminated(d, b, block_bytes=size, short_items=True).collect()} == want
        assert {x.doc_id for x in keep_uncontaminated(d, b, block_bytes=size, short_items=True).collect()} == {i for i, _ in docs} - {w[0] for w in want}

import itertools
import random
import zlib

import numpy as np

from weft.llm.common import table
from weft.llm.toxicity import Automaton, Lexicon, Trie, allowed, features, keep_clean, logistic, toxicity, train

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_and_trie():
    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(60)]
    trie = Trie(words)
    for w, most in itertools.product(words, (0, 1, 2)):
        a = Automaton(w, most)
        for v in words:
            state = a.start
            for c in v:
                state = a.step(state, c)
            d = distance(w, v)
            assert a.errors(state) == (d if d <= most else None)
        assert dict(trie.near(w, most)) == {v: distance(w, v) for v in words if distance(w, v) <= most}


def test_no_misspelling_is_lost():
    """The quick refusal of words never refuses one that the automaton would find."""
    terms = ["idiot", "pathetic", "worthless", "scum"]
    lexicon = Lexicon(terms, {"vequ": 3.0})
    r = random.Random(2)
    for _ in range(4000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = [r.choice("abcdeiopst")] if r.random() < 0.6 else []
        w = "".join(w)
        found = any(distance(w, t) <= allowed(t) for t in terms)
        assert (lexicon.kind(w) is not None) == found, w
    assert lexicon.kind("vequaire") == ("stem", 3.0) and lexicon.kind("veq") is None


def test_logistic():
    x = np.array([[0.0], [0.0], [1.0], [1.0]] * 20)
    w = logistic(x, np.array([0.0, 0.0, 1.0, 1.0] * 20))
    assert w[0] > 3 and logistic(x, np.zeros(80))[0] == 0
    rare = np.zeros((2000, 1))
    rare[:20] = 3.0
    assert 1 < logistic(rare, (rare[:, 0] > 0).astype(float), [1.0])[0] < 10  # Newton's full steps would run away from here


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in toxicity(docs, train(docs, labels)).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    known = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    good = [(a > b) + 0.5 * (a == b) for a, x in known for b, y in known if x > y]
    assert sum(good) / len(good) > 0.75


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (7, None), (None, 1), (5, 0), (5, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        model = train(odd, some)
        assert toxicity(odd, model).count() == 10 and toxicity(none, model).count() == 0
        assert keep_clean(odd, model, cut=2.0).columns == odd.columns and keep_clean(odd, model, cut=2.0).count() == 10
        assert keep_clean(odd, model, cut=0.0).count() == 0


def test_misspelled_and_quoted(spark):
    docs = table(spark, SF, "documents")
    model = train(docs, table(spark, SF, "labels"))
    plain, bad, typo = model.scores(["the and of " * 30, "you idiot and moron " + "the and of " * 30, "you idiiot " + "the and of " * 30])
    assert plain < 0.3 <= bad and plain <= typo


def test_quotation_and_each_misspelling(spark):
    docs = table(spark, SF, "documents")
    model = train(docs, table(spark, SF, "labels"))
    fill = "the and of " * 30
    abuse, *quoted = model.scores([f"you stupid idiot {fill}", f'the note "you stupid idiot over there" was read {fill}', f"«you stupid idiot» {fill}", f"someone wrote you stupid idiot once {fill}"])
    assert all(q < abuse for q in quoted)
    plain, *typos = model.scores([fill, *(f"{w} {fill}" for w in ("idiott", "moronn", "patetic", "worthles", "disgustng", "imbecille"))])
    assert all(plain < t for t in typos)


def test_features_against_brute_force():
    r = random.Random(9)
    terms, stems = ["idiot", "pathetic", "scum"], {"vequ": 3.0}
    lexicon = Lexicon(terms, stems)

    def kind(w):
        if w in terms:
            return "exact", 1.0
        if w[:4] in stems:
            return "stem", 3.0
        near = [distance(w, t) for t in terms if distance(w, t) <= allowed(t)]
        return ("near", 1 / (1 + min(near))) if near else None

    pool = ["idiot", "idoit", "idiots", "patetic", "scum", "scums", "vequor", "you", "said", "tree", "sea", "walk"]
    for _ in range(300):
        words, quote = [r.choice(pool) for _ in range(r.randint(0, 40))], []
        inside = sorted(r.sample(range(len(words) + 1), 2)) if len(words) > 2 and r.random() < 0.5 else [0, 0]
        text = " ".join(('"' if k == inside[0] < inside[1] else "") + w + ('"' if k == inside[1] - 1 and inside[0] < inside[1] else "") for k, w in enumerate(words))
        lexicon.learn(set(words))
        found = [(k, *kind(w)) for k, w in enumerate(words) if kind(w)]
        near = [set(words[max(0, k - 6) : k + 7]) for k, _, _ in found]
        quote = [inside[0] <= k < inside[1] or "said" in a for (k, _, _), a in zip(found, near)]
        abuse = sum("you" in a and not q for a, q in zip(near, quote))
        count = lambda name: sum(n == name for _, n, _ in found)
        length = np.log1p(len(words)) / 10
        want = [np.log1p(count("exact")), float(count("exact") > 0), sum(x for _, n, x in found if n == "near"), np.log1p(count("stem")), min(3.0 * count("stem"), 30) / 10,
                0.6 * (count("stem") > 0), min(10.0, 100 * len(found) / max(1, len(words))), np.log1p(abuse), np.log1p(sum(quote)), length]
        assert np.allclose(features(text, words, lexicon), want), text

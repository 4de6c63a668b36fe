import random
from collections import defaultdict

from weft.llm.near_dedup import Similar, bins, buckets, components, edits, keep_one, kmers, masks, near_classes, order_minhash
from weft.llm.words import words_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edits():
    r = random.Random(1)
    for _ in range(3000):
        a = [r.choice("abc") for _ in range(r.randint(0, 12))]
        b = [x for x in a if r.random() < 0.8] + [r.choice("abc") for _ in range(r.randint(0, 4))] if r.random() < 0.7 else [r.choice("abc") for _ in range(r.randint(0, 12))]
        d = distance(a, b)
        for most in (0, 1, 2, 3, 5, 20):
            assert edits(masks(a), len(a), b, most) == (d if d <= most else None), (a, b, most)


def test_order_counts():
    w = [f"w{k}" for k in range(60)]
    swapped = w[30:] + w[:30]
    (a, b, c), rows = order_minhash([" ".join(w), " ".join(w).upper(), " ".join(swapped)])
    assert rows.tolist() == [0, 1, 2] and (a == b).all()
    plain = len(set(kmers([" ".join(w)])[0].tolist()) & set(kmers([" ".join(swapped)])[0].tolist())) / 60
    assert (a == c).mean() < plain**2  # fewer than if order did not count


def test_repeats_are_labelled():
    x, first = kmers(["a b c d e " * 4, "a b c d e f"])
    assert first.tolist() == [0, 16, 18] and len(set(x[:16].tolist())) == 16 and x[16] == x[0]


def test_sketches_do_not_depend_on_the_batch():
    once, again = "a b c d e f g h", "x y z u v x y z u v x"
    assert (order_minhash([once])[0][0] == order_minhash([once, again])[0][0]).all()


def variants(r, n):
    say = lambda k: [r.choice("bcdfgh") + r.choice("aeiou") + r.choice("lmnrst") for _ in range(k)]
    texts = []
    for _ in range(n):
        base = say(r.randint(30, 120))
        texts.append(base)
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(texts[-3:]))
            for _ in range(max(1, len(w) // r.choice([12, 20, 60]))):
                w[r.randrange(len(w))] = r.choice(say(1))
            texts.append(w)
    return [" ".join(t) for t in texts]


def test_classes_against_brute_force(spark):
    r = random.Random(3)
    texts = variants(r, 25)
    texts += [texts[0], texts[5].upper().replace(" ", ", "), "one two", "two one", "One, two!", "", "", "x", None]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, texts[1]), (3, texts[3])]
    got = near_classes(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, key int").repartition(3)).collect()
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    test = Similar(0.8)
    seq = [words_of(t) for _, t in docs]
    for a in range(len(docs)):
        test.hold(seq[a])
        for b in range(a):
            if (docs[a][1] or "") == (docs[b][1] or "") or seq[a] and seq[b] and test(seq[b]):
                up[top(a)] = top(b)
    groups = defaultdict(list)
    for k in range(len(docs)):
        groups[top(k)].append(docs[k][0])
    want = sorted(((i, min(x for x in g if x is not None), len(g)) for g in groups.values() for i in g), key=str)
    assert sorted((tuple(g)[:3] for g in got), key=str) == want


def test_long_chain(spark):
    links = spark.createDataFrame([(bytes([k]), bytes([k + 1])) for k in range(40)] + [(bytes([100]), bytes([90]))], "a binary, b binary")
    got = {bytes(r[0]): bytes(r[1]) for r in components(links).collect()}
    assert got == {bytes([k]): bytes([0]) for k in range(41)} | {bytes([90]): bytes([90]), bytes([100]): bytes([90])}


def test_buckets():
    w = [f"w{k}" for k in range(300)]
    x, rows = buckets([" ".join(w), "", " ".join([*w[:100], "new", *w[100:]]), " ".join(f"v{k}" for k in range(300))])
    assert rows.tolist() == [0, 2, 3] and x.shape == (3, 64)
    assert 0 < (x[0] == x[1])[32:].sum() <= (x[0] == x[1])[:32].sum() and not (x[0] == x[2]).any()


def test_one_of_each_class_stays(spark, odd, none):
    r = random.Random(4)
    texts = variants(r, 12)
    rows = [(k + 1, t, "x") for k, t in enumerate(texts)] + [(0, texts[4], "y"), (0, texts[4], "y"), (None, texts[5], "z"), (None, "alone and here", "z"), (None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    first = {(g.class_id, g.class_size) for g in near_classes(docs).collect()}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((g.doc_id for g in got), key=str) == sorted((c for c, _ in first if c is not None), key=str) + [None, None]
    assert {(g.doc_id, g.text, g.key) for g in got} <= set(rows) and keep_one(none).count() == 0 and keep_one(odd).columns == odd.columns


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.class_id, r.class_size) for r in near_classes(odd).collect()}
    assert {(7, 7, 2), (3, 3, 3), (4, 3, 3), (None, 3, 3), (1, 1, 3), (2, 1, 3), (None, 1, 3)} < got
    assert near_classes(none).count() == 0


def passage_pairs(r, n):
    """Texts with one passage in common, and for each a text at a similarity of about 0.85 that has the passage too."""
    say = lambda k: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(k)]
    passage, texts = say(50), []
    for _ in range(n):
        own = say(r.randint(120, 160))
        other = list(own)
        for k in range(2, len(own), 5):  # so no run of five words stays but those of the passage
            other[k] = say(1)[0]
        texts += [" ".join([*own[:60], *passage, *own[60:]]), " ".join([*other[:60], *passage, *other[60:]])]
    return texts


def test_every_shared_sketch_is_decided(spark):
    texts = passage_pairs(random.Random(6), 40)
    x = buckets(texts)[0]
    test, up, by_band = Similar(0.8), list(range(len(texts))), 0
    for a in range(len(texts)):
        test.hold(words_of(texts[a]))
        for b in range(a):
            if (x[a] == x[b])[:32].any() and test(words_of(texts[b])):
                by_band += (x[a] == x[b])[32:].any()
                up[a] = up[b]
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    linked = sum(k != c for k, c in enumerate(up))
    assert linked > 20 and by_band < linked / 2
    assert got == dict(enumerate(up))


def test_bins_never_exceed_edits():
    r = random.Random(7)
    for _ in range(200):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 30))] for _ in range(2))
        x, y = bins([" ".join(a), " ".join(b)]).astype(int)
        assert x.sum() == len(a) and abs(x - y).sum() + abs(len(a) - len(b)) <= 2 * distance(a, b)
        x, y = bins([" ".join(a), " ".join(b)], 1024, 2).astype(int)
        assert x.max() <= 2 and abs(x - y).sum() + abs(len(a) - len(b)) <= 2 * distance(a, b)

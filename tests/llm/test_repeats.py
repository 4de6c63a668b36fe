import hashlib
import random
import time

import numpy as np

from weft.llm.common import table
from weft.llm.repeats import DEPTH, WIDTH, Part, _met, remove_repeats


def brute(docs):
    """[(id, bytes, removed, spans, digest)]"""
    low = {}
    raw = [(float("-inf") if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for s in range(len(b) - DEPTH + 1):
            w = b[s : s + DEPTH]
            low[w] = min(i, low.get(w, i))
    for (i, b), (own, _) in zip(raw, docs):
        gone = bytearray(len(b))
        for s in range(len(b) - DEPTH + 1):
            if low[b[s : s + DEPTH]] < i:
                gone[s : s + DEPTH] = b"\1" * DEPTH
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        yield own, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def test_against_brute_force(spark):
    r = random.Random(6)
    say = lambda n: "".join(r.choice(["th", "er", "on", " ", "é", "a", "\n"]) for _ in range(n))
    pool = [say(r.randint(20, 200)) for _ in range(12)] + ["x" * 70, "ab" * 45, "license line that many documents share, word for word, as it is."]
    docs = [(k, "".join(r.choice(pool) if r.random() < 0.6 else say(r.randint(0, 60)) for _ in range(r.randint(0, 9)))) for k in range(160)]
    docs += [(200 + k, docs[k][1]) for k in range(20)] + [(300 + k, docs[0][1][:-30] + say(3) + docs[0][1][-30:]) for k in range(20)]
    docs += [(None, docs[3][1]), (7, docs[7][1]), (7, pool[0] + pool[1]), (400, None), (401, ""), (402, "q" * 49), (403, "q" * 49), (404, "z" * 50), (405, "z" * 50), (-5, pool[-1])]
    r.shuffle(docs)
    got = remove_repeats(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, part int").repartition(6)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs), key=str)


def test_whole_table(spark):
    docs = [(x.doc_id, x.text) for x in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = remove_repeats(table(spark, "/root/testdata/sf0.001", "documents").repartition(5), texts=True).collect()
    assert sorted(tuple(g)[:5] for g in got) == sorted(brute(docs))
    assert all(hashlib.sha256(g.kept).hexdigest() == g.kept_sha256 and len(g.kept) == g.n_bytes - g.n_removed for g in got)


def test_odd_rows(odd, none):
    rows = [(x.doc_id, x.text) for x in odd.collect()]
    assert sorted(map(tuple, remove_repeats(odd).collect()), key=str) == sorted(brute(rows), key=str)
    assert remove_repeats(none).count() == 0


def test_hash_of_zero(monkeypatch):
    """A gram whose hash is 0 is an anchor like any other: every window of a document holds one."""
    raw = bytes(range(40, 106))
    plain = Part([raw], np.array([1]))
    least = plain.anchors[len(plain.anchors) // 2]
    digest = Part.digest
    monkeypatch.setattr(Part, "digest", lambda self, a, b: np.where(np.asarray(a) == least, np.uint64(0), digest(self, a, b)))
    anchors = Part([raw], np.array([1])).anchors
    assert all(((anchors >= s) & (anchors < s + WIDTH)).any() for s in range(len(raw) - DEPTH + 1))


def test_gaps_give_the_anchors_back():
    r = random.Random(2)
    docs = [bytes(r.choices(b"ab cd", k=n)) for n in (0, 49, 50, 400, 0, 7, 83, 2000, 12)]
    ids = np.arange(len(docs))
    found = Part(docs, ids)
    again = Part(docs, ids, found.gaps())
    for x in ("anchors", "owner", "keys", "begin", "ends"):
        assert getattr(found, x).tolist() == getattr(again, x).tolist()
    assert [len(g) > 0 for g in found.gaps()] == [len(d) >= DEPTH for d in docs]


def test_what_meets_is_cut_by_part_in_linear_time():
    """Six gigabytes have hundreds of parts in each bucket; a look at all rows for each part would take minutes here."""
    kind = np.dtype([("key", "<u8")])

    def odd(every):
        use = every["key"] % 2 == 1
        return use, every[use]

    keys = np.arange(1_200_000, dtype=np.uint64).view(kind)
    sent = [(part, keys[30 * part : 30 * part + 30]) for part in range(40_000)]
    began = time.process_time()
    got = list(_met(sent, odd))
    assert time.process_time() - began < 5
    assert [p for p, _ in got] == list(range(40_000))
    assert all(own["key"].tolist() == list(range(30 * p + 1, 30 * p + 30, 2)) for p, own in got)
    none = list(_met([(0, keys[:1]), (1, keys[:0]), (2, keys[1:3])], odd))
    assert [(p, own["key"].tolist()) for p, own in none] == [(2, [1])]


def test_many_parts(spark):
    """A passage that all parts share, and others that some share."""
    r = random.Random(8)
    say = lambda n: "".join(r.choice(["th", "er", "on", " ", "a"]) for _ in range(n))
    pool = [say(80) for _ in range(6)]
    docs = [(k, say(9) + pool[0] + say(20) + r.choice(pool) + say(k % 50)) for k in range(240)]
    got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(48, "doc_id")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs))

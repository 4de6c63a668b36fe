"""Each stage of the pipeline on its own input against brute force, and run() against the stages."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weft.llm.common import keep, table
from weft.llm.near_dedup import Similar
from weft.llm.tokens import default_vocabulary
from weft.llm.toxicity import toxicity, train
from weft.llm.words import words_of

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def results(spark):
    """The input of each stage and the last result, by name."""
    docs, found = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = docs
        docs = keep(stage(spark, docs, SF), f"test-{name}")
    return found | {"end": docs}


def rows(frame):
    return {r.doc_id: r.text or "" for r in frame.collect()}


def test_order_and_columns(spark, results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(results[n].columns == table(spark, SF, "documents").columns for n in STAGES)


def test_toxicity(spark, results):
    docs = results["toxicity"]
    scored = toxicity(docs, train(docs, table(spark, SF, "labels"))).collect()
    assert sorted(rows(results["exact_dedup"])) == sorted(r.doc_id for r in scored if r.score < 0.3)
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    kept = rows(results["exact_dedup"])
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in kept for i in clean) >= 0.9 * len(clean)


def test_exact_dedup(results):
    best = {}
    for i, t in rows(results["exact_dedup"]).items():
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        best[t] = max(i, best.get(t, i))
    assert sorted(rows(results["near_dedup"])) == sorted(best.values())


def test_near_dedup(results):
    docs = sorted(rows(results["near_dedup"]).items())
    test, up = Similar(0.8), {i: i for i, _ in docs}
    seq = {i: words_of(t) for i, t in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (a, _) in enumerate(docs):
        test.hold(seq[a])
        for b, _ in docs[:k]:
            if seq[a] and seq[b] and test(seq[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    assert sorted(rows(results["decontamination"])) == sorted(i for i in up if up[i] == i)


def test_decontamination(spark, results):
    grams = lambda t: {tuple(w[k : k + 5]) for w in [words_of(t)] for k in range(len(w) - 4)}
    items = [g for r in table(spark, SF, "benchmark").collect() if (g := grams(r.text))]
    bad = lambda t: any(len(g & own) >= math.ceil(0.8 * len(g) - 1e-9) for own in [grams(t)] for g in items)
    docs = rows(results["decontamination"])
    assert sorted(rows(results["packing"])) == sorted(i for i, t in docs.items() if not bad(t))


def test_packing(results):
    tokenizer = Tokenizer.from_file(default_vocabulary())
    docs, pieces, bins = rows(results["packing"]), defaultdict(list), defaultdict(list)
    for r in results["end"].collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == docs.keys()
    for i, own in pieces.items():
        ids = np.array([*tokenizer.encode(docs[i], add_special_tokens=False).ids, 0], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[-1].start + own[-1].length == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    total = 0
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
        total += at
    assert len(bins) <= math.ceil(total / 2048) * 1.05 + 1


def test_run(spark, results):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, results["end"].select(got.columns).collect()))


def test_empty_and_odd_input(spark, odd, none):
    """Rows without an id or a text pass through every stage; an empty table stays empty."""
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = keep(stage(spark, docs, SF), f"odd-{name}")
        assert docs.columns[0] == "doc_id"
    assert docs.count() == 0

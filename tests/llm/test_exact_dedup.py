import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weft.llm.exact_dedup import LOWER, UPPER, exact_dedup, keep_last, sha256

FOLD = str.maketrans(UPPER, LOWER)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    for i, t in rows:
        t = (t or "").translate(FOLD)
        yield i, best[t], len(groups[t]), i == best[t], hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("digest", [sha256, lambda t: F.substring(sha256(t), 1, 0), lambda t: F.length(t).cast("string").cast("binary")])
def test_against_brute_force(spark, odd, digest):
    """Also with digests that all or many texts share."""
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = exact_dedup(odd.repartition(3), digest=digest).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_empty(none):
    assert exact_dedup(none).count() == 0


def test_no_python(spark, odd):
    plan = exact_dedup(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_last_of_each_group_stays(odd, none):
    kept = keep_last(odd)
    assert kept.columns == odd.columns and keep_last(none).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = {(best, (t or "").translate(FOLD)) for (_, t), (_, best, *_) in zip(rows, brute(rows), strict=True)}
    assert sorted(((r.doc_id, (r.text or "").translate(FOLD)) for r in kept.collect()), key=str) == sorted(want, key=str)

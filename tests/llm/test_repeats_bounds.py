"""op9's memory is bounded by bytes and records, whatever the partitions of the input are."""

import random

import numpy as np
import pyarrow as pa

from weft.llm import repeats
from weft.llm.repeats import BLOCK, CHUNK, _lay


def test_a_part_is_no_more_than_a_chunk_and_a_text():
    size = CHUNK // 4
    texts = [chr(97 + k) * size for k in range(11)]
    batch = pa.RecordBatch.from_arrays([pa.array([5] * 11, pa.int64()), pa.array(range(11), pa.int64()), pa.array(texts)], ["part", "i", "t"])
    laid = [r for b in _lay(iter([batch])) for r in zip(b["part"].to_pylist(), b["i"].to_pylist())]
    assert [p for p, _ in laid] == [(5 << 32) + k // 4 for k in range(11)]
    assert [i for _, i in laid] == list(range(11))


def test_questions_leave_in_blocks():
    found = (np.zeros(BLOCK // 4 + 1, np.uint8) for _ in range(9))
    sizes = [len(x) for x in repeats._blocks(found, np.concatenate)]
    assert len(sizes) == 3 and max(sizes) <= BLOCK + BLOCK // 4 and sum(sizes) == 9 * (BLOCK // 4 + 1)
    assert list(repeats._blocks(iter([]), np.concatenate)) == []


def test_one_partition_of_several_parts(spark):
    r = random.Random(3)
    own = ["".join(r.choices("abcdefgh ", k=3_000_000)) for _ in range(4)]
    docs = [*enumerate(own), (10, own[0]), (11, "x" * 10 + own[2][:2_000_000]), (12, own[1][-60:] + "y")]
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((g.doc_id, g.n_removed) for g in got) == [(0, 0), (1, 0), (2, 0), (3, 0), (10, 3_000_000), (11, 2_000_000), (12, 60)]

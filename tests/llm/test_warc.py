import hashlib

from weft.llm.common import scratch
from weft.llm.warc import read_archives, with_payloads, write_archives

LONG, WIDE = "a" * 100, "ü" * 50
PAGES = [
    (5, "http://a/5", LONG), (3, "http://a/3 x\r\ny", LONG), (9, None, LONG), (None, "http://a/n", LONG), (1, "u", "a" * 99), (2, "u", "a" * 99), (7, "u", WIDE),
    (8, "u", WIDE), (10, "u", None), (11, "u", ""), (4, "é", "WARC/1.1\r\n\r\n" * 9000), (12, "u", "WARC/1.1\r\n\r\n" * 9000), (3, "u", LONG), (None, "u", "z" * 200), (None, "u", "z" * 200),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(4)
    archives = write_archives(pages, scratch(spark, "w"), roll=400)
    assert archives.count() > 4 and archives.groupBy().sum("records").first()[0] == len(PAGES)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        ids = [j for j, _, h in PAGES if (h or "").encode() == data and j is not None]
        first = min(ids) if len(data) >= 100 and ids else i
        again = first != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    got = read_archives(archives).collect()
    assert sorted((tuple(g)[:5] for g in got), key=str) == sorted(want, key=str)
    whole = with_payloads(read_archives(archives, payloads=True)).collect()
    assert sorted(bytes(r.payload) for r in whole) == sorted((h or "").encode() for _, _, h in PAGES)


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(write_archives(none, scratch(spark, "w"))).count() == 0

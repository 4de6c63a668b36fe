"""WARC archives with revisit resolution.

Headers (id, digest, length), never payloads, are shuffled by payload digest to find each payload's first response.
Only digests that more than one page has are kept; that table is written, so its size is known when pages are joined
with it: a small one is broadcast, a large one is joined by shuffle. Tasks write whole archives of gzip members under
the shared folder; a task that runs again leaves the same file.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import file_system, keep, scratch, table

LEAST = 100
_URN = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _record(kind: str, head: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in head.items() if v is not None), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def _urn(page: int | None) -> str:
    return f"<{_URN}{'' if page is None else page}>"


def _uri(url: str | None) -> str | None:
    return None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def resolve(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Columns page_id, url, payload, digest, size, first, first_url of each page; ``first`` is set for pages whose payload
    of at least ``least`` bytes a page with a smaller id has too."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "size": F.length("payload").cast("long")})
    heads = p.where(F.col("size") >= least).select("page_id", "url", "digest")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f")
    known = keep(heads.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1 and f is not null").select("digest", "f"), "op3-first")
    joined = p.join(known, "digest", "left")
    again = F.col("f").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("f.page_id"))
    return joined.select("page_id", "url", "payload", "digest", "size", F.when(again, F.col("f.page_id")).alias("first"), F.when(again, F.col("f.url")).alias("first_url"))


def write_archives(pages: DataFrame, folder: str, *, roll: int = 256 << 20, date: str | None = None, **cols) -> DataFrame:
    """Write the pages as archives below a folder; returns one row (path, records) per archive.

    Null html: empty payload. Payloads under 100 bytes are always responses. Null ids are never referred to, and come
    back null; rows that repeat the id of a response are responses too. Null urls have no target header. Other columns
    are ignored. An empty table gives no archive.
    """
    rows = resolve(pages, **cols)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for page, url, payload, digest, size, first, first_url in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    head = {"WARC-Record-ID": _urn(page), "WARC-Date": date, "WARC-Target-URI": _uri(url), "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                    if first is None:
                        yield _record("response", head, http + payload)
                    else:
                        yield _record("revisit", head | {"WARC-Profile": _PROFILE, "WARC-Refers-To": _urn(first), "WARC-Refers-To-Target-URI": _uri(first_url)}, http)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        part, found, todo = TaskContext.get().partitionId(), [], records(batches)
        head = next(todo, None)
        while head is not None:
            name, own = f"{top}/part-{part:06d}-{len(found):04d}.warc.gz", f"{top}/.{uuid4().hex}"
            with fs.open_output_stream(own, compression=None) as out:
                info = _record("warcinfo", {"WARC-Record-ID": f"<urn:archive:{part}-{len(found)}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                out.write(info)
                size, n = len(info), 0
                while head is not None and size < roll:
                    out.write(head)
                    size, n, head = size + len(head), n + 1, next(todo, None)
            fs.move(own, name)
            found.append((f"{folder}/{name.rpartition('/')[2]}", n))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["path", "records"])

    return keep(rows.mapInArrow(write, "path string, records long"), "op3-archives")


def _headers(file) -> dict[str, str]:
    found = {}
    while line := file.readline().strip():
        key, _, value = line.decode().partition(":")
        found[key.strip().lower()] = value.strip()
    return found


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(_URN)
    return int(number) if number else None


def read_records(file, payloads: bool) -> Iterator[tuple]:
    """The response and revisit records of an open archive, digests of responses checked against their payloads."""
    with gzip.GzipFile(fileobj=file) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:80]!r}")
            head = _headers(f)
            block = f.read(int(head["content-length"]))
            if (kind := head["warc-type"]) not in ("response", "revisit"):
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            digest = head["warc-payload-digest"].removeprefix("sha256:")
            if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"{head['warc-record-id']}: payload and digest differ")
            refers = _page(head.get("warc-refers-to")) if kind == "revisit" else None
            yield _page(head["warc-record-id"]), size, digest, kind, refers, head.get("warc-target-uri"), payload if payloads and kind == "response" else None


def read_archives(archives: DataFrame, *, payloads: bool = False) -> DataFrame:
    """One row per response or revisit record of the archives that a ``path`` column names (schema ``RECORD``)."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = file_system(path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(at, compression=None) as file:
                    for row in read_records(file, payloads):
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if len(rows) == 2000 or held > 32 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    n = archives.count()
    return archives.select("path").repartitionByRange(max(1, min(n, 10_000)), "path").mapInArrow(read, RECORD)


def with_payloads(records: DataFrame) -> DataFrame:
    """Records read with their payloads, revisits with that of the response they refer to."""
    responses = records.where("record_type = 'response' and page_id is not null").groupBy("page_id", "payload_digest").agg(F.first("payload").alias("original"))
    joined = records.join(responses.withColumnRenamed("page_id", "refers_to"), ["refers_to", "payload_digest"], "left")
    return joined.withColumn("payload", F.coalesce("payload", "original")).select(records.columns)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "op3-warc"))
    return read_archives(archives).drop("url", "payload")


OP3_SQL = f"""
with p as (select page_id, coalesce(html, '') as h from pages),
     f as (select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest, min(page_id) over (partition by h) as first from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {LEAST} and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {LEAST} and page_id <> first then first end as refers_to
from f
"""

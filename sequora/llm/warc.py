"""WARC archives: write with an index first, then read records by coalesced byte ranges.

``write`` deals the pages out to tasks; each task appends its records, each compressed by itself, to one archive file
and returns their index rows (file, offset, length, url, digest). The index is committed as a table, so it names
only the files of tasks that ended well; what a lost or repeated task left is never read. ``read`` takes any
selection of the index, sorts it by file and offset, joins neighbouring ranges into one read, and parses the
records. Each response's payload is measured and hashed as it is read: a record whose headers claim other bytes, or another digest, raises ``Damaged``.

Of pages with equal payloads the one with the largest page_id is a ``response`` record, the others are
``revisit`` records that refer to it and carry no payload. Payloads shorter than ``min_revisit_bytes`` are all
responses. Null html counts as empty, a null url as an empty one; a null page_id is smaller than any other. Of rows that
share payload and page_id one is the response. An empty table writes no archive and gives an empty index; columns other than page_id,
url and html are not read, whatever their names. A payload of any length is one record, read and written whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequora.llm import bitmap
from sequora.llm.store import cut, fresh_path

#: Bytes between two records that are read along rather than with a second request.
GAP_BYTES = 64 * 1024
#: Bytes that one read holds at most, but for a longer record.
READ_BYTES = 8 * 1024 * 1024
INDEX = "page_id long, file string, offset long, length long, url string, digest string"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: What Hadoop and its distributions call stores that the reader here knows by another name.
STORES = {"s3a://": "s3://", "s3n://": "s3://", "gcs://": "gs://", "dbfs:/": "file:///dbfs/"}


def _open(uri: str):
    """(file system, path) of a URI of the shared store: local, HDFS or an object store."""
    from pyarrow import fs

    for hadoop, plain in STORES.items():
        if uri.startswith(hadoop):
            uri = plain + uri[len(hadoop) :].lstrip("/")
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _clean(value: str) -> str:
    """Header values are one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: headers, the HTTP headers as captured, and for a response the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Damaged(ValueError):
    """A record whose headers do not fit its bytes."""


def parse(data: bytes) -> dict:
    """The fields of a compressed record. Length and digest of a response are those of the payload that was read; headers that say otherwise raise."""
    data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise Damaged(f"{fields['WARC-Record-ID']}: a block of {size} bytes is claimed, {len(rest) - 4} are there")
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) else None
    revisit = fields["WARC-Type"] == "revisit"
    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    if not revisit:
        claimed, digest, length = (digest, length), base32_sha1(payload), len(payload)
        if claimed != (digest, length):
            raise Damaged(f"{fields['WARC-Record-ID']}: digest and length {claimed} are claimed, the payload has {(digest, length)}")
    elif payload:
        raise Damaged(f"{fields['WARC-Record-ID']}: a revisit record carries a payload")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_digest": digest,
        "payload_bytes": length,
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = gzip.compress(record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"], r["revisit"]), 4, mtime=0)
                out.write(data)
                rows.append({"page_id": r["page_id"], "file": f"{folder}/{name}", "offset": at, "length": len(data), "url": r["url"], "digest": base32_sha1(r["html"].encode())})
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string())]))
        if out is not None:
            out.close()

    return run


def revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, revisit, refers_to) for each page; payloads that certainly have no copy stay in place."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    hashed = F.xxhash64("html")
    long = rows.where(F.octet_length("html") >= min_revisit_bytes)
    twice = bitmap.repeated(long.select(hashed), bitmap.bits_for(rows.count()))
    marked = rows.withColumn("maybe", (F.octet_length("html") >= min_revisit_bytes) & bitmap.probe(twice, hashed))
    again = marked.where("maybe").drop("maybe").withColumn("row", F.monotonically_increasing_id()).withColumn("sha", F.sha2("html", 256))
    best = again.groupBy("sha").agg(F.max(F.struct("page_id", "row")).alias("best")).repartition(F.col("best.row"))
    met = again.join(best.hint("merge"), "sha")
    revisit = F.col("row") != F.col("best.row")
    met = met.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("best.page_id")).alias("refers_to"))
    alone = marked.where("not maybe").select("page_id", "url", "html", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to"))
    return alone.unionByName(met)


def write(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives; returns their index, one row per page."""
    folder = fresh_path(pages.sparkSession, "warc")
    return cut(revisits(pages, min_revisit_bytes).mapInArrow(_writer(folder), INDEX), "warc-index")


def ranges(rows: list[dict]) -> Iterator[tuple[int, int, list[dict]]]:
    """(start, end, records): rows of one file in order of offset, neighbours joined into one read."""
    group: list[dict] = []
    for r in rows:
        if group and (r["offset"] - (group[-1]["offset"] + group[-1]["length"]) > GAP_BYTES or r["offset"] + r["length"] - group[0]["offset"] > READ_BYTES):
            yield group[0]["offset"], group[-1]["offset"] + group[-1]["length"], group
            group = []
        group.append(r)
    if group:
        yield group[0]["offset"], group[-1]["offset"] + group[-1]["length"], group


def _reader(payload: bool):
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    kind = kind if payload else kind.remove(len(kind) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for batch in batches:
            rows = batch.to_pylist()
            while rows:
                same = next((i for i, r in enumerate(rows) if r["file"] != rows[0]["file"]), len(rows))
                if rows[0]["file"] != name:
                    if opened is not None:
                        opened.close()
                    name = rows[0]["file"]
                    store, path = _open(name)
                    opened = store.open_input_file(path)
                for start, end, group in ranges(rows[:same]):
                    data = opened.read_at(end - start, start)
                    yield pa.RecordBatch.from_pylist([parse(data[r["offset"] - start : r["offset"] - start + r["length"]]) for r in group], kind)
                rows = rows[same:]
        if opened is not None:
            opened.close()

    return run


#: Bytes of archives that one reading task is to fetch.
STRETCH_BYTES = 16 * 1024 * 1024


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that a selection of the index names; without ``payload`` its bytes stay in the task.

    Tasks get neighbouring records of the sorted selection, as many tasks as the records' bytes ask for.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.select("file", "offset", "length").repartitionByRange(int(total // STRETCH_BYTES) + 1, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_reader(payload), RECORD if payload else RECORD.removesuffix(", payload binary"))


def select(spark: SparkSession, index: DataFrame, url_like: str) -> DataFrame:
    """Records whose url fits a LIKE pattern."""
    return read(index.where(F.col("url").like(url_like)))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read all records back: what the archives say of each page."""
    return read(write(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('{_B32}', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM q
"""

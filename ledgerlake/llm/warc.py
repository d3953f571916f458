"""WARC archives with an index first.

Every task writes the records of its rows to archives of its own, one gzip member a record,
and returns index rows: file, offset, length, URL and digest. Only files that the committed
index names are ever read, so a lost or repeated task does no harm. Reads sort the byte ranges
of the selected records, coalesce close ones and parse what they fetch.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import discard, new_path, staged

#: Bytes of an archive after which the next one begins; bytes handed to the file system at once.
ARCHIVE_BYTES, WRITE_BYTES = 512 << 20, 4 << 20
#: A read spans gaps up to the first and ends beyond the second; one task's ranges lie in the third.
GAP_BYTES, READ_BYTES, TASK_BYTES = 64 << 10, 8 << 20, 16 << 20
#: Digests that more than one record has, up to which they are broadcast (about 100 bytes each).
BROADCAST_DIGESTS = 100_000
DATE = "2000-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    digits = value[len("<urn:page:") : -1] if value else "null"
    return None if digits == "null" else int(digits)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (headers, no payload) if it refers to another page."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else 'urn:none'}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload facts of one record; a stored payload is measured and hashed anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if len(payload) != stated or digest_of(payload) != digest:
            raise ValueError("a payload does not match its headers")
    return {"page_id": page_of(fields["warc-record-id"]), "payload_bytes": stated, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page_of(fields.get("warc-refers-to")), "payload": payload}


def revisit_table(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``digest_, first_`` for every payload of ``min_bytes`` or more that several records hold."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    heads = pages.where(F.octet_length(body) >= min_bytes).select(F.col(id_col).cast("bigint").alias("page_id"), F.sha1(body.cast("binary")).alias("digest_"))
    shared = heads.groupBy("digest_").agg(F.min("page_id").alias("first_"), F.count(F.lit(1)).alias("n"))
    return shared.where("n > 1 and first_ is not null").select("digest_", "first_")


INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, digest string, record_type string"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, level: int = 1) -> DataFrame:
    """Write every row as a record below ``folder`` (a URI) and return the staged index.

    Of records with equal payloads of ``min_bytes`` or more the one with the smallest page id
    is a response and the others revisit it; rows that repeat that id are responses too.
    Null bodies are empty payloads. A null id is written as such and never referred to; a
    null URL becomes ``urn:none`` in the record and stays null in the index.
    """
    firsts = staged(revisit_table(pages, id_col, body_col, min_bytes), "firsts")
    if firsts.count() <= BROADCAST_DIGESTS:
        firsts = F.broadcast(firsts)
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.cast("binary").alias("body"), F.sha1(body.cast("binary")).alias("digest_"))
    rows = rows.join(firsts, "digest_", "left").select("page_id", "url", "body", F.when(F.col("page_id").eqNullSafe(F.col("first_")) | (F.octet_length("body") < min_bytes), None).otherwise(F.col("first_")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at, held = None, "", 0, []
        for batch in batches:
            index = []
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.write(b"".join(held))
                        out.close()
                    name, at, held = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out = store.open_output_stream(f"{base}/{name}", compression=None)  # members are compressed one by one
                digest = digest_of(payload)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(make_record(page_id, url, payload, digest, refers)) + packer.flush()
                index.append((page_id, url, name, at, len(member), digest, "response" if refers is None else "revisit"))
                held.append(member)
                at += len(member)
            if sum(map(len, held)) >= WRITE_BYTES:
                out.write(b"".join(held))
                held = []
            if index:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.write(b"".join(held))
            out.close()

    return staged(rows.mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Reads that cover sorted (offset, length) ranges: start, end, and the ranges inside."""
    start = end = 0
    inside: list[tuple[int, int]] = []
    for offset, length in rows:
        if inside and (offset - end > GAP_BYTES or offset + length - start > READ_BYTES):
            yield start, end, inside
            inside = []
        if not inside:
            start = end = offset
        inside.append((offset, length))
        end = max(end, offset + length)
    if inside:
        yield start, end, inside


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Fetch the records of the selected index rows: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and, if asked for, ``payload``."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            wanted: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                wanted.setdefault(file, []).append((offset, length))
            for file, rows in wanted.items():
                if file != name:
                    source and source.close()
                    name, source = file, store.open_input_file(f"{base}/{file}")
                for start, end, inside in ranges(rows):
                    data = source.read_at(end - start, start)
                    found = [parse_record(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in inside]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], k) for c, k in zip(names, kinds)], names)
        source and source.close()

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = 1 + 2 * total // TASK_BYTES  # by the bytes to fetch, of which the index rows themselves show nothing
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / TASK_BYTES)).sortWithinPartitions("file", "offset")
    return staged(dealt.mapInArrow(run, schema), "warc-records", rows=4096)  # index rows are short


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read every record back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder)

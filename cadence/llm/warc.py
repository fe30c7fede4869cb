"""WARC archives: a writer of one gzip member per record, and a sequential reader
that decompresses incrementally, frames records by content length and verifies
their digests.

The archives are real ``.warc.gz`` files in the shared folder; a table of their
paths is what is passed on, so files of a task that was lost and repeated are
never read.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import saved
from cadence.session import checkpoint_dir

#: Fixed values of the format.
VERSION, CRLF = b"WARC/1.1", b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_ID, REFERS_TO = "X-Page-ID", "X-Refers-To-Page-ID"
#: Date of all records (pages have none), bytes after which a task starts another
#: archive, bytes read at a time, payload bytes of a batch, and least payload bytes of a revisit.
DATE, ARCHIVE_BYTES, CHUNK, BATCH_BYTES, LEAST_REVISIT = "2024-01-01T00:00:00Z", 256 << 20, 64 << 10, 8 << 20, 0


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed as a gzip member of its own."""
    digest = sha1_base32(payload)
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _id(page_id, url, digest), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = urllib.parse.quote(url, safe="/:?#[]@!$&'()*+,;=%~")
    if page_id is not None:
        head[PAGE_ID] = str(page_id)
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, REFERS_TO: str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}",
             "WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Length": str(len(block))}
    return member(head, block)


def member(head: dict[str, str], block: bytes) -> bytes:
    raw = CRLF.join([VERSION, *(f"{k}: {v}".encode() for k, v in head.items()), b"", block, b"", b""])
    z = zlib.compressobj(wbits=31)
    return z.compress(raw) + z.flush()


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:]) if k}


class Damaged(ValueError):
    """An archive that ends inside a record, or whose records are not framed as stated."""


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of a binary stream, one after the other.
    A block is as long as its content length says; a member may hold nothing else."""
    chunk = stream.read(CHUNK)
    while chunk:
        z, raw, head, need, start = zlib.decompressobj(wbits=31), bytearray(), None, None, 0
        while not z.eof:
            if not chunk:
                raise Damaged("archive ends inside a member")
            try:
                raw += z.decompress(chunk)
            except zlib.error as e:
                raise Damaged(f"not a gzip member: {e}") from e
            chunk = z.unused_data or stream.read(CHUNK) if z.eof else stream.read(CHUNK)
            if head is None and (end := raw.find(CRLF * 2)) >= 0:
                if not raw.startswith(b"WARC/"):
                    raise Damaged("not a WARC record")
                head, start = _headers(bytes(raw[:end])), end + 4
                length = head.get("content-length", "")
                if not (length.isascii() and length.isdigit()):
                    raise Damaged(f"content length {length!r}")
                need = start + int(length)
            if need is not None and len(raw) > need + 4:
                raise Damaged("record longer than its content length")
        if head is None or len(raw) != need + 4 or not raw.endswith(CRLF * 2):
            raise Damaged("record not framed by its content length")
        yield head, bytes(raw[start:need])


def _mark(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, payload, keeper): keeper is the largest page_id of the pages
    with this payload, null for payloads under ``least`` bytes."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                     F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    sha = p.withColumn("sha", F.sha1("payload"))
    keepers = saved(sha.where(F.length("payload") >= least).groupBy("sha").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "keepers")
    return sha.join(keepers, "sha", "left").select("page_id", "url", "payload", "keeper")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns
    the table of the archives, (path, n_records, n_bytes).

    Of rows with equal payloads (html in UTF-8, null: empty) of at least ``least``
    bytes, that with the largest page_id is the response and the others revisit it;
    repeated rows of that page_id are all responses, as are rows whose payload has
    no page_id at all. An empty table gives no archives; a very long payload is one record;
    columns other than the three, whatever their names, are not read. The payloads' digests meet as narrow rows; the table of
    repeated payloads has one row each, and a payload that a third of the pages
    share is a skewed join that adaptive execution splits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        made: list[tuple[str, int, int]] = []
        out, path, n, size = None, "", 0, 0
        for b in batches:
            for page_id, url, payload, keeper in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "keeper")), strict=True):
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0  # an attempt has names of its own
                    out = store.open_output_stream(path, compression=None)
                    size += out.write(member({"WARC-Type": "warcinfo", "WARC-Record-ID": _id(path), "WARC-Date": DATE,
                                              "Content-Type": "application/warc-fields", "Content-Length": "0"}, b""))
                size += out.write(record(page_id, url, payload, keeper, keeper is not None and keeper != page_id))
                n += 1
                if size >= archive_bytes:
                    out.close()
                    made.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            made.append((path, n, size))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)],
                                             ["path", "n_records", "n_bytes"])

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return saved(_mark(pages, least).mapInArrow(run, "path string, n_records long, n_bytes long"), "archives")


RECORD = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, digest_ok boolean")
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The responses and revisits (RECORD) of a table of archives, an archive per task
    at a time, read sequentially.

    ``payload`` is null for revisits, whose ``payload_bytes`` and ``payload_digest``
    are those stated for the page they revisit, null where none is; ``digest_ok`` tells whether
    the SHA-1 digests stated for the block, and for a response's payload, hold, and is null
    for a record that states none (other writers may leave them out). A truncated or badly
    framed archive raises :class:`Damaged`. No archives give no rows."""
    fields = [c.split() for c in RECORD.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)],
                                          [n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        rows, held = [], 0
        for b in batches:
            for path in b["path"].to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    for head, block in records(stream):
                        if head.get("warc-type") not in ("response", "revisit"):
                            continue
                        rows.append(_row(head, block))
                        held += len(block)
                        if held >= BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(run, RECORD)


def _row(head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(CRLF * 2)
    revisit = head["warc-type"] == "revisit"
    stated = {k: v[5:].upper() for k in ("block", "payload") if (v := head.get(f"warc-{k}-digest", "")).startswith("sha1:")}
    digest = stated.get("payload") if revisit else sha1_base32(payload)
    held = [stated[k] == sha1_base32(x) for k, x in (("block", block), ("payload", payload)) if k in stated and not (revisit and k == "payload")]
    ok = all(held) if held else None
    number = lambda k: int(head[k.lower()]) if k.lower() in head else None
    length = _headers(http).get("content-length", "")
    size = (int(length) if length.isdigit() else None) if revisit else len(payload)
    return (number(PAGE_ID), head.get("warc-target-uri"), None if revisit else payload, size, digest, head["warc-type"],
            number(REFERS_TO), ok)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all ``pages`` written to archives and read back."""
    folder = checkpoint_dir(spark, "warc")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('{_BASE32}', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INT + 1, 1)
                   FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper IS NULL OR page_id = keeper THEN NULL ELSE keeper END AS refers_to,
  TRUE AS digest_ok
FROM q
"""

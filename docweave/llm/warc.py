"""WARC archives: written once with an index, read back by coalesced byte ranges.

Each task writes its own file of gzip members (one per record) through pyarrow's file systems and returns an index row per
record: file, offset, length, URL, digest. The index is a table; only files that it names count, so a retried or
lost task leaves at most an unnamed file behind. Reading starts from the index: the selected records are sorted by file and
offset, neighbours are fetched in one read, and each record is checked against its digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import new_path, remove, stored, tidy


@dataclass(frozen=True)
class Settings:
    """Records of equal payloads of at least ``min_revisit`` bytes become revisits. A read joins records up to ``max_gap`` bytes apart and ends beyond ``max_read``; ``block`` bytes of a file go to one task."""

    min_revisit: int = 0
    max_gap: int = 64 << 10
    max_read: int = 8 << 20
    block: int = 32 << 20
    level: int = 6


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hexadecimal string: five digits are four characters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substr(alphabet, F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def planned(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pages with payload (bytes), digest, payload_bytes and refers_to (null: a response of its own).

    The largest page_id of equal payloads is the response. Only digests and ids are grouped, with map-side combination.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", base32_of_hex(F.sha1("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = rows.groupBy("digest").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("digest").alias("_digest"), "_first")
    revisit = (F.col("payload_bytes") >= settings.min_revisit) & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return rows.join(first, F.col("digest") == F.col("_digest"), "left").select("page_id", "url", "payload", "digest", "payload_bytes", F.when(revisit, F.col("_first")).alias("refers_to"))


def record_id(page_id: int | None, digest: str, place: str) -> str:
    """Of page and payload, so that a revisit can name its response; where there is no page_id, of the place in the archives."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'place:{place}' if page_id is None else f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int, place: str = "") -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has no payload; both types name the full payload's digest."""
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, place)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else page_id)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest, "")), ("X-Refers-To-Page-ID", refers_to)]
    body = payload if refers_to is None else b""
    headers += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(body))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", level, mtime=0)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not the start of a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


INDEX = "page_id long, url string, digest string, refers_to long, file string, offset long, length long"


def writer(folder: str, settings: Settings):
    """Batches of (page_id, url, payload, digest, refers_to) to index rows; one new file per task attempt."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = files.FileSystem.from_uri(folder)
        name, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                where: list[tuple[int, int]] = []
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    data = record(*row, settings.level, f"{name}:{offset}")
                    out.write(data)
                    where.append((offset, len(data)))
                    offset += len(data)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array([f"{folder}/{name}"] * len(where), pa.string()), pa.array([w[0] for w in where], pa.int64()), pa.array([w[1] for w in where], pa.int64())],
                    names=["page_id", "url", "digest", "refers_to", "file", "offset", "length"],
                )
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Write a record per page below folder (a URI that all executors reach) and return the stored index.

    The index is itself a stored table: it is complete only if every task was, and reading it never writes records again.
    """
    rows = planned(pages, settings).select("page_id", "url", "payload", "digest", "refers_to")
    return stored(rows.mapInArrow(writer(folder, settings), INDEX), "warc-index")


def reader(settings: Settings):
    """Batches of (file, offset, length, digest), sorted, to records; neighbouring records come in one read."""

    def fetch(rows: list[tuple]) -> Iterator[tuple]:
        store, path = files.FileSystem.from_uri(rows[0][0])
        with store.open_input_file(path) as source:
            k = 0
            while k < len(rows):
                start = end = rows[k][1]
                first = k
                while k < len(rows) and rows[k][1] - end <= settings.max_gap and rows[k][1] + rows[k][2] - start <= max(settings.max_read, rows[k][2]):
                    end = rows[k][1] + rows[k][2]
                    k += 1
                source.seek(start)
                data = source.read(end - start)
                for _, offset, length, digest in rows[first:k]:
                    headers, block = parsed(zlib.decompress(data[offset - start : offset - start + length], 31))
                    kind = headers["warc-type"]
                    if headers["warc-payload-digest"] != f"sha1:{digest}" or kind == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                        raise ValueError(f"digest differs at {offset} of {rows[0][0]}")
                    page, refers = headers["x-page-id"], headers.get("x-refers-to-page-id")
                    yield int(page) if page else None, headers.get("warc-target-uri"), kind, digest, block if kind == "response" else None, int(refers) if refers else None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "url", "record_type", "payload_digest", "payload", "refers_to"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for row in fetch(held):
                out.append(row)
                if len(out) >= 500:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    yield from flush()
                    held = []
                held.append(row)
        if held:
            yield from flush()

    return read


def read_records(index: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The records that index names (a selection of write_archives()' rows): page_id, url, record_type, payload_digest, payload, refers_to.

    A task has whole blocks of files, sorted by file and offset. A revisit's payload is null; refers_to names its response.
    """
    block = F.floor(F.col("offset") / settings.block)
    rows = index.select("file", "offset", "length", "digest").repartition(F.col("file"), block).sortWithinPartitions("file", "offset")
    return rows.mapInArrow(reader(settings), "page_id long, url string, record_type string, payload_digest string, payload binary, refers_to long")


@tidy
def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records, read all records back, and report each page's payload and record type.

    A revisit takes the size of its payload from the response that it refers to. Null html is an empty payload; pages of one
    null or repeated page_id have a record each (with one WARC-Record-ID only where page_id and html are the same). Of equal payloads (ties), the largest page_id is the response; rows that
    repeat it are responses too, and null ids are the least. Very long payloads are one record. Other columns aren't looked at; an empty table gives no rows.
    """
    folder = new_path(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    slim = read_records(index).select("page_id", F.octet_length("payload").cast("long").alias("_bytes"), "payload_digest", "record_type", "refers_to")
    records = stored(slim, "records")
    remove(spark, folder)
    sizes = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("_bytes").alias("_of"))
    out = records.join(sizes, "payload_digest", "left")
    return out.select("page_id", F.coalesce("_bytes", "_of").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((CAST('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5) AS BIGINT) >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)), '') AS payload_digest
  FROM p
), f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM f
"""

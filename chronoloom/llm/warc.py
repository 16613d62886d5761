"""WARC archives compressed record by record with a dictionary of their own.

A file starts with a skippable frame (magic ``0x184D2A5D``) that holds the
Zstandard dictionary; every record after it is one frame, so a record can be
read alone from its offset.  The dictionary is trained on the records that the
file archives, so it never depends on a global sample.

Defined cases: a null payload is an empty one; rows without an id are written
as revisits of the smallest id with the same payload, or as responses if no row
with that payload has an id; rows that repeat both id and payload are all
written with the type of that id; a null url is written as an empty one; an
empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import open_fs, spread
from chronoloom.plans.materialize import materialize, new_folder

SKIPPABLE_DICTIONARY = 0x184D2A5D
PAGE = "urn:page:"
#: Payload bytes gathered for one file; a file has at least one record.
FILE_BYTES = 24 << 20
#: Size of a file's dictionary, and how many times that many bytes of its records train it.
DICT_BYTES, TRAIN_FACTOR = 64 << 10, 32
LEVEL = 3
MANIFEST = "path string, records long, payload_bytes long, file_bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, length long"


def _date(page_id) -> str:
    return "2024-01-01T00:00:00Z"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the response's HTTP header but not its body."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    own = f"{PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}|{digest}')}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Date: {_date(page_id)}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{PAGE}{refers_to}>",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Dictionary of evenly spaced records; plain content of them where there are too few to train on."""
    total = sum(map(len, records))
    step = max(1, -(-total // max(1, size * TRAIN_FACTOR)))
    chosen = records[::step]
    if len(chosen) >= 16 and total >= 8 * 1024:
        try:
            fitted = min(size, max(1024, sum(map(len, chosen)) // 8))
            return zstd.train_dictionary(fitted, chosen, k=256, d=8, level=LEVEL).as_bytes()
        except zstd.ZstdError:
            pass
    return b"".join(x[: max(64, size // max(1, len(chosen)))] for x in chosen)[-size:]


def write_file(folder: str, records: list[bytes]) -> tuple[str, int]:
    """Write one archive under a name of its own; only names in a committed manifest count."""
    content = train_dictionary(records)
    dictionary = zstd.ZstdCompressionDict(content)
    packer = zstd.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    store, path = open_fs(f"{folder}/part-{uuid.uuid4().hex}.warc.zst")
    size = 0
    with store.open_output_stream(path, compression=None) as out:
        head = struct.pack("<II", SKIPPABLE_DICTIONARY, len(content)) + content
        out.write(head)
        size += len(head)
        for x in records:
            size += out.write(packer.compress(x)) or 0
    return path.rsplit("/", 1)[1], size


def parse_record(raw: bytes) -> dict:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = next(int(x.split(":", 1)[1]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
    ident = lambda x: int(x[1 + len(PAGE) : -1]) if x and x.startswith(f"<{PAGE}") else None
    return {
        "page_id": ident(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": ident(fields.get("WARC-Refers-To")),
        "payload": body,
    }


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _frames(stream, size: int) -> Iterator[tuple[int, int, bytes]]:
    """Offset, compressed length and content of every record's frame, a few MB at a time."""
    magic, length = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE_DICTIONARY:
        raise ValueError("the archive has no leading dictionary frame")
    dictionary = zstd.ZstdCompressionDict(stream.read(length))
    opener = zstd.ZstdDecompressor(dict_data=dictionary)
    at, buffer, frame, parts = 8 + length, b"", opener.decompressobj(), []
    used = 0
    while True:
        if not buffer:
            buffer = stream.read(1 << 20)
            if not buffer:
                break
        before = len(buffer)
        parts.append(frame.decompress(buffer))
        rest = frame.unused_data if frame.eof else b""
        used += before - len(rest)
        buffer = rest
        if frame.eof:
            yield at, used, b"".join(parts)
            at, used, parts, frame = at + used, 0, [], opener.decompressobj()


def read_file(folder: str, name: str) -> Iterator[dict]:
    """Every record of one archive, checked against its own digest and length."""
    store, path = open_fs(f"{folder}/{name}")
    with store.open_input_stream(path, compression=None) as stream:
        for offset, length, raw in _frames(stream, 0):
            x = parse_record(raw)
            if x["record_type"] == "response" and (
                len(x["payload"]) != x["payload_bytes"] or base32_sha1(x["payload"]) != x["payload_digest"]
            ):
                raise ValueError(f"{name} at {offset}: the payload doesn't match its digest")
            yield x | {"path": name, "offset": offset, "length": length}


def read_record(folder: str, name: str, offset: int, length: int) -> dict:
    """One record by its place, without reading the others."""
    store, path = open_fs(f"{folder}/{name}")
    with store.open_input_file(path) as f:
        size = struct.unpack("<II", f.read(8))[1]
        dictionary = zstd.ZstdCompressionDict(f.read(size))
        f.seek(offset)
        return parse_record(zstd.ZstdDecompressor(dict_data=dictionary).decompress(f.read(length), max_output_size=1 << 31))


def with_original(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = 0) -> DataFrame:
    """Adds the smallest id of an equal payload.

    The smallest ids come from an aggregate with map-side combine; the join back
    is a plain equi-join, so a digest that a third of all pages share is split
    by the skew join.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = first.where("n > 1 and first_id is not null").select("sha1", "first_id")
    same: Column = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    long_enough = F.octet_length("payload") >= revisit_from
    return rows.join(first, "sha1", "left").withColumn("refers_to", F.when(same & long_enough, F.col("first_id"))).drop("first_id")


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, revisit_from: int = 0, **columns) -> DataFrame:
    """Archive every page; returns the committed manifest, one row per file."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, total = [], 0, 0

        def flush() -> pd.DataFrame:
            name, stored = write_file(folder, held)
            return pd.DataFrame({"path": [name], "records": [len(held)], "payload_bytes": [total], "file_bytes": [stored]})

        for pdf in batches:
            refers = pdf["refers_to"].astype("Int64")
            for page, url, payload, sha1, ref in zip(pdf["page_id"].astype("Int64"), pdf["url"], pdf["payload"], pdf["sha1"], refers, strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                x = make_record(None if page is pd.NA else int(page), url, bytes(payload), digest, None if ref is pd.NA else int(ref))
                held.append(x)
                size += len(x)
                total += len(payload)
                if size >= file_bytes:
                    yield flush()
                    held, size, total = [], 0, 0
        if held:
            yield flush()

    marked = with_original(pages, revisit_from=revisit_from, **columns)
    return materialize(marked.mapInPandas(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the archives that the manifest names, with their places."""
    columns = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                rows: list[dict] = []
                for x in read_file(folder, name):
                    rows.append({k: x[k] for k in columns})
                    if len(rows) >= 5000:
                        yield _frame(rows, columns)
                        rows = []
                if rows:
                    yield _frame(rows, columns)

    return spread(manifest.select("path", "payload_bytes"), "path", "payload_bytes").mapInPandas(read, RECORD)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=columns)
    for c in ("page_id", "refers_to"):
        pdf[c] = pdf[c].astype("Int64")
    return pdf


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to shared archives and read every record back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **options), folder)


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The same answer in SQL, over a table ``pages``.
ORACLE = f"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
marked AS (SELECT page_id, octet_length(encode(p))::BIGINT AS payload_bytes, sha1(p) AS s, min(page_id) OVER (PARTITION BY p) AS low FROM rows),
digits AS (SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(s, 5 * g + 1, 5))::BIGINT) AS twenties FROM marked)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(twenties, lambda v: concat({', '.join(f"substr('{_BASE32}', ((v >> {k}) & 31) + 1, 1)" for k in (15, 10, 5, 0))})), '') AS payload_digest,
  CASE WHEN low IS NOT NULL AND page_id IS DISTINCT FROM low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
FROM digits"""

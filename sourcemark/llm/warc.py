"""WARC archives, and the normaliser of archives that were gzipped as one stream.

``write_archives`` puts pages into archives of bounded size, each one gzip stream; equal payloads
are stored once, later pages revisit the first. ``normalise`` inflates each such stream once,
rewrites every record as a gzip member of its own and writes a sidecar index of offsets.
``read_archives`` fetches the members by that index.

Scale: payloads are not shuffled; only digests that repeat meet the pages, broadcast after a count
or joined by shuffle. A task holds one record besides its buffers. Files carry fresh names and
count only if their task's row was written, so retried and lost tasks leave nothing behind that
is read.

Edge cases: null html is an empty payload. Payloads of fewer than ``least`` bytes are always
responses. Rows of one payload that share the smallest page id are all responses; where no page of
a payload has an id, all are responses. Control signs and non-ASCII characters in a URL are
percent-encoded, a null URL leaves its header out. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemark.llm.common import scratch_folder, settle
from sourcemark.llm.shared_files import create, open_file, open_stream
from sourcemark.operators.joins import small_side

# An archive is closed once it holds this many bytes of records.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
LEAST = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "null" else int(number)


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, which tells the length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=";/?:@&=+$,#!~*'()%[]-_.")))
    fields.append(("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _written(folder: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uri = stream = packer = None
    size = 0

    def closed() -> pa.RecordBatch:
        stream.write(packer.flush())
        stream.close()
        return pa.record_batch([pa.array([uri])], ["archive"])

    for batch in batches:
        for page_id, url, html, refers_to in zip(*(column for column in batch.columns), strict=True):
            if stream is None:
                uri, stream = create(f"{folder}/whole", ".warc.gz")
                packer, size = zlib.compressobj(1, zlib.DEFLATED, 31), 0
            data = record(page_id.as_py(), url.as_py(), html.as_py() or b"", refers_to.as_py())
            stream.write(packer.compress(data))
            size += len(data)
            if size >= limit:
                yield closed()
                stream = None
    if stream is not None:
        yield closed()


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of one gzip stream each, below ``folder``: rows (archive)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    found = rows.join(small_side(repeated), F.col("digest") == F.col("_digest"), "left")
    return settle(
        found.select("page_id", "url", "payload", refers.alias("refers_to"))
        .mapInArrow(lambda it: _written(folder, limit, it), "archive string")
    )


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, a piece at a time."""
    unpacker, rest = None, b""
    while True:
        data = rest or read(READ_BYTES)
        rest = b""
        if not data:
            if unpacker is not None and not unpacker.eof:
                raise EOFError("the gzip stream is cut off")
            return
        if unpacker is None or unpacker.eof:
            unpacker = zlib.decompressobj(31)
        piece = unpacker.decompress(data, 4 * READ_BYTES)
        while piece:
            yield piece
            piece = unpacker.decompress(unpacker.unconsumed_tail, 4 * READ_BYTES) if unpacker.unconsumed_tail else b""
        rest = unpacker.unused_data


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a stream of records; only one record is held."""
    buffer = bytearray()
    ended = False

    def more() -> None:
        nonlocal ended
        piece = next(pieces, None)
        if piece is None:
            ended = True
        else:
            buffer.extend(piece)

    while True:
        searched = 0
        while (end := buffer.find(b"\r\n\r\n", searched)) < 0 and not ended:
            searched = max(0, len(buffer) - 3)
            more()
        if end < 0:
            if buffer.strip():
                raise EOFError("the last record is cut off")
            return
        headers = _headers(bytes(buffer[:end]))
        size = end + 4 + int(headers["content-length"]) + 4
        while len(buffer) < size and not ended:
            more()
        if len(buffer) < size:
            raise EOFError("the last record is cut off")
        yield headers, bytes(buffer[:size])
        del buffer[:size]


def _normalised(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0):
            uri, out = create(f"{folder}/records", ".warc.gz")
            side, index = create(f"{folder}/records", ".index.jsonl")
            offset = 0
            with open_stream(archive.as_py()) as source, out, index:
                for headers, data in records(inflated(source.read)):
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(data) + packer.flush()
                    out.write(member)
                    entry = {"record": headers["warc-record-id"], "type": headers["warc-type"], "offset": offset, "length": len(member)}
                    index.write((json.dumps(entry) + "\n").encode())
                    offset += len(member)
            yield pa.record_batch([pa.array([uri]), pa.array([side])], ["file", "index"])


def _one_each(archives: DataFrame) -> DataFrame:
    """Archives are few and heavy: dealt over all tasks."""
    spark = archives.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return archives.repartition(count)


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Every record a member of its own: rows (file, index)."""
    return settle(_one_each(archives).mapInArrow(lambda it: _normalised(folder, it), "file string, index string"))


def _parsed(member: bytes) -> tuple:
    (headers, data), *others = records(inflated(_reader(member)))
    if others:
        raise ValueError("a member holds more than one record")
    block = data[data.index(b"\r\n\r\n") + 4 : -4]
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(_headers(head)["content-length"])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
    refers = headers.get("warc-refers-to")
    return _page(headers["warc-record-id"]), length, digest, kind, None if refers is None else _page(refers)


def _reader(data: bytes) -> Callable[[int], bytes]:
    left = [data]
    return lambda size: left.pop() if left else b""


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for uri, side in zip(batch.column(0), batch.column(1), strict=True):
            rows: list[tuple] = []
            with open_stream(side.as_py()) as stream, open_file(uri.as_py()) as archive:
                for line in stream.read().splitlines():
                    entry = json.loads(line)
                    archive.seek(entry["offset"])
                    rows.append(_parsed(archive.read(entry["length"])))
            columns = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_archives(files: DataFrame) -> DataFrame:
    """The records of normalised archives, one row each."""
    return _one_each(files).mapInArrow(
        _read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    )


def round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them and read them back."""
    folder = folder or scratch_folder(pages.sparkSession, "warc")
    return read_archives(normalise(write_archives(pages, folder, least, limit), folder))


def oracle_sql(least: int = LEAST) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [f"('0x' || substr(h, {5 * g + 1}, 5))::BIGINT" for g in range(8)]
    base32 = " || ".join(f"substr('{letters}', (({v} >> {s}) & 31)::INTEGER + 1, 1)" for v in groups for s in (15, 10, 5, 0))
    return f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
r AS (SELECT *, payload_bytes >= {least} AND page_id <> first AS again FROM f)
SELECT page_id, payload_bytes, {base32} AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM r"""

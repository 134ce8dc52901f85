"""WARC archives: written with revisit records and segmented blocks, read back by reassembling segments.

Writing: pages with equal payloads share one response record, the others are revisit records that refer to
it. Digests and compressed payloads are written to the shared folder first, so that the responses, which come from
a grouping that carries one payload of a digest for each task, and the revisits, which carry none, see the same
rows. A payload is framed as chunked transfer; a block longer than `SEGMENT` bytes is cut into a response
record and continuation records. Spark's text writer puts one record on each "line"; the line separator is
the blank lines that end a WARC record, so the files are plain (gzip-compressed) WARC.

Reading: each file is parsed record by record. Segments are grouped by the identifier of the record they continue
and ordered by segment number; records of one segment are finished where they are read. The total length, the
chunk framing and the payload digest are verified.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.llm.common import discard, scratch_dir
from weekcast.operators.panel import spread_join

#: Bytes of block in one record, bytes in one transfer chunk, records in one file (a file stays below 32 MB).
SEGMENT = 16 << 10
TRANSFER_CHUNK = 8 << 10
FILE_RECORDS = 2000
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PARSED = "origin string, segment long, kind string, page_id {kind}, refers_to {kind}, digest string, total long, payload_bytes long, packed binary"
#: Records of a digest from which its revisits are dealt to several tasks.
COPIES_PER_TASK = 1_000_000


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cuts(raw: bytes, size: int) -> Iterator[bytes]:
    """`raw` in parts of at most `size` bytes that never split a character."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        yield raw[at:end]
        at = end


def chunked(payload: bytes) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(part), part) for part in cuts(payload, TRANSFER_CHUNK)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked transfer; raises on broken framing."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken transfer chunk")
        at = end + 4 + size
        if not size:
            if at != len(body):
                raise ValueError("bytes behind the last transfer chunk")
            return b"".join(parts)
        parts.append(part)


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n{block.decode()}"


def records(row: dict) -> Iterator[str]:
    """The records of one page, without the blank lines at their end."""
    name = lambda page, number: f"<urn:page:{'' if page is None else page}:{number}>"
    own = name(row["page_id"], row["row"])
    # a header is one line: other characters of the address are percent-encoded
    url = None if row["url"] is None else "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in row["url"])
    fields = [("WARC-Record-ID", own), ("WARC-Target-URI", url), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("X-Page-ID", row["page_id"]), ("Content-Type", "application/http;msgtype=response")]
    if row["row"] != row["target_row"]:
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(row["target_page"], row["target_row"])), ("X-Refers-To-Page-ID", row["target_page"])]
        yield _record(more + fields, HTTP + b"Content-Length: %d\r\n\r\n" % row["payload_bytes"])
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(zstandard.decompress(row["packed"]))
    parts = list(cuts(block, SEGMENT))
    if len(parts) == 1:
        yield _record([("WARC-Type", "response"), *fields], block)
        return
    yield _record([("WARC-Type", "response"), ("WARC-Segment-Number", 1), *fields], parts[0])
    for i, part in enumerate(parts[1:], 2):
        total = len(block) if i == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{i}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", total)], part)


def write_archive(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> None:
    """Write every row of `pages` as WARC records below `path`.

    Null html is an empty payload, a null url or id leaves its header out. Of rows with equal payloads the one
    with the largest id is the response (of several such rows one); null ids are smallest. Empty input writes
    an empty archive. Other columns are not read.
    """
    kind = pages.schema[id_column].dataType.simpleString()
    own = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(html_column), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("html").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "row")), pa.array(map(digest_of, raws), pa.string()), pa.array(map(len, raws), pa.int64()), pa.array([zstandard.compress(r, 3) for r in raws], pa.binary())], ["page_id", "url", "row", "digest", "payload_bytes", "packed"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(records(row), pa.string())], ["record"])

    spark, payloads = pages.sparkSession, f"{scratch_dir(pages.sparkSession)}/payloads"
    spelt = own.mapInArrow(digests, f"page_id {kind}, url string, row long, digest string, payload_bytes long, packed binary")
    spelt.write.parquet(payloads)
    known = spark.read.schema(spelt.schema).parquet(payloads)
    same = ["digest", "payload_bytes"]
    first = known.groupBy(*same).agg(F.max(F.struct("page_id", "row", "url")).alias("target"), F.first("packed").alias("packed"))
    responses = first.select("target.page_id", "target.url", "target.row", *same, "packed", F.col("target.page_id").alias("target_page"), F.col("target.row").alias("target_row"))
    # rows without payloads: a digest that very many pages have is dealt to several tasks
    targets = known.groupBy(*same).agg(F.max(F.struct("page_id", "row")).alias("target"))
    every = spread_join(known.drop("packed"), targets, same, COPIES_PER_TASK)
    revisits = every.where(F.col("row") != F.col("target.row")).select("page_id", "url", "row", *same, F.lit(None).cast("binary").alias("packed"), F.col("target.page_id").alias("target_page"), F.col("target.row").alias("target_row"))
    ready = responses.unionByName(revisits)
    written = ready.mapInArrow(lines, "record string").write.option("lineSep", END.decode()).option("compression", "gzip")
    written.option("maxRecordsPerFile", FILE_RECORDS).text(path)
    discard(spark, payloads)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an uncompressed WARC file."""
    at = 0
    while at < len(raw):
        end = raw.index(END, at)
        version, *lines = raw[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record where one should begin")
        fields = {name.lower(): value for name, value in (line.split(": ", 1) for line in lines)}
        start = end + len(END)
        at = start + int(fields["content-length"])
        if raw[at : at + len(END)] != END:
            raise ValueError("a record's length is wrong")
        yield fields, raw[start:at]
        at += len(END)


def _whole(rows: list[tuple]) -> tuple[int, bytes | None]:
    """(payload bytes, payload) of one record from its segments' (origin, segment, kind, digest, total, block), in
    order; a revisit has no payload."""
    origin, _, kind, digest, _, _ = rows[0]
    block, total = b"".join(r[5] for r in rows), rows[-1][4]
    if [r[1] for r in rows] != list(range(1, len(rows) + 1)) or total not in (None, len(block)) or (len(rows) > 1) != (total is not None):
        raise ValueError(f"segments of {origin} are missing or doubled")
    http, body = block.split(END, 1)
    if kind == "revisit":
        return int(re.search(rb"Content-Length: (\d+)", http)[1]), None
    payload = unchunked(body) if b"Transfer-Encoding: chunked" in http else body
    if digest_of(payload) != digest:
        raise ValueError(f"the payload of {origin} doesn't match its digest")
    return len(payload), payload


def read_archive(spark: SparkSession, path: str, id_kind: str = "bigint", payloads: bool = True) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload_bytes, payload) of each page in the archive.

    A revisit's payload is null; its length and digest are those of the full payload. Without `payloads` all are
    null, though verified. An empty archive gives no rows. A record with a missing or doubled segment, a wrong
    total length, broken framing or a payload that doesn't match its digest raises.
    """
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[id_kind]
    of = lambda text: text if text is None or id_kind == "string" else int(text)
    names = ["origin", "segment", "kind", "page_id", "refers_to", "digest", "total", "payload_bytes", "packed"]
    types = [pa.string(), pa.int64(), pa.string(), arrow, arrow, pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def kept(payload: bytes | None) -> bytes | None:
        return zstandard.compress(payload, 1) if payloads and payload is not None else None

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records with their length, segments with their block."""
        for batch in batches:
            for content in batch.column("content"):
                raw = zlib.decompressobj(31).decompress(content.as_py())
                rows = []
                for f, block in parse(raw):
                    origin, kind, total = f.get("warc-segment-origin-id", f["warc-record-id"]), f["warc-type"], f.get("warc-segment-total-length")
                    digest, total = f.get("warc-payload-digest", "").removeprefix("sha1:"), None if total is None else int(total)
                    segment, size = int(f.get("warc-segment-number", 1)), None
                    if "warc-segment-number" in f:
                        packed = zstandard.compress(block, 1)
                    else:
                        size, payload = _whole([(origin, segment, kind, digest, total, block)])
                        packed = kept(payload)
                    rows.append((origin, segment, kind, of(f.get("x-page-id")), of(f.get("x-refers-to-page-id")), digest, total, size, packed))
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 256]), types)], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> Iterator[tuple]:
            if not held:
                return
            head, size, packed = held[0], held[0]["payload_bytes"], held[0]["packed"]
            if size is not None and len(held) > 1:
                raise ValueError(f"segments of {head['origin']} are missing or doubled")
            if size is None:
                size, payload = _whole([(r["origin"], r["segment"], r["kind"], r["digest"], r["total"], zstandard.decompress(r["packed"])) for r in held])
                packed = kept(payload)
            payload = zstandard.decompress(packed) if packed is not None else None
            yield head["page_id"], head["kind"], head["refers_to"], head["digest"], size, payload
            held.clear()

        def out(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (arrow, pa.string(), arrow, pa.string(), pa.int64(), pa.binary()))], ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                done = []
                for row in batch.slice(at, 256).to_pylist():
                    if held and row["origin"] != held[0]["origin"]:
                        done.extend(close())
                    held.append(row)
                yield out(done)
        yield out(list(close()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parsed = files.mapInArrow(split, PARSED.format(kind=id_kind))
    dealt = parsed.repartition("origin").sortWithinPartitions("origin", "segment")
    return dealt.mapInArrow(join, f"page_id {id_kind}, record_type string, refers_to {id_kind}, payload_digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame, payloads: bool = True, **columns: str) -> DataFrame:
    """Write `pages` to a new archive in the shared folder and read it back; `payloads`: see `read_archive`."""
    path = f"{scratch_dir(pages.sparkSession)}/archive"
    write_archive(pages, path, **columns)
    return read_archive(pages.sparkSession, path, pages.schema[columns.get("id_column", "page_id")].dataType.simpleString(), payloads)

"""WARC archives of web pages: writing with deduplicated payloads, reading with segment reassembly (operator 8).

Records are text (headers and UTF-8 payloads), so Spark's own text sink writes them: a record a row, the blank lines
that end a record as line separator, gzip over the file. Blocks over segment_bytes are cut into a response record and
continuation records. Reading groups the segments by origin, orders them by number, verifies the total length and
decodes the chunked transfer framing. Cuts fall between code points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._workspace import materialise

SEGMENT_BYTES = 32768
CHUNK_BYTES = 4096
#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 100
_END = b"\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of at most size bytes that end between code points (size is 4 or more)."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(part), part) for part in cuts(payload, size)) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n < 0:
            raise ValueError("negative chunk size")
        if n == 0:
            break
        part = body[end + 2 : end + 2 + n]
        if len(part) < n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(part)
        at = end + 4 + n
    return b"".join(out)


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def records(page_id: str, name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The WARC records of a page, without the blank lines that end a record."""
    uri = f"WARC-Target-URI: {_uri(url)}\r\n" if url is not None else ""

    def record(kind: str, own: str, more: str, block: bytes) -> bytes:
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{own}>\r\nWARC-Date: {_DATE}\r\n{uri}{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block

    said = f"WARC-Payload-Digest: sha256:{digest}\r\n"
    if refers_to is not None:
        profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
        yield record("revisit", name, f"{said}{profile}WARC-Refers-To: <urn:page:{refers_to}>\r\n", _HEAD + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = _HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield record("response", name, said, block)
        return
    parts = list(cuts(block, segment_bytes))
    for i, part in enumerate(parts, 1):
        if i == 1:
            yield record("response", name, said + "WARC-Segment-Number: 1\r\n", part)
        else:
            total = f"WARC-Segment-Total-Length: {len(block)}\r\n" if i == len(parts) else ""
            yield record("continuation", f"{name}.{i}", f"WARC-Segment-Origin-ID: <{name}>\r\nWARC-Segment-Number: {i}\r\n{total}", part)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES, max_records: int = 20_000) -> None:
    """Writes a record (or its segments) for each row to gzip files below path.

    Of the rows with one payload of LEAST_BYTES or more, those of the smallest id are responses and the others
    revisits of it. Null html is an empty payload, null url leaves its header out, a null id is never the smallest.
    Which payloads repeat is counted on digests alone; their table is joined back by size (broadcast only if Spark
    finds it small), and AQE splits a digest that holds many rows.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    long = base.where(F.octet_length("html") >= LEAST_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeated = materialise(long.where("n > 1").select("digest", "first"), "repeated")
    told = base.join(repeated, "digest", "left").withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, held = [], 0
            for own, url, html, digest, ref in zip(*(batch.column(c) for c in ("id", "url", "html", "digest", "refers_to")), strict=True):
                own, n = own.as_py(), n + 1
                own = "" if own is None else own
                for r in records(own, f"urn:page:{own}#{worker}-{n}", url.as_py(), html.as_py().encode(), digest.as_py(), ref.as_py(), segment_bytes):
                    rows.append(r.decode())
                    held += len(r)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
                    rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

    out = told.select(F.col("id").cast("string").alias("id"), "url", "html", "digest", "refers_to").mapInArrow(run, "value string")
    out.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)


def _inflate(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        step = zlib.decompressobj(31)
        out.append(step.decompress(content) + step.flush())
        content = step.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record, by Content-Length alone; ValueError where that breaks."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(_END, at)
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode().split("\r\n")[1:])}
        n = int(headers["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n:
            raise ValueError("the last record is cut short")
        yield headers, block
        at = end + 4 + n


def parse_lines(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record, from an archive's bytes cut at each blank line (CR LF CR LF).

    No more than a record is held. The header ends at a cut; Content-Length alone says how many cuts fall in the block.
    """
    rest: bytes | None = None
    while True:
        line = next(lines, None) if rest is None else rest
        rest = None
        if line is None:
            return
        while line[:2] == b"\r\n":
            line = line[2:]
        if not line:
            continue
        if line[:5] != b"WARC/":
            raise ValueError("no record where one should start")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in line.decode().split("\r\n")[1:])}
        n, parts, held = int(headers["content-length"]), [], -len(_END)
        while held < n:
            part = next(lines, None)
            if part is None:
                if n == 0:
                    break
                raise ValueError("the last record is cut short")
            parts.append(part)
            held += len(_END) + len(part)
        block = _END.join(parts)
        yield headers, block[:n]
        rest = block[n:] or None


_SEGMENT = pa.schema([(x, pa.string()) for x in ("origin", "type", "refers_to", "digest", "uri")] + [("number", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])
_SEGMENT_DDL = "origin string, type string, refers_to string, digest string, uri string, number long, total long, block binary"


def _segment_batches(found: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SEGMENT, strict=True)], schema=_SEGMENT)

    rows, held = [], 0
    for h, block in found:
        number = h.get("warc-segment-number")
        total = h.get("warc-segment-total-length")
        own = h.get("warc-segment-origin-id", h.get("warc-record-id", ""))
        rows.append((own.strip("<>"), h.get("warc-type"), (h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None), h.get("warc-payload-digest"), h.get("warc-target-uri"), int(number) if number else None, int(total) if total else None, block))
        held += len(block)
        if held > 1 << 22:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the files below path; number is null for records that aren't segments.

    Files named .gz, those of write_warc among them, are read as a stream by Spark's text source, which cuts them at
    blank lines and does not split them: a task holds a record, not a file. Other files are read whole (2 GB at most).
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for name, value in zip(batch.column("name"), batch.column("value"), strict=True):
                yield name.as_py(), value.as_py()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(lines(batches), key=lambda x: x[0]):
            yield from _segment_batches(parse_lines(value for _, value in rows))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _segment_batches(parse(_inflate(content.as_py())))

    text = spark.read.option("lineSep", _END.decode()).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(path)
    streamed = text.select(F.col("_metadata.file_path").alias("name"), F.col("value").cast("binary").alias("value")).mapInArrow(stream, _SEGMENT_DDL)
    others = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{*[!z],*[!g]z,*[!.]gz}").load(path)
    return streamed.unionAll(others.select("content").mapInArrow(whole, _SEGMENT_DDL))


def reassemble(segments: DataFrame) -> DataFrame:
    """(origin, type, refers_to, digest, uri, block, problem): whole records.

    Records that aren't segments pass through without a shuffle. Segments are grouped by origin, a group being one
    record, and joined by number. problem says what is wrong (null if nothing): a missing or repeated number, no total
    length, or another length than that; block is null then.
    """
    single = segments.where("number is null").select("origin", "type", "refers_to", "digest", "uri", "block", F.lit(None).cast("string").alias("problem"))
    heads = [F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("type", "refers_to", "digest", "uri")]
    groups = segments.where("number is not null").groupBy("origin").agg(*heads, F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"))
    groups = groups.withColumn("block", F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["block"])), "")))
    in_order = F.transform("parts", lambda x: x["number"]) == F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: i.cast("long"))
    problem = F.when(~in_order, "segments are missing or repeated").when(F.col("total").isNull(), "the last segment is missing").when(F.octet_length("block") != F.col("total"), "the total length differs")
    groups = groups.withColumn("problem", problem).withColumn("block", F.when(F.col("problem").isNull(), F.col("block")))
    return single.unionByName(groups.select(*single.columns))


def decode(whole: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id STRING, uri, record_type, refers_to STRING, payload_bytes, payload_digest, problem[, payload]).

    A response's payload is decoded and its digest recomputed; one that differs from the record's is a problem. A
    revisit has no payload; its length and digest are those that the record states.
    """

    def page(name: str | None) -> str | None:
        return (name or "").removeprefix("urn:page:").partition("#")[0] or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                size = digest = payload = None
                problem, stated = x["problem"], (x["digest"] or "").removeprefix("sha256:")
                if problem is None:
                    try:
                        head, sep, body = x["block"].partition(_END)
                        if not sep:
                            raise ValueError("no HTTP header")
                        fields = {k.strip().lower(): v.strip() for k, _, v in (y.partition(b":") for y in head.split(b"\r\n")[1:])}
                        if x["type"] == "revisit":
                            size, digest = int(fields[b"content-length"]), stated
                        else:
                            payload = dechunk(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                            if stated and digest != stated:
                                problem = "the payload's digest differs"
                    except (ValueError, KeyError) as e:
                        problem = str(e)
                out.append((page(x["origin"]), x["uri"], x["type"], page(x["refers_to"]), size, digest, problem, payload if with_payload else None))
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "problem", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    ddl = "page_id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, problem string, payload binary"
    found = whole.mapInArrow(run, ddl)
    return found if with_payload else found.drop("payload")


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives below path; see reassemble() and decode()."""
    return decode(reassemble(read_segments(spark, path)), with_payload)

"""WARC archives: one gzip member per record, written and read back sequentially."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BATCH_BYTES, fresh_path, ship, written

#: Payloads shorter than this are never revisits.
MIN_PAYLOAD = 100
#: The table has no time of capture; a WARC record must name one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16


class WarcError(ValueError):
    """An archive that is cut short, badly framed or fails a digest."""


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None = None


def _line(value: str) -> str:
    """A header's value on one line: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{digest}'.encode()).digest()[:16], version=4)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, level: int = 6) -> bytes:
    """A response record, or a revisit of page refers_to, as one gzip member.

    A revisit holds the HTTP headers, whose Content-Length is that of the payload, and no payload.
    """
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": DATE, "WARC-Target-URI": _line(url or f"urn:page:{page_id}"), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
    if page_id is not None:
        head["Page-ID"] = str(page_id)
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "Refers-To-Page-ID": str(refers_to)}
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(text.encode("utf-8", "surrogatepass")) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


class _Member:
    """The bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, source, rest: bytes):
        self.source, self.zip, self.raw, self.ready = source, zlib.decompressobj(31), rest, b""

    def some(self, most: int = PIECE) -> bytes:
        """Up to `most` bytes; b"" at the member's end."""
        while not self.ready:
            if self.zip.eof:
                return b""
            if not self.raw:
                self.raw = self.source.read(PIECE)
                if not self.raw:
                    raise WarcError("the archive ends within a record")
            try:
                self.ready = self.zip.decompress(self.raw, PIECE)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            self.raw = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
        out, self.ready = self.ready[:most], self.ready[most:]
        return out

    def until(self, mark: bytes) -> bytes:
        """The bytes up to and with mark, however many: a url has no bound."""
        got, at = bytearray(), -1
        while at < 0:
            piece = self.some()
            if not piece:
                raise WarcError("a header doesn't end")
            old = len(got)
            got += piece
            at = got.find(mark, max(0, old - len(mark) + 1))
        end = at + len(mark)
        self.ready = bytes(got[end:]) + self.ready
        return bytes(got[:end])


def _fields(lines: list[str]) -> dict[str, str]:
    pairs = [x.partition(":") for x in lines if x]
    if not all(sep for _, sep, _ in pairs):
        raise WarcError("a header line has no colon")
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _number(fields: dict[str, str]) -> int:
    n = fields.get("content-length", "")
    if not n.isdigit():
        raise WarcError(f"Content-Length {n!r}")
    return int(n)


def read_records(source, keep: bool = False) -> Iterator[Record]:
    """The records of an archive, from a binary stream, one after the other; of a record its headers are held, and a piece.

    Lengths and digests are verified as the bytes pass; a payload is kept only if asked for.
    """
    rest = source.read(PIECE)
    while rest:
        member = _Member(source, rest)
        top, *lines = member.until(b"\r\n\r\n").decode("utf-8", "surrogatepass").split("\r\n")
        if not top.startswith("WARC/1."):
            raise WarcError(f"not a WARC record: {top[:40]!r}")
        headers = _fields(lines)
        left, block, payload, parts, n = _number(headers), hashlib.sha256(), hashlib.sha256(), [], 0
        http = member.until(b"\r\n\r\n")
        left -= len(http)
        block.update(http)
        fields = _fields(http.decode("utf-8").split("\r\n")[1:])
        while left > 0:
            piece = member.some(min(left, PIECE))
            if not piece:
                raise WarcError("a block is shorter than its Content-Length")
            left -= len(piece)
            n += len(piece)
            block.update(piece)
            payload.update(piece)
            if keep:
                parts.append(piece)
        tail = b""
        while piece := member.some():
            tail += piece
        if left or tail != b"\r\n\r\n":
            raise WarcError("a record isn't framed by its Content-Length")
        want = headers.get("warc-payload-digest", "").removeprefix("sha256:")
        if headers.get("warc-block-digest") != f"sha256:{block.hexdigest()}":
            raise WarcError(f"block digest of {headers.get('warc-record-id')}")
        if headers.get("warc-type") == "response" and (want != payload.hexdigest() or n != _number(fields)):
            raise WarcError(f"payload digest of {headers.get('warc-record-id')}")
        yield Record(headers, fields, _number(fields), want, b"".join(parts) if keep else None)
        rest = member.raw or source.read(PIECE)


def _place(uri: str):
    """The file system and path of a URI of the shared folder, whatever its scheme."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_archives(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write a record per page to archives in the shared folder -> their manifest (path, records, bytes).

    Of pages with equal payloads of at least min_payload bytes, that with the smallest page_id is a response
    and the others revisit it. Only digests are grouped. A task writes one archive under a name of its
    own attempt, and the manifest, a table, lists those of the attempts that counted: a task that is run again
    leaves at most a file that no one reads.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = fresh_path(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    lead = pages.where(F.octet_length("payload") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("lead"), F.count("*").alias("n")).where("n > 1 and lead is not null")
    lead = written(lead.select("digest", "lead"), "warc-leads")
    rows = pages.join(lead, "digest", "left").select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("lead") < F.col("page_id")), F.when(F.col("page_id").isNotNull(), F.col("lead"))).alias("refers_to"))

    def write(batches):
        where, root = _place(folder)
        path, out, n, size = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    where.create_dir(root, recursive=True)
                    out = where.open_output_stream(path)
                data = record(*(batch.column(k)[i].as_py() for k in range(4)))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([n]), pa.array([size])], ["path", "records", "bytes"])

    found = written(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")
    return found.withColumn("path", F.concat(F.lit(folder + "/"), "path"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of all records, a task for each archive."""

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                where, path = _place(uri)
                rows, size = [], 0
                with where.open_input_stream(path) as source:
                    for r in read_records(source):
                        number = lambda k, h=r.headers: int(h[k]) if k in h else None
                        rows.append((number("page-id"), r.payload_bytes, r.payload_digest, r.headers["warc-type"], number("refers-to-page-id"), r.headers.get("warc-target-uri")))
                        size += len(rows[-1][-1] or "")
                        if len(rows) == 4096 or size > BATCH_BYTES:
                            yield pack(rows)
                            rows, size = [], 0
                yield pack(rows)

    ship(manifest.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
    archives = max(1, manifest.count())
    return manifest.select("path").repartition(archives).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_pages(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write all pages as WARC records and read the archives back: one row a page, from its record.

    Null html is an empty payload. A null url is replaced by a URN. Rows with a null page_id are responses
    that none refers to; rows that repeat the smallest page_id of a payload are all responses. An empty
    table gives no archive and no rows; other columns are ignored.
    """
    return read_archives(write_archives(pages, min_payload)).drop("url")

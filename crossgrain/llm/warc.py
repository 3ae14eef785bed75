"""WARC archives as a chunked record table.

An archive is a Parquet table of chunks: (archive, record_no, chunk_no, last, data, running_digest).
`data` of an archive's chunks, in order, is a WARC 1.1 file byte for byte. A payload over `chunk_bytes`
stands in several rows, cut without copying the rest, and each row carries the SHA-1 of the payload up
to its end, so that neither side ever puts a whole record together: the writer yields slices, the
reader feeds chunk after chunk to one digest. Records of one chunk, nearly all, are parsed where they
are read; only chunks of larger records are dealt by record and sorted by number.

Of records with equal payloads of at least `min_revisit_bytes`, that with the largest page_id is the
response and the others are revisits: WARC and HTTP header only, which name the response. Groups are
found on (digest, length) by an aggregation with partial sums in every task, so a payload that a third
of all pages share is one row a task; joining the groups back splits its partition like any skewed one.

Defined results: a null html is an empty payload; a null url gives a record without a target; a null
page_id gives a response without a page header, and is read back as null; repeated rows of the page_id
that is the response are responses, too; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.sources.scratch import materialize, scratch_path
from crossgrain.sources.tables import table

CHUNK_BYTES = 1 << 18
MIN_REVISIT_BYTES = 1000
#: Bytes of chunks that the writer has at a time before it hands them on.
FLUSH_BYTES = 1 << 22
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "archive int, record_no long, chunk_no int, last boolean, data binary, running_digest string"
_NAMES = ["archive", "record_no", "chunk_no", "last", "data", "running_digest"]
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_roles(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload and refers_to (null: a response) of each row of `pages` (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    large = F.col("size") >= min_revisit_bytes
    groups = rows.where(large).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select(F.col("digest").alias("group_digest"), F.col("size").alias("group_size"), "keeper"), "warc-groups")
    joined = rows.join(groups, (F.col("digest") == F.col("group_digest")) & (F.col("size") == F.col("group_size")), "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("keeper"), F.col("keeper")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_head(page_id: int | None, url: str | None, payload_digest: bytes, size: int, refers_to: int | None) -> bytes:
    """WARC and HTTP headers of a record; a revisit has no more than these."""
    digest = payload_digest.hex()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(payload_digest).decode()}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def record_chunks(page_id: int | None, url: str | None, payload: memoryview, refers_to: int | None, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, bool, bytes, str]]:
    """(chunk_no, last, data, running digest) of a record; the payload is passed over twice and never copied whole."""
    whole, at = hashlib.sha1(), 0
    for k in range(0, len(payload), chunk_bytes):
        whole.update(payload[k : k + chunk_bytes])
    head = record_head(page_id, url, whole.digest(), len(payload), refers_to)
    body = payload if refers_to is None else payload[:0]
    running, chunk_no = hashlib.sha1(), 0
    while True:
        piece = body[at : at + chunk_bytes]
        at += len(piece)
        running.update(piece)
        last = at >= len(body)
        yield chunk_no, last, b"".join((head if chunk_no == 0 else b"", piece, b"\r\n\r\n" if last else b"")), running.hexdigest()
        if last:
            return
        chunk_no += 1


def write_chunks(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of `records` (page_id, url, payload, refers_to): each partition is an archive."""

    def written(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        archive, record_no, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def batch():
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)

        for b in batches:
            ids, urls, refers, payloads = b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("refers_to").to_pylist(), b.column("payload")
            for page_id, url, refers_to, payload in zip(ids, urls, refers, payloads, strict=True):
                for chunk_no, last, data, running in record_chunks(page_id, url, memoryview(payload.as_buffer()), refers_to, chunk_bytes):
                    rows.append((archive, record_no, chunk_no, last, data, running))
                    held += len(data)
                    if held >= FLUSH_BYTES:
                        yield batch()
                        rows, held = [], 0
                record_no += 1
        if rows:
            yield batch()
    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(written, CHUNKS)


@dataclass
class RecordParser:
    """Takes a record's chunks in order; keeps headers, a count and a digest, never the payload."""

    warc: dict[str, str] | None = None
    http: dict[str, str] | None = None
    pending: bytes = b""
    left: int = 0
    size: int = 0
    digest: object = field(default_factory=hashlib.sha1)

    def feed(self, data: memoryview) -> None:
        if self.http is None:
            self.pending += bytes(data)
            if self.warc is None and (end := self.pending.find(b"\r\n\r\n")) >= 0:
                self.warc, self.pending = _fields(self.pending[:end]), self.pending[end + 4 :]
                self.left = int(self.warc["content-length"])
            if self.warc is None or (end := self.pending.find(b"\r\n\r\n")) < 0:
                return
            self.http, data = _fields(self.pending[:end]), memoryview(self.pending)[end + 4 :]
            self.left -= end + 4
            self.pending = b""
        piece = data[: self.left]
        self.left -= len(piece)
        self.size += len(piece)
        self.digest.update(piece)

    def row(self) -> tuple[int | None, int, str, str, int | None]:
        """page_id, payload bytes, payload digest, type and refers_to; a response is held against its header."""
        said = base64.b32decode(self.warc["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind, size = self.warc["warc-type"], int(self.http["content-length"])
        if self.left or kind == "response" and (self.digest.hexdigest(), self.size) != (said, size):
            raise ValueError(f"record {self.warc['warc-record-id']} is damaged")
        page, refers = self.warc.get("x-page-id"), self.warc.get("x-refers-to-page-id")
        return None if page is None else int(page), size, said, kind, None if refers is None else int(refers)


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}


def read_chunks(chunks: DataFrame) -> DataFrame:
    """A row for each record of a chunk table."""

    def parsed(batches):
        import pyarrow as pa

        parser, kinds = None, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for b in batches:
            rows = []
            for first, last, data in zip(b.column("chunk_no").to_pylist(), b.column("last").to_pylist(), b.column("data"), strict=True):
                if first == 0:
                    parser = RecordParser()
                parser.feed(memoryview(data.as_buffer()))
                if last:
                    rows.append(parser.row())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    single = (F.col("chunk_no") == 0) & F.col("last")
    some = chunks.where(single).select("chunk_no", "last", "data").mapInArrow(parsed, READ)
    large = chunks.where(~single).repartition("archive", "record_no").sortWithinPartitions("archive", "record_no", "chunk_no")
    return some.unionByName(large.select("chunk_no", "last", "data").mapInArrow(parsed, READ))


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes a WARC record for each row of `pages` to the chunk table at `path`."""
    write_chunks(with_roles(pages, min_revisit_bytes), chunk_bytes).write.parquet(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return read_chunks(spark.read.schema(CHUNKS).parquet(path))


def export_files(chunks: DataFrame, uri: str) -> DataFrame:
    """Writes each archive as `archive-N.warc.gz`, a gzip member a record, below `uri`, a store that pyarrow reaches; returns name and records."""

    def exported(batches):
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        out, packer, archive, n, done = None, None, None, 0, []
        store, base = fs.FileSystem.from_uri(uri)
        for b in batches:
            for a, first, last, data in zip(b.column("archive").to_pylist(), b.column("chunk_no").to_pylist(), b.column("last").to_pylist(), b.column("data"), strict=True):
                if a != archive:
                    if out:
                        out.close()
                        done.append((f"archive-{archive}.warc.gz", n))
                    out, archive, n = store.open_output_stream(f"{base}/archive-{a}.warc.gz", compression=None), a, 0
                if first == 0:
                    packer = zlib.compressobj(wbits=31)
                out.write(packer.compress(memoryview(data.as_buffer())))
                if last:
                    out.write(packer.flush())
                    n += 1
        if out:
            out.close()
            done.append((f"archive-{archive}.warc.gz", n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "records"])

    dealt = chunks.repartition("archive").sortWithinPartitions("archive", "record_no", "chunk_no")
    return dealt.mapInArrow(exported, "file string, records long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to an archive and reads the archives back."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


QUERIES = {"op4_warc": op4_warc}
ORACLE_SQL = {
    "op4_warc": f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM p
), r AS (
  SELECT *, payload_bytes >= {MIN_REVISIT_BYTES} AND page_id < keeper AS again FROM k
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keeper END AS refers_to FROM r
"""
}

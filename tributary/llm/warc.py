"""WARC archives: writing captures as transactions of records, and reading them back as one nested row a capture.

Method. A capture is a request, a response (or a revisit of an earlier equal one) and a metadata record; request and
metadata name the response through WARC-Concurrent-To. Reading parses the archives' records and assembles
transactions by joining records on the capture that they name, wherever they lie, into one nested row.

Writers write archives of a bounded size into a folder that all executors share, each under a hidden name and then by a
rename. Rows get a fixed key as they are read, from which their record ids come, and a task sorts its rows by it; so a
task that runs again or twice at once makes the same archives under the same names, whatever order its rows came in.
Equal payloads are found by digest: the
smallest id of each digest comes from a partial aggregate; the join back is salted, as one payload may be a third of
all pages, and only its digests that occur twice or more take part.

Cases. A null payload counts as empty. A null url is written as an empty target. Pages that repeat an id and payload are
captures of their own with equal rows; a null id never is the response that others revisit. An empty table gives no
archives and no rows. Columns other than id, url and payload are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.session import shared_dir

ARCHIVE_BYTES = 32 << 20
SALTS = 32
LEVEL = 1
DATE = "2020-01-01T00:00:00Z"

#: Bytes given to the decompressor at a time: a member's rest is copied when the member ends.
FED = 1 << 14

RECORDS = ("capture string, record_type string, record_id string, target string, refers_to string, digest string, page_id long, "
           "head string, payload_bytes long, payload binary")


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers if v), f"Content-Length: {len(block)}"]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(whole) + z.flush()


def _urn(seed: str) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(seed.encode()).digest())}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def capture(seed: str, page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """The three records; first: the id of the page whose equal payload this one revisits, if it does."""
    response, target, digest = _urn(seed), _field(url), f"sha1:{digest_of(payload)}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = first is not None
    kept = [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        kept += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{first}>")]
    return b"".join([
        _record("revisit" if revisit else "response", response, kept, head if revisit else head + payload),
        _record("request", _urn(f"{seed}/request"), [("WARC-Target-URI", target), ("WARC-Concurrent-To", f"<{response}>"), ("Content-Type", "application/http; msgtype=request")], f"GET {target} HTTP/1.1\r\n\r\n".encode()),
        _record("metadata", _urn(f"{seed}/metadata"), [("WARC-Target-URI", target), ("WARC-Concurrent-To", f"<{response}>"), ("Content-Type", "application/warc-fields")], f"page-id: {'' if page_id is None else page_id}\r\n".encode()),
    ])


def write(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", row_key: Column | None = None) -> DataFrame:
    """Writes the archives, and returns their names and sizes (lazily: an action on it writes them).

    row_key: a long of its own for each row; without one, the row's place in the tables as they are read.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    key = F.monotonically_increasing_id() if row_key is None else row_key
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), key.alias("key"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    twice = (rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
             .where("n > 1").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(twice, ["digest", "salt"], "left")
    rows = rows.select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("first"), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{number:06d}.warc.gz"
            hidden = f"{top}/.{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(hidden) as out:
                for records in held:
                    out.write(records)
            try:
                store.move(hidden, f"{top}/{name}")
            except OSError:  # some stores don't rename to a name that is there: another attempt's, with the same content
                if store.get_file_info(f"{top}/{name}").type != fs.FileType.File:
                    raise
                store.delete_file(hidden)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], names=["archive", "bytes"])

        for batch in batches:
            for page_id, url, payload, first, key in zip(*(batch.column(i) for i in range(5))):
                records = capture(str(key.as_py()), page_id.as_py(), url.as_py(), payload.as_py(), first.as_py())
                held.append(records)
                size += len(records)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    return rows.mapInArrow(run, "archive string, bytes long")


def members(data: bytes) -> Iterator[bytes]:
    """The unpacked gzip members of an archive, one after another."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            fed = view[at : at + FED]
            if not len(fed):
                raise ValueError("the archive ends inside a record")
            parts.append(z.decompress(fed))
            at += len(fed) - len(z.unused_data)
        yield b"".join(parts)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive of gzip members."""
    for member in members(data):
        at = 0
        while at < len(member):
            end = member.index(b"\r\n\r\n", at)
            lines = member[at:end].decode().split("\r\n")[1:]
            fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
            start = end + 4
            at = start + int(fields["content-length"])
            yield fields, member[start:at]
            at += 4


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _row(h: dict[str, str], block: bytes) -> tuple:
    """A record as a row of RECORDS; a response's payload must have the digest that its header names."""
    own, kind, digest = _bare(h.get("warc-record-id")), h["warc-type"], h.get("warc-payload-digest")
    page = head = size = payload = None
    if kind == "metadata":
        value = block.partition(b"page-id: ")[2].split(b"\r\n")[0]
        page = int(value) if value else None
    elif kind == "request":
        payload = block
    else:
        raw, _, body = block.partition(b"\r\n\r\n")
        head = raw.decode()
        if kind == "response":
            payload, size = body, len(body)
            if digest != f"sha1:{digest_of(body)}":
                raise ValueError(f"the payload of {own} has another digest than its record")
        else:
            size = int(head.rpartition("Content-Length: ")[2])
    return _bare(h.get("warc-concurrent-to")) or own, kind, own, h.get("warc-target-uri"), _bare(h.get("warc-refers-to")), digest and digest.removeprefix("sha1:"), page, head, size, payload


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record: RECORDS. capture is the record that it belongs to: its own, or the one it is concurrent to."""
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.split()[1]] for f in RECORDS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (c for b in batches for c in b.column(0)):
            rows, size = [], 0
            for h, block in records(content.as_py()):
                rows.append(_row(h, block))
                size += len(block)
                if size >= 8 << 20:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    archives = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return archives.mapInArrow(run, RECORDS)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row a capture, from all records that name it: capture, target, request, response, metadata, payload.

    Each field is an aggregate of its own; the payload stands beside the response, so that a query without it does not
    shuffle it.
    """
    def of(name: str, *kinds: str) -> Column:
        return F.first(F.when(F.col("record_type").isin(*kinds), F.col(name)), ignorenulls=True)

    answers = ("response", "revisit")
    fields = {"record_type": answers, "refers_to": answers, "digest": answers, "head": answers, "payload_bytes": answers}
    grouped = rows.groupBy("capture").agg(
        of("target", *answers).alias("target"), of("payload", "request").alias("request"), of("page_id", "metadata").alias("page_id"), of("payload", "response").alias("payload"),
        *(of(name, *kinds).alias(f"response_{name}") for name, kinds in fields.items()))
    return grouped.select("capture", "target", "request", F.struct(*(F.col(f"response_{n}").alias(n) for n in fields)).alias("response"), F.struct("page_id").alias("metadata"), "payload")


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes archives of the pages into a folder (a new one of the shared folder) and returns their captures."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    write(pages, folder, least_bytes).agg(F.count("*"), F.sum("bytes")).first()
    return assemble(read_records(spark, folder))


def by_page(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's length is that in its HTTP header."""
    return captures.select("metadata.page_id", "response.payload_bytes", F.col("response.digest").alias("payload_digest"), "response.record_type",
                           F.regexp_extract("response.refers_to", r"(-?\d+)$", 1).try_cast("long").alias("refers_to"))

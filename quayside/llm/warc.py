"""WARC archives: written by tasks with one gzip member per record, read back sequentially and verified."""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quayside.llm.common import bounded_batches
from quayside.session import pin, shared_path

VERSION = "WARC/1.1"
LEAST_REVISIT = 100
_READ = 1 << 16
MOST_TASKS = 20_000
_RECORDS = ("path string, record long, type string, uri string, date string, item_id long, payload_bytes long, payload_digest string, "
            "refers_to long, digest_ok boolean, error string")


def with_revisits(pages: DataFrame, id_column: str = "page_id", body: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (id, url, body) with payload (bytes), digest and refers_to.

    Of the rows with equal payloads of at least ``least`` bytes those with the smallest id are
    originals, refers_to null; the others refer to that id. Null bodies are empty payloads. Rows
    with a null id never are what others refer to. Digests are counted first; only those that
    occur more than once are joined back, so the join carries a small side or splits.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("item_id"), "url", F.coalesce(F.col(body), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    same = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("item_id").alias("first"))
    same = pin(same.where("n > 1").select("digest", "first"))
    later = F.col("first").isNotNull() & ~F.col("item_id").eqNullSafe(F.col("first"))
    return rows.join(same, "digest", "left").withColumn("refers_to", F.when(later, F.col("first"))).drop("first")


def _header(fields: list[tuple[str, str | None]], first: str) -> bytes:
    lines = [first] + [f"{k}: {v}" for k, v in fields if v is not None]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _uri(url: str | None) -> str | None:
    """A URL that fits one header line: control characters and spaces percent-encoded."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def record_bytes(item_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record as a gzip member. A revisit has the response's HTTP headers and no payload."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{item_id} {url} {digest}')}>"),
        ("WARC-Date", date), ("WARC-Target-URI", _uri(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Item-ID", None if item_id is None else str(item_id)),
        ("WARC-Refers-To-Item-ID", None if refers_to is None else str(refers_to)),
        ("Content-Length", str(len(block))),
    ]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(_header(fields, VERSION)) + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 1 << 30) -> DataFrame:
    """Write ``rows`` (item_id, url, payload, digest, refers_to) below ``folder``; returns the manifest (path, records, bytes).

    Every task streams its rows to files of its own, a new one past ``file_bytes``. Names carry
    the attempt, and the manifest, itself a table in the shared folder, lists only the files of
    the attempts that succeeded: files of a lost executor are never read.
    ``folder`` is any file system that pyarrow opens (file:, hdfs:, s3:, gs:).
    """
    bounded_batches(rows.sparkSession)

    manifest = "path string, records long, bytes long"
    arrow = to_arrow_schema(StructType.fromDDL(manifest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, number, records, size, done = None, "", 0, 0, 0, []
        for batch in batches:
            for item_id, url, payload, digest, refers_to in zip(*(column.to_pylist() for column in batch.columns)):
                if out is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
                    out, number, records, size = store.open_output_stream(f"{root}/{name}", compression=None), number + 1, 0, 0
                member = record_bytes(item_id, url, payload, digest, refers_to, date)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, d)) for d in done], arrow)

    return pin(rows.select("item_id", "url", "payload", "digest", "refers_to").mapInArrow(run, manifest))


class Members:
    """The gzip members of a stream, one after the other, decompressed as they are read."""

    def __init__(self, stream):
        self.stream, self.rest, self.inflate = stream, b"", None

    def next(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        self.rest = self.rest or self.stream.read(_READ)
        self.inflate = zlib.decompressobj(31) if self.rest else None
        return self.inflate is not None

    def read(self, most: int) -> bytes:
        """Up to ``most`` bytes of the current member; empty at its end."""
        while not self.inflate.eof:
            if not self.rest and not self.inflate.unconsumed_tail:
                self.rest = self.stream.read(_READ)
                if not self.rest:
                    raise EOFError("the file ends within a record")
            out = self.inflate.decompress(self.inflate.unconsumed_tail + self.rest, most)
            self.rest = self.inflate.unused_data if self.inflate.eof else b""
            if out:
                return out
        return b""


class Body:
    """Length-framed reading of one member."""

    def __init__(self, members: Members):
        self.members, self.held = members, b""

    def line(self, most: int = 1 << 20) -> bytes:
        while b"\n" not in self.held:
            more = self.members.read(_READ)
            if not more or len(self.held) > most:
                raise ValueError("a header line does not end")
            self.held += more
        line, _, self.held = self.held.partition(b"\n")
        return line.rstrip(b"\r")

    def take(self, count: int) -> Iterator[bytes]:
        while count:
            piece = self.held[:count] or self.members.read(min(count, _READ))
            if not piece:
                raise ValueError("a record is shorter than its length")
            self.held = self.held[len(piece):] if self.held else b""
            count -= len(piece)
            yield piece

    def headers(self) -> tuple[str, dict[str, str]]:
        first, fields = self.line().decode(), {}
        while line := self.line():
            key, _, value = line.decode(errors="replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        return first, fields


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_records(stream, payloads: bool = False) -> Iterator[dict]:
    """The records of an open archive in order, each framed by its content length and verified.

    The block's digest is computed as the block streams by; the payload is held only when asked for. A
    response's payload must also match its payload digest, a revisit has none to match. Damage
    gives one last record with ``error``: what follows a broken member cannot be framed.
    """
    members = Members(stream)
    number = 0
    try:
        while members.next():
            body = Body(members)
            version, head = body.headers()
            if not version.startswith("WARC/"):
                raise ValueError("not a WARC record")
            whole, own, kept, length, before = hashlib.sha256(), hashlib.sha256(), [], 0, b""
            in_payload = not head.get("content-type", "").startswith("application/http")
            stated = None
            for piece in body.take(int(head["content-length"])):
                whole.update(piece)
                if not in_payload:
                    before += piece
                    cut = before.find(b"\r\n\r\n")
                    if cut < 0:
                        continue
                    found = re.search(rb"\r\ncontent-length: *(\d+)", before[:cut + 2], re.I)
                    stated, piece, in_payload, before = int(found[1]) if found else None, before[cut + 4:], True, b""
                own.update(piece)
                length += len(piece)
                if payloads:
                    kept.append(piece)
            if b"".join(body.take(4)) != b"\r\n\r\n" or members.read(1):
                raise ValueError("a record does not end where its length says")
            revisit = head.get("warc-type") == "revisit"
            digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or own.hexdigest()
            right = head.get("warc-block-digest", "").removeprefix("sha256:") in ("", whole.hexdigest())
            yield {
                "record": number, "type": head.get("warc-type"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
                "item_id": _number(head.get("warc-item-id")), "payload_bytes": stated if revisit and stated is not None else length, "payload_digest": digest,
                "refers_to": _number(head.get("warc-refers-to-item-id")), "digest_ok": right and (revisit or digest == own.hexdigest()), "error": None,
            } | ({"payload": b"".join(kept)} if payloads else {})
            number += 1
    except (ValueError, KeyError, EOFError, zlib.error, UnicodeDecodeError) as e:
        yield {"record": number, "digest_ok": False, "error": f"{type(e).__name__}: {e}"}


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives listed in ``files`` (path): what _RECORDS names, and payload if asked for.

    Files are dealt by path to as many tasks as there are files (MOST_TASKS at most, each with several then) and read as
    streams in pieces of 64 KB, so memory does not grow with archives or records. A damaged or missing file gives a row with ``error``.
    """
    schema = _RECORDS + (", payload binary" if payloads else "")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                try:
                    store, name = fs.FileSystem.from_uri(path)
                    with store.open_input_stream(name, compression=None) as stream:
                        for r in read_records(stream, payloads):
                            rows.append({"path": path} | r)
                            held += len(r.get("payload") or b"")
                            if len(rows) >= 2000 or held > 16 << 20:
                                yield pa.RecordBatch.from_pylist(rows, arrow)
                                rows, held = [], 0
                except OSError as e:
                    rows.append({"path": path, "record": -1, "digest_ok": False, "error": f"{type(e).__name__}: {e}"})
                yield pa.RecordBatch.from_pylist(rows, arrow)

    listed = files.select("path").where("path is not null")
    # A stated number of tasks is kept; one that Spark chose would follow the size of the list, not of the archives.
    tasks = max(1, min(listed.count(), MOST_TASKS))
    return listed.repartition(tasks, "path").mapInArrow(run, schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives below the shared one."""
    return shared_path(spark, "warc")


def parse(data: bytes, payloads: bool = True) -> list[dict]:
    """The records of an archive in memory."""
    return list(read_records(io.BytesIO(data), payloads))

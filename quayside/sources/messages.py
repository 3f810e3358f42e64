"""Message files to part rows.

Parsing a MIME tree is the one step Spark has no expression for. It runs as ``mapInPandas``
over one message per row; everything after it, HTML cleaning included, is native again.
Nothing is shuffled: a message's parts and their text leaves travel in its own row.
"""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_bytes
from email.errors import HeaderParseError
from email.header import decode_header
from email.message import Message
from email.parser import BytesHeaderParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.dates import received_at
from quayside.functions.ids import stable_id
from quayside.functions.text import html_to_text, is_blank, is_message_name, join_non_empty, part_filename
from quayside.session import bounded_batches

# --- Fixed values: part types treated as attached messages --------------------------------
MESSAGE_TYPES = ["message/rfc822", "message/delivery-status"]

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
HEADERS = ["message_id", "subject", "sender", "date_header"]
PARSED = ["path", "message_id", "parts"]
# Bytes of messages after which a worker passes on what it has parsed.
PIECE_BYTES = 2 << 20
PARSED_SCHEMA = (
    "path string, message_id string, parts array<struct<part_index:int, content_type:string, filename:string, "
    "leaves:array<struct<content_type:string, text:string>>>>"
)


def read_message_files(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """(path, content) of each message file. Large archives are better packed beforehand into a
    table with these two columns, which every function here takes as well."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def stream_message_files(spark: SparkSession, path: str, pattern: str = "*.eml", files_per_batch: int = 10_000) -> DataFrame:
    return (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
        .load(path).select("path", "content")
    )


# --- per-message helpers --------------------------------------------------------------------

def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def _decode(data: bytes, charset: str | None) -> str:
    try:
        return data.decode(charset or "utf-8", "replace")
    except (LookupError, UnicodeError):
        return data.decode("utf-8", "replace")


def _header(value) -> str:
    """Decoded header text; one with broken encoding is kept as it stands."""
    if not value:
        return ""
    try:
        chunks = decode_header(value)
    except (HeaderParseError, ValueError):
        return _clean(str(value))
    return _clean(" ".join(_decode(c, charset) if isinstance(c, bytes) else c for c, charset in chunks))


def _leaves(message: Message) -> Iterator[dict]:
    """Text leaves, depth first. ``walk`` enters attached messages too."""
    for part in message.walk():
        kind = None if part.is_multipart() else part.get_content_type()
        data = part.get_payload(decode=True) if kind in ("text/plain", "text/html") else None
        if data is not None:
            yield {"content_type": kind, "text": _clean(_decode(data, part.get_content_charset()))}


def _attached(part: Message, kind: str, filename: str) -> Message | None:
    """The message inside an attachment-like part."""
    if kind not in MESSAGE_TYPES and not filename.lower().endswith(".eml"):
        return None
    if kind == "message/rfc822" and part.is_multipart():
        return part.get_payload(0)
    data = part.get_payload(decode=True)
    return message_from_bytes(data) if data else None


def _message_id(message: Message, path: str) -> str:
    return _clean(str(message.get("Message-ID", path)))


def _parts(message: Message) -> Iterator[dict]:
    for index, part in enumerate(message.walk()):
        kind, filename = part.get_content_type(), _header(part.get_filename())
        inner = _attached(part, kind, filename)
        leaves = list(_leaves(inner)) if inner is not None else []
        yield {"part_index": index, "content_type": kind, "filename": filename, "leaves": leaves}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One message is parsed at a time, and what was parsed leaves in pieces: a worker holds neither all messages of a batch nor all their parts."""
    for batch in batches:
        rows, held = [], 0
        for path, content in zip(batch["path"], batch["content"]):
            message = message_from_bytes(content)
            rows.append((path, _message_id(message, path), list(_parts(message))))
            held += len(content)
            if held >= PIECE_BYTES:
                yield pd.DataFrame(rows, columns=PARSED)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=PARSED)


def _header_block(content: Column) -> Column:
    """Bytes up to the first empty line; the body stays in the JVM."""
    text = content.cast("string")
    return F.substring_index(F.substring_index(text, "\r\n\r\n", 1), "\n\n", 1).cast("binary")


@F.pandas_udf(T.StructType([T.StructField(name, T.StringType()) for name in HEADERS]))
def _headers(paths: pd.Series, blocks: pd.Series) -> pd.DataFrame:
    parser = BytesHeaderParser()
    rows = []
    for path, block in zip(paths, blocks):
        head = parser.parsebytes(block)
        rows.append((
            _message_id(head, path), _header(head.get("Subject")), _header(head.get("From")), _clean(str(head.get("Date", ""))),
        ))
    return pd.DataFrame(rows, columns=HEADERS)


# --- DataFrame level --------------------------------------------------------------------------

def with_headers(messages: DataFrame) -> DataFrame:
    """Add the decoded headers to (path, content) rows. Bodies are not parsed for this, so
    messages can be chosen by sender or subject before the full parse."""
    bounded_batches(messages.sparkSession)
    # Non-deterministic to the optimizer, so that a filter on a header does not decode it again.
    decode = _headers.asNondeterministic()
    return messages.withColumn("_h", decode("path", _header_block(F.col("content")))).select(*messages.columns, "_h.*")


def parse_messages(messages: DataFrame) -> DataFrame:
    """One row per message of (path, content) rows, with its MIME parts in walk order."""
    bounded_batches(messages.sparkSession)
    return messages.select("path", "content").mapInPandas(_parse, PARSED_SCHEMA)


def explode_parts(messages: DataFrame) -> DataFrame:
    """One row per MIME part."""
    return parse_messages(messages).select("path", "message_id", F.inline("parts"))


def is_attachment(content_type: Column, filename: Column) -> Column:
    """Attached messages, by type or by file name."""
    return content_type.isin(MESSAGE_TYPES) | is_message_name(filename)


def leaf_text(leaves: Column) -> Column:
    """Non-empty text leaves joined by a blank line, HTML cleaned."""
    texts = F.transform(leaves, lambda leaf: F.when(
        leaf["content_type"] == "text/html", html_to_text(leaf["text"])
    ).otherwise(leaf["text"]))
    return join_non_empty("\n\n", texts)


def attachment_parts(parts: DataFrame) -> DataFrame:
    return parts.where(is_attachment(F.col("content_type"), F.col("filename")))


def part_text(parts: DataFrame) -> DataFrame:
    """Replace the leaves of part rows by their text."""
    return parts.withColumn("raw_text", leaf_text(F.col("leaves"))).drop("leaves")


def message_emails(heads: DataFrame) -> DataFrame:
    """One e-mail row per message id of ``with_headers`` rows; the first path speaks for repeats."""
    fields = F.struct("subject", "sender", "date_header")
    firsts = heads.groupBy("message_id").agg(F.min_by(fields, "path").alias("_m")).select("message_id", "_m.*")
    return firsts.select(
        stable_id("message_id").alias("email_id"), "message_id", "subject", "sender",
        received_at("date_header").alias("date_received"), F.lit("fetching").alias("status"),
        F.current_timestamp().alias("created_at"),
    )


def message_attachments(parsed: DataFrame, first_n: int = 0) -> DataFrame:
    """Attachment rows of ``parse_messages`` rows; parts without text are dropped.

    A message is one row here, so its first ``first_n`` attachments (all when not positive) are
    a slice of an array, and no text is shuffled or sorted for it.
    """
    attached = F.filter("parts", lambda p: is_attachment(p["content_type"], p["filename"]))
    texts = F.transform(attached, lambda p: F.struct(
        p["part_index"].alias("part_index"), p["filename"].alias("filename"), leaf_text(p["leaves"]).alias("raw_text")
    ))
    usable = F.filter(texts, lambda t: ~is_blank(t["raw_text"]))
    kept = F.slice(usable, 1, first_n) if first_n > 0 else usable
    return parsed.select("message_id", F.inline(kept)).select(
        stable_id("message_id", "part_index").alias("attachment_id"),
        stable_id("message_id").alias("email_id"), "part_index",
        part_filename("filename", "part_index").alias("filename"), "raw_text",
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_message"),
        F.current_timestamp().alias("created_at"),
    )

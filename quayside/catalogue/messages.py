"""Mail messages built from the documents and pages by Spark, and read back."""

from pyspark.sql import functions as F

from quayside.catalogue.registry import query, table
from quayside.catalogue.text import HTML_TEXT_SQL
from quayside.plans.ingest import ingest
from quayside.session import shared_path
from quayside.sources.messages import attachment_parts, explode_parts, part_text
from quayside.sources.packed import read_message_archives, stream_message_archives, write_message_archives
from quayside.streaming.ingest import ingested_state, message_writer


def _mime_base64(text):
    return F.base64(F.encode(text, "utf-8"))


def document_messages(spark, sf):
    """Per document one message: a cover note, the text as an attached message, and the text
    again in an attached file whose name is an encoded header."""
    inner = F.concat(
        F.lit("Subject: inner\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"),
        _mime_base64("text"), F.lit("\r\n"),
    )
    message = F.concat(
        F.lit("Message-ID: <"), F.col("doc_id"), F.lit("@docs>\r\nFrom: "), "source", F.lit("@mail\r\nSubject: =?utf-8?B?"),
        F.base64(F.encode(F.concat(F.lit("Liste é "), "lang"), "utf-8")),
        F.lit("?=\r\nDate: Mon, 1 Jan 2024 10:00:00 +0530\r\nMIME-Version: 1.0\r\n"
              "Content-Type: multipart/mixed; boundary=\"=_outer\"\r\n\r\n--=_outer\r\nContent-Type: text/plain\r\n\r\nsee attached\r\n"
              "--=_outer\r\nContent-Type: message/rfc822\r\n\r\n"), inner,
        F.lit("\r\n--=_outer\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename=\"doc_"),
        "doc_id", F.lit(".EML\"\r\nContent-Transfer-Encoding: base64\r\n\r\n"), _mime_base64(inner), F.lit("\r\n--=_outer--\r\n"),
    )
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc/"), "doc_id").alias("path"), F.encode(message, "utf-8").alias("content")
    )


def page_messages(spark, sf):
    """Per page one message holding a message with a plain and an HTML body."""
    message = F.concat(
        F.lit("Message-ID: <"), F.col("page_id"), F.lit("@pages>\r\nFrom: web\r\nSubject: page\r\nContent-Type: multipart/mixed; boundary=o\r\n\r\n"
              "--o\r\nContent-Type: message/rfc822\r\n\r\nContent-Type: multipart/alternative; boundary=i\r\n\r\n"
              "--i\r\nContent-Type: text/plain; charset=no-such-charset\r\n\r\n"), "url",
        F.lit("\r\n--i\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), _mime_base64("html"),
        F.lit("\r\n--i--\r\n--o\r\nContent-Type: message/delivery-status\r\n\r\nStatus: 5.0.0\r\n\r\n--o--\r\n"),
    )
    return table(spark, sf, "pages").select(F.concat(F.lit("page/"), "page_id").alias("path"), F.encode(message, "utf-8").alias("content"))


_PARTS_SQL = r"""
    SELECT '<' || doc_id || '@docs>' AS message_id, 'Liste é ' || lang AS subject, p.part_index,
           CASE p.part_index WHEN 2 THEN 'attachment_002.eml' ELSE 'doc_' || doc_id || '.EML' END AS filename,
           length(text) AS n_chars, md5(text) AS text_md5
    FROM documents, (VALUES (2), (4)) AS p(part_index) WHERE trim(text, E' \t\n\r') <> ''"""


def _told(found):
    """Parts with their mail: texts are measured before they meet the mails, so none crosses the network."""
    mails = found.emails.select("email_id", "message_id", "subject")
    parts = found.attachments.select("email_id", "part_index", "filename", F.length("raw_text").alias("n_chars"), F.md5("raw_text").alias("text_md5"))
    return parts.join(mails, "email_id").drop("email_id")


@query(_PARTS_SQL)
def message_parts(spark, sf):
    return _told(ingest(document_messages(spark, sf)))


@query(_PARTS_SQL)
def packed_message_parts(spark, sf):
    """The messages written to archives, where they are read and made, and read back in splits much smaller than an archive."""
    folder = shared_path(spark, "archives")
    write_message_archives(document_messages(spark, sf), folder).count()
    return _told(ingest(read_message_archives(spark, folder, split_bytes=1 << 20)))


@query(_PARTS_SQL)
def stream_packed_messages(spark, sf):
    """Archives ingested as they come: two rounds, the second with archives that were added."""
    folder = shared_path(spark, "archives")
    messages = document_messages(spark, sf)
    first = F.xxhash64("path") % 2 == 0
    for name, part in (("a", messages.where(first)), ("b", messages.where(~first))):
        write_message_archives(part, f"{folder}/in", name).count()
        stream = stream_message_archives(spark, f"{folder}/in")
        message_writer(stream, f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return _told(ingested_state(spark, f"{folder}/out"))


@query(f"""
    SELECT 'page/' || page_id AS path, 1 AS part_index, 'message/rfc822' AS content_type,
           url || chr(10) || chr(10) || {HTML_TEXT_SQL.format(c='html')} AS raw_text FROM pages
    UNION ALL SELECT 'page/' || page_id, 5, 'message/delivery-status', '' FROM pages""")
def message_html_text(spark, sf):
    found = part_text(attachment_parts(explode_parts(page_messages(spark, sf))))
    return found.select("path", "part_index", "content_type", "raw_text")


@query("""
    SELECT '<' || doc_id || '@docs>' AS message_id, source || '@mail' AS sender, '2024-01-01 04:30:00' AS received FROM documents
    WHERE contains(source, 'src1') AND contains(lang, 'e')""")
def message_emails(spark, sf):
    found = ingest(document_messages(spark, sf), sender="SRC1", subject="liste É ")
    kept = found.emails.where(F.contains("subject", F.lit("e")) & F.substring("subject", 9, 2).contains("e"))
    return kept.select("message_id", "sender", F.date_format("date_received", "yyyy-MM-dd HH:mm:ss").alias("received"))

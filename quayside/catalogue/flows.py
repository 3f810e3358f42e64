"""Flows and edge cases that the other modules do not reach."""

from pyspark.sql import functions as F

from quayside.catalogue.messages import document_messages
from quayside.catalogue.registry import (
    DOCUMENT_ATTACHMENTS_SQL, EVENT_CELLS_SQL, FEED_SQL, LINE_RECORDS_SQL, document_attachments, event_records, line_records,
    order_attachments, query, status_feed, table,
)
from quayside.operators import counts, joins, merge, replies, select, status, superset
from quayside.operators.numbering import number_rows
from quayside.plans import diagnostics as diagnostics_plan
from quayside.plans.ingest import Snapshot, ingest, merge_ingested
from quayside.session import shared_path
from quayside.sources.events import append_status_events, stream_status_events
from quayside.streaming.status import current_rows, upsert_writer


@query("""
    SELECT record_id, region, part, attachment_id, filename FROM ({lines})
    JOIN (SELECT o_orderkey AS attachment_id, o_orderpriority AS filename FROM orders) USING (attachment_id) WHERE region = 'R'
""".format(lines=LINE_RECORDS_SQL))
def selected_some(spark, sf):
    """A selection that holds something, with ids given twice."""
    records = line_records(spark, sf).join(order_attachments(spark, sf).select("attachment_id", "filename"), "attachment_id")
    ids = records.where(F.col("region") == "R").select("record_id")
    return select.draft_payload(joins.selected_or_all(records, ids.union(ids))).select(
        "record_id", "region", F.col("dynamic_data")["part"].alias("part"), "attachment_id", "filename"
    )


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def is_in_texts(spark, sf):
    return select.is_in(table(spark, sf, "documents"), "lang", ["fr", "de", None, "de"]).select("doc_id", "lang")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 1 AND o_custkey <= 6000")
def is_in_long_list(spark, sf):
    """Digits as texts against a number, a list of any length, columns in their order."""
    return select.is_in(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", [str(i) for i in range(1, 6001, 2)])


@query("""
    SELECT row_number() OVER (ORDER BY lower(source), source, doc_id) AS place, doc_id
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS source FROM documents)""")
def records_by_source(spark, sf):
    """A reader's order: letters before case. The places are read from the sorted rows."""
    docs = table(spark, sf, "documents")
    records = docs.select(
        F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("filename"), "doc_id",
        F.col("doc_id").alias("attachment_id"), F.lit(0).alias("record_pos"), F.col("doc_id").alias("record_id"),
    )
    key = select.source_key("UTF8_LCASE")
    numbered = number_rows(records.withColumn("all", F.lit(0)), ["all"], [key, F.col("filename"), F.col("doc_id")], "place")
    return numbered.select("place", "doc_id")


@query(f"""
    WITH a AS ({DOCUMENT_ATTACHMENTS_SQL})
    SELECT 'status' AS part, status AS name, COUNT(*) AS n FROM a GROUP BY status
    UNION ALL SELECT 'error', error_message, COUNT(*) FROM a WHERE status = 'error' GROUP BY error_message
    UNION ALL SELECT 'preview', NULL, COUNT(*) FROM a WHERE status = 'error'
    UNION ALL SELECT 'marked', NULL, COUNT(*) FROM a WHERE status = 'error'
    UNION ALL SELECT 'total', NULL, (SELECT COUNT(*) FROM events)""")
def diagnostics_flow(spark, sf):
    found = diagnostics_plan.diagnostics(document_attachments(spark, sf), event_records(spark, sf))
    none, n = F.lit(None).cast("string").alias("name"), F.count(F.lit(1)).alias("n")
    total = found.total
    return (
        found.status.select(F.lit("status").alias("part"), F.col("status").alias("name"), F.col(found.status.columns[-1]).alias("n"))
        .unionByName(found.errors.groupBy(F.col("error_message").alias("name")).agg(n).select(F.lit("error").alias("part"), "name", "n"))
        .unionByName(found.previews.agg(n).select(F.lit("preview").alias("part"), none, "n"))
        .unionByName(found.counts.where("marker <> ''").agg(n).select(F.lit("marked").alias("part"), none, "n"))
        .unionByName(total.select(F.lit("total").alias("part"), none, F.col(total.columns[0]).alias("n")))
    )


@query(f"""
    SELECT user_id AS email_id, COUNT(DISTINCT event_id) AS record_count, COUNT(DISTINCT key) AS column_count
    FROM (SELECT user_id, event_id, unnest([event_type, 'k']) AS key FROM ({EVENT_CELLS_SQL})) GROUP BY user_id""")
def normalisation_counts(spark, sf):
    records = event_records(spark, sf)
    return counts.normalisation_counts(records, superset.key_superset(records, ["email_id"])).select(
        "email_id", "record_count", F.col("column_count").cast("long").alias("column_count"))


@query(f"""SELECT job_id, seq, '{{"type":"' || type || '","data":' || seq || '}}' AS payload FROM ({FEED_SQL})""")
def event_payload_plain(spark, sf):
    """An event that carries one value instead of fields."""
    sent = status.wrapped_payload(status_feed(table(spark, sf, "events")), "seq")
    return sent.select("job_id", F.get_json_object("payload", "$.data").cast("long").alias("seq"), "payload")


@query(f"""
    WITH cells AS ({EVENT_CELLS_SQL}), placed AS (SELECT *, CASE WHEN user_id % 3 > 0 THEN user_id END AS g FROM cells),
    keys AS (SELECT DISTINCT g, unnest([event_type, 'k']) AS key FROM placed)
    SELECT CAST(c.event_id AS VARCHAR) AS record_id, keys.key,
           CASE WHEN keys.key = c.event_type THEN val WHEN keys.key = 'k' THEN c.k ELSE '' END AS value
    FROM placed c JOIN keys ON c.g IS NOT DISTINCT FROM keys.g""")
def backfill_null_group(spark, sf):
    """Records without a group get the keys of their group, too."""
    records = event_records(spark, sf).withColumn("email_id", F.when(F.col("email_id") % 3 > 0, F.col("email_id")))
    filled = superset.backfill_records(records, superset.key_superset(records, ["email_id"]), ["email_id"])
    return filled.select("record_id", F.explode_outer("dynamic_data").alias("key", "value"))


@query("""
    SELECT 'old' AS kind, COUNT(*) AS n, COUNT(*) AS n_ids FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT 'new', COUNT(*), COUNT(*) FROM customer WHERE c_custkey % 2 = 1""")
def merge_nameless(spark, sf):
    """Messages without an id, all of one time, are told apart by their path."""
    mails = table(spark, sf, "customer").select(
        F.col("c_name").alias("email_id"), F.lit(None).cast("string").alias("message_id"), F.lit("done").alias("status"),
        F.col("c_name").alias("path"), F.lit(0).alias("created_at"), "c_custkey")
    stored = mails.where("c_custkey % 2 = 0").drop("c_custkey")
    merged = merge.merge_emails(stored, mails.where("c_custkey % 2 = 1").drop("c_custkey"), "created_at", ["path"])
    return merged.groupBy(F.when(F.col("is_incoming"), "new").otherwise("old").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("email_id").alias("n_ids"))


@query("""
    SELECT CAST(event_id AS VARCHAR) AS attachment_id, 0 AS record_pos, 'a=' || user_id AS cells FROM events""")
def retry_skips_bad_array(spark, sf):
    """An array without an object does not stand in the way of a later attempt; of repeats one counts."""
    good = F.concat(F.lit('[{"a": '), F.col("user_id"), F.lit("}]"))
    tries = F.array(*[
        F.struct(F.lit(i).alias("attempt"), content.alias("content"), F.lit(None).cast("string").alias("error"))
        for i, content in ((1, F.lit("[1]")), (2, F.lit("no array")), (7, good), (7, good), (9, F.lit('[{"b": 1}]')))
    ])
    rows = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("attachment_id"), F.inline(tries))
    made = replies.records_from_replies(replies.retry_results(rows))
    return made.select("attachment_id", "record_pos", F.array_join(F.transform(
        F.map_entries("dynamic_data"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("cells"))


def conversation_messages(spark, sf):
    """One message per conversation, every turn an attached file."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    inner = F.lit("Subject: turn\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n")
    parts = F.array_join(F.transform("t", lambda t: F.concat(
        F.lit("--b\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Disposition: attachment; filename=\"turn_"), t["turn"].cast("string"),
        F.lit(".eml\"\r\nContent-Transfer-Encoding: base64\r\n\r\n"), F.base64(F.concat(inner, F.base64(F.encode(t["text"], "utf-8")), F.lit("\r\n"))), F.lit("\r\n"))), "")
    message = F.concat(F.lit("Message-ID: <"), F.col("conv_id"), F.lit("@conv>\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n"), parts, F.lit("--b--\r\n"))
    return turns.select(F.concat(F.lit("conv/"), "conv_id").alias("path"), F.encode(message, "utf-8").alias("content"))


@query("""
    SELECT '<' || conv_id || '@conv>' AS message_id, COUNT(*) AS n_attachments, CAST(SUM(length(text)) AS BIGINT) AS n_chars
    FROM conversations WHERE trim(text, E' \t\n\r') <> '' GROUP BY conv_id""")
def ingest_many_parts(spark, sf):
    """Every attachment of a message counts, however many there are."""
    found = ingest(conversation_messages(spark, sf))
    return found.attachments.join(found.emails.select("email_id", "message_id"), "email_id").groupBy("message_id").agg(
        F.count(F.lit(1)).alias("n_attachments"), F.sum(F.length("raw_text")).alias("n_chars"))


@query("""
    SELECT 'email' AS kind, CASE WHEN doc_id % 3 = 2 THEN 'drafted' ELSE 'extracting' END AS state, COUNT(*) AS n
    FROM documents GROUP BY ALL
    UNION ALL SELECT 'attachment', CASE WHEN doc_id % 3 = 2 THEN 'done' ELSE 'pending' END, 2 * COUNT(*) FROM documents
              WHERE trim(text, E' \t\n\r') <> '' GROUP BY ALL
    UNION ALL SELECT 'record', 'kept', COUNT(*) FROM documents WHERE doc_id % 3 = 2 AND trim(text, E' \t\n\r') <> ''""")
def ingest_merge(spark, sf):
    """Two batches: the second brings a third of the messages again and another third anew."""
    messages = document_messages(spark, sf)
    number = F.element_at(F.split("path", "/"), 2).cast("long") % 3
    first, second = ingest(messages.where(number >= 1)), ingest(messages.where(number <= 1))
    stored = first.attachments.withColumn("status", F.lit("done"))
    records = stored.where("part_index = 2").select(F.concat(F.lit("r"), "attachment_id").alias("record_id"), "attachment_id")
    merged = merge_ingested(Snapshot(first.emails.withColumn("status", F.lit("drafted")), stored, records), second)
    n = F.count(F.lit(1)).alias("n")
    return (
        merged.emails.groupBy(F.col("status").alias("state")).agg(n).select(F.lit("email").alias("kind"), "state", "n")
        .unionByName(merged.attachments.groupBy(F.col("status").alias("state")).agg(n).select(F.lit("attachment").alias("kind"), "state", "n"))
        .unionByName(merged.records.agg(n).select(F.lit("record").alias("kind"), F.lit("kept").alias("state"), "n"))
    )


@query(f"SELECT attachment_id, max(seq) AS seq FROM ({FEED_SQL}) GROUP BY attachment_id")
def stream_status_events_read(spark, sf):
    """A feed appended to a table in two parts and read as a stream, several batches."""
    feed, path = status_feed(table(spark, sf, "events")), shared_path(spark, "feed")
    append_status_events(feed.where("seq % 2 = 0").repartition(2), path)
    append_status_events(feed.where("seq % 2 = 1").repartition(2), path)
    target = shared_path(spark, "latest")
    columns = ", ".join(f"{c} {t}" for c, t in feed.dtypes)
    stream = stream_status_events(spark, path, columns, files_per_batch=2).groupBy("attachment_id").agg(F.max("seq").alias("seq"))
    writer = upsert_writer(stream, target, shared_path(spark, "checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return current_rows(spark, target, "attachment_id").select("attachment_id", "seq")

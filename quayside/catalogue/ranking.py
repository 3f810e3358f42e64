"""Order-dependent queries."""

from pyspark.sql import functions as F

from quayside.catalogue.registry import (
    CUSTOMER_EMAILS_SQL, DOCUMENT_ATTACHMENTS_SQL, ORDER_ATTACHMENTS_SQL, conversation_attachments, customer_emails,
    document_attachments, order_attachments, query, table,
)
from quayside.functions.text import part_filename
from quayside.operators import ranking
from quayside.plans import views


@query("""
    SELECT conv_id AS email_id, turn AS part_index, printf('attachment_%03d.eml', turn) AS filename FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 5""")
def first_n_children(spark, sf):
    kept = ranking.first_n_attachments(conversation_attachments(spark, sf), 5)
    return kept.select("email_id", "part_index", part_filename(F.lit(""), "part_index").alias("filename"))


@query("SELECT conv_id AS email_id, turn AS part_index FROM conversations")
def first_n_unlimited(spark, sf):
    return ranking.first_n_attachments(conversation_attachments(spark, sf), 0).select("email_id", "part_index")


@query("""
    WITH r AS (SELECT conv_id AS email_id, conv_id || '-' || role AS attachment_id, role || '.EML' AS filename, turn AS record_pos,
                      row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS row_index FROM conversations)
    SELECT email_id, attachment_id, record_pos, row_index, (row_index - 1) % 2 AS stripe,
           COALESCE(lag(attachment_id) OVER (PARTITION BY email_id ORDER BY row_index) <> attachment_id, TRUE) AS is_break,
           replace(filename, '.EML', '') AS source_label
    FROM r""")
def group_breaks(spark, sf):
    records = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("email_id"), F.concat_ws("-", "conv_id", "role").alias("attachment_id"),
        F.concat("role", F.lit(".EML")).alias("filename"), F.col("turn").alias("record_pos"),
        F.concat_ws("-", "conv_id", "turn").alias("record_id"), F.lit(None).cast("string").alias("region"),
        F.create_map("role", F.lit("x")).alias("dynamic_data"),
    )
    rows = views.grid(records).rows
    return rows.select(
        "email_id", "attachment_id", "record_pos", "row_index", ranking.stripe("row_index").cast("long").alias("stripe"),
        "is_break", "source_label",
    )


@query("""
    SELECT l_suppkey AS email_id, l_orderkey, l_linenumber, l_partkey,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS row_index
    FROM lineitem""")
def numbered_lineitems(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("email_id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    order = [F.col(c) for c in ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]]
    return ranking.number_rows(lines, ["email_id"], order).drop("l_shipdate")


@query(f"""
    WITH r AS (SELECT a.*, COALESCE(status IN ('done'), FALSE) AS ready FROM ({DOCUMENT_ATTACHMENTS_SQL}) a)
    SELECT attachment_id, ready AND row_number() OVER (PARTITION BY email_id, ready ORDER BY part_index) = 1 AS show_action FROM r""")
def first_row_flag(spark, sf):
    rows = document_attachments(spark, sf).withColumn(
        "email_status", F.when(F.col("status") == "done", "drafted").otherwise("extracting")
    )
    return ranking.with_first_row_flag(rows, "email_id", "part_index").select("attachment_id", "show_action")


@query(f"""
    SELECT row_number() OVER (ORDER BY e.date_received DESC, a.email_id, a.part_index) AS list_pos, a.attachment_id,
           strftime(e.date_received, '%d %b %Y') AS date, strftime(e.date_received, '%H:%M') AS time, a.status, a.status IN ('done', 'extracting') AS can_preview,
           e.status = 'drafted' AND row_number() OVER (PARTITION BY a.email_id ORDER BY a.part_index) = 1 AS show_action
    FROM ({ORDER_ATTACHMENTS_SQL}) a JOIN ({CUSTOMER_EMAILS_SQL}) e USING (email_id)""")
def inbox(spark, sf):
    rows = views.inbox(customer_emails(spark, sf), order_attachments(spark, sf))
    return rows.select("list_pos", "attachment_id", "date", "time", "status", "can_preview", "show_action")


@query("""
    SELECT conv_id, arg_max(turn, turn) AS turn, md5(arg_max(text, turn)) AS text_md5
    FROM conversations WHERE contains(role, 'user') AND contains(lower(text), 'e') GROUP BY conv_id""")
def latest_match(spark, sf):
    messages = table(spark, sf, "conversations").withColumnsRenamed({"role": "sender", "text": "subject"})
    newest = ranking.latest_message(messages, "turn", "USER", "E", ["conv_id"])
    return newest.select("conv_id", "turn", F.md5("subject").alias("text_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents WHERE contains(lower(source), 'src3'))")
def latest_match_overall(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("sender"), "text")
    return ranking.latest_message(docs, "doc_id", sender="src3").select("doc_id", F.md5("text").alias("text_md5"))

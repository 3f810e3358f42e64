"""Projections, joins, counts, order."""

from pyspark.sql import functions as F

from quayside.catalogue.registry import (
    CUSTOMER_EMAILS_SQL, DOCUMENT_ATTACHMENTS_SQL, EVENT_PRIORITY, LINE_RECORDS_SQL, ORDER_ATTACHMENTS_SQL,
    conversation_attachments, customer_emails, document_attachments, event_records, line_records, map_text,
    order_attachments, query, table, text_time,
)
from quayside.functions.text import escape_html, or_dash, plural, status_label
from quayside.operators import counts, joins, select
from quayside.session import shared_path
from quayside.sources.tables import append_rows as append
from quayside.sources.tables import create_views, read_table
from quayside.operators.superset import key_superset


_FULL_SQL = """
    SELECT l.record_id, l.attachment_id, a.email_id, l.record_pos, 'flag=' || flag || ';part=' || part AS cells, region,
           is_validated, a.filename, e.subject, strftime(e.date_received, '%Y-%m-%d %H:%M:%S') AS date_received
    FROM ({lines}) l JOIN ({orders}) a USING (attachment_id) JOIN ({emails}) e USING (email_id)
""".format(lines=LINE_RECORDS_SQL, orders=ORDER_ATTACHMENTS_SQL, emails=CUSTOMER_EMAILS_SQL)


@query(_FULL_SQL)
def records_full_view(spark, sf):
    full = joins.records_full(line_records(spark, sf), order_attachments(spark, sf), customer_emails(spark, sf))
    return full.select(
        "record_id", "attachment_id", "email_id", "record_pos", map_text("dynamic_data").alias("cells"), "region",
        "is_validated", "filename", "subject", text_time("date_received").alias("date_received"),
    )


@query(_FULL_SQL)
def records_full_registered(spark, sf):
    """The same through registered tables and views."""
    create_views(
        spark, records=line_records(spark, sf), attachments=order_attachments(spark, sf), emails=customer_emails(spark, sf)
    )
    full = read_table(spark, "records_full", "record_id, attachment_id, email_id, record_pos, dynamic_data, region, is_validated, filename, subject, date_received")
    return full.withColumn("cells", map_text("dynamic_data")).withColumn("date_received", text_time("date_received")).drop("dynamic_data")


@query("""
    SELECT o_orderkey, sha256('=' || o_orderkey) AS id, '{"priority":"' || o_orderpriority || '"}' AS data FROM orders""")
def append_rows(spark, sf):
    """Append with derived ids and nested values as JSON text, then scan."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("data")
    )
    path = shared_path(spark, "appended")
    append(rows, path, "id", ["o_orderkey"], json_nested=True)
    return read_table(spark, path, "o_orderkey, id, data")


@query(f"""
    SELECT a.attachment_id, a.filename, a.status, COUNT(l.record_id) AS record_count
    FROM ({ORDER_ATTACHMENTS_SQL}) a LEFT JOIN ({LINE_RECORDS_SQL}) l USING (attachment_id)
    GROUP BY ALL""")
def record_counts_left(spark, sf):
    return joins.record_counts(order_attachments(spark, sf), line_records(spark, sf))


@query(f"""
    SELECT a.attachment_id, a.filename, a.status, COUNT(e.event_id) AS record_count,
           CASE WHEN a.status = 'error' THEN ' ← ERROR' ELSE '' END AS marker
    FROM ({DOCUMENT_ATTACHMENTS_SQL}) a LEFT JOIN events e ON CAST(e.user_id AS VARCHAR) = a.attachment_id
    GROUP BY ALL""")
def counts_report(spark, sf):
    records = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("attachment_id"), F.col("event_id").alias("record_id")
    )
    return counts.counts_report(document_attachments(spark, sf), records)


_NESTED_SQL = """
    SELECT d.doc_id AS email_id, {chunk} AS chunk, COUNT(c.conv_id) AS n_children,
           COALESCE(string_agg(c.turn || ':' || c.role || ':' || length(c.text), '|' ORDER BY c.k), '') AS children
    FROM documents d LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) - 1 AS k FROM conversations) c ON c.conv_id = d.doc_id
    GROUP BY ALL"""


def _nested(spark, sf, per_row):
    parents = table(spark, sf, "documents").select(F.col("doc_id").alias("email_id"))
    children = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("email_id"), "turn", "role", F.length("text").alias("n")
    )
    nested = joins.nest_children(parents, children, "email_id", "turn", ["role", "n"], "children", per_row)
    return nested.select("email_id", "chunk", F.size("children").cast("long").alias("n_children"), F.array_join(
        F.transform("children", lambda c: F.concat_ws(":", c["turn"], c["role"], c["n"])), "|").alias("children"))


@query(_NESTED_SQL.format(chunk="CAST(0 AS BIGINT)"))
def nested_children(spark, sf):
    return _nested(spark, sf, joins.CHILDREN_PER_ROW)


@query(_NESTED_SQL.format(chunk="CAST(COALESCE(c.k // 4, 0) AS BIGINT)"))
def nested_children_split(spark, sf):
    return _nested(spark, sf, 4)


@query(f"""
    SELECT c.conv_id AS email_id, e.status AS email_status, c.conv_id || '-' || c.turn AS attachment_id,
           c.turn AS part_index, c.role || '_' || c.turn || '.EML' AS filename,
           CASE WHEN c.role = 'user' THEN 'pending' ELSE 'done' END AS status
    FROM conversations c JOIN ({CUSTOMER_EMAILS_SQL}) e ON e.email_id = c.conv_id""")
def flatten_children(spark, sf):
    nested = joins.list_emails(customer_emails(spark, sf), conversation_attachments(spark, sf))
    return joins.flatten_emails(nested).select(
        "email_id", "email_status", "attachment_id", "part_index", "filename", "status"
    )


@query("""
    SELECT record_id, attachment_id FROM ({lines}) l
    WHERE attachment_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
""".format(lines=LINE_RECORDS_SQL))
def semi_selected(spark, sf):
    urgent = order_attachments(spark, sf).where(select.eq("filename", "1-URGENT"))
    return joins.selected(line_records(spark, sf), urgent, "attachment_id").select("record_id", "attachment_id")


@query("""
    SELECT record_id, region, part, attachment_id, filename FROM (
        SELECT 'all' AS pick, * FROM ({lines}) JOIN (SELECT o_orderkey AS attachment_id, o_orderpriority AS filename FROM orders) USING (attachment_id)
    )""".format(lines=LINE_RECORDS_SQL))
def selected_or_all(spark, sf):
    files = order_attachments(spark, sf).select("attachment_id", "filename")
    records = line_records(spark, sf).join(files, "attachment_id")
    nothing = records.where(F.col("record_pos") < 0).select("record_id")
    return select.draft_payload(joins.selected_or_all(records, nothing)).select(
        "record_id", "region", F.col("dynamic_data")["part"].alias("part"), "attachment_id", "filename"
    )


@query("""
    WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
         kept AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))
    SELECT 'email' AS kind, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment <> 'BUILDING'
    UNION ALL SELECT 'attachment', CAST(o_orderkey AS VARCHAR) FROM kept
    UNION ALL SELECT 'record', concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) FROM lineitem
              WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))""")
def anti_cascade(spark, sf):
    emails = customer_emails(spark, sf)
    left = joins.cascade_delete(
        emails, order_attachments(spark, sf), line_records(spark, sf), emails.where(select.eq("sender", "BUILDING"))
    )
    named = [
        df.select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").cast("string").alias("id"))
        for kind, df in zip(["email", "attachment", "record"], left)
    ]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("""
    SELECT o_orderkey, l.record_id, l.region, l.part
    FROM orders LEFT JOIN ({lines}) l ON l.attachment_id = o_orderkey""".format(lines=LINE_RECORDS_SQL))
def attachment_with_records(spark, sf):
    attachments = order_attachments(spark, sf).withColumn("raw_text", F.col("filename"))
    return joins.attachment_with_records(attachments, line_records(spark, sf)).select(
        F.col("attachment_id").alias("o_orderkey"), "record_id", "region", F.col("dynamic_data")["part"].alias("part")
    )


_DOCUMENTS_SQL = """
    WITH l AS (SELECT *, (row_number() OVER (PARTITION BY attachment_id ORDER BY record_pos NULLS LAST, record_id) - 1) // {per_row} AS chunk FROM ({lines}))
    SELECT o_orderkey, CAST(COALESCE(l.chunk, 0) AS BIGINT) AS chunk, CAST(count(l.record_id) AS INT) AS n_records,
           COALESCE(string_agg(concat_ws(':', l.record_id, l.region, l.part), ',' ORDER BY l.record_pos, l.record_id), '') AS records
    FROM orders LEFT JOIN l ON l.attachment_id = o_orderkey GROUP BY o_orderkey, l.chunk"""


def _documents(spark, sf, per_row):
    attachments = order_attachments(spark, sf).withColumn("raw_text", F.col("filename"))
    told = F.transform("records", lambda r: F.concat_ws(":", r["record_id"].cast("string"), r["region"], r["dynamic_data"]["part"]))
    return joins.attachment_documents(attachments, line_records(spark, sf), per_row).select(
        F.col("attachment_id").alias("o_orderkey"), "chunk", F.size("records").alias("n_records"), F.array_join(told, ",").alias("records"))


@query(_DOCUMENTS_SQL.format(lines=LINE_RECORDS_SQL, per_row=joins.CHILDREN_PER_ROW))
def attachment_documents(spark, sf):
    return _documents(spark, sf, joins.CHILDREN_PER_ROW)


@query(_DOCUMENTS_SQL.format(lines=LINE_RECORDS_SQL, per_row=2))
def attachment_documents_split(spark, sf):
    return _documents(spark, sf, 2)


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
      AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')""")
def filter_conjunction(spark, sf):
    orders = select.project(table(spark, sf, "orders"), "o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority")
    picked = select.is_in(select.where_all(orders, [select.eq("o_orderstatus", "O")]), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    buyers = table(spark, sf, "customer").where(select.eq("c_mktsegment", "AUTOMOBILE")).select("c_custkey")
    return select.project(select.is_in(picked, "o_custkey", buyers), "o_orderkey, o_custkey, o_totalprice")


@query("SELECT doc_id FROM labels WHERE quality = 0")
def filter_empty_list(spark, sf):
    """An empty list and a comparison with null keep nothing; what is left comes from a list of one."""
    labels = table(spark, sf, "labels")
    nothing = select.is_in(labels, "quality", []).unionByName(labels.where(select.eq("quality", None)))
    return nothing.unionByName(select.is_in(labels, "quality", [0])).select("doc_id")


@query("""
    SELECT doc_id, lang, source FROM documents
    WHERE contains(lower(source), 'src1') AND contains(lower(lang), 'n') AND trim(text, E' \\t\\n\\r') <> ''""")
def message_filters(spark, sf):
    docs = table(spark, sf, "documents").withColumnsRenamed({"source": "sender", "lang": "subject"})
    kept = select.drop_blank_text(select.subject_contains(select.from_sender(docs, "SRC1"), "N"), "text")
    return kept.select("doc_id", F.col("subject").alias("lang"), F.col("sender").alias("source"))


@query(f"SELECT status, COUNT(*) AS n_files FROM ({DOCUMENT_ATTACHMENTS_SQL}) GROUP BY status")
def status_summary(spark, sf):
    return counts.status_summary(document_attachments(spark, sf))


@query(f"""
    SELECT attachment_id, filename, error_message, COALESCE(length(raw_text), 0) AS raw_length
    FROM ({DOCUMENT_ATTACHMENTS_SQL}) WHERE status = 'error'""")
def error_details(spark, sf):
    return counts.error_details(document_attachments(spark, sf))


@query(f"""
    SELECT attachment_id, filename, COALESCE(NULLIF(substring(raw_text, 1, 1000), ''), '[NO RAW TEXT]') AS preview,
           greatest(COALESCE(length(raw_text), 0) - 1000, 0) AS more_chars
    FROM ({DOCUMENT_ATTACHMENTS_SQL}) WHERE status = 'error'""")
def error_preview(spark, sf):
    return counts.error_previews(document_attachments(spark, sf))


@query("""
    SELECT 'stored' AS kind, COUNT(*) AS total_records FROM lineitem
    UNION ALL SELECT 'extracted', CAST(COALESCE(SUM(quality), 0) AS BIGINT) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def totals(spark, sf):
    stored = counts.total_records(line_records(spark, sf)).withColumn("kind", F.lit("stored"))
    tried = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return stored.unionByName(counts.extraction_total(tried, "quality").withColumn("kind", F.lit("extracted")))


@query("""
    SELECT l_suppkey AS email_id, COUNT(*) AS n_records, COUNT(DISTINCT l_orderkey) AS n_sources,
           COUNT(DISTINCT NULLIF(l_returnflag, 'N')) AS n_regions
    FROM lineitem GROUP BY l_suppkey""")
def grid_stats(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("email_id"), F.col("l_orderkey").cast("string").alias("attachment_id"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("region"),
    )
    return counts.grid_stats(lines, ["email_id"])


@query("""
    SELECT user_id AS email_id, COUNT(*) AS n_records, COUNT(DISTINCT event_type) AS n_sources,
           COUNT(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END) AS n_regions,
           COUNT(DISTINCT event_type) + 1 AS n_columns
    FROM events GROUP BY user_id""")
def grid_stats_columns(spark, sf):
    records = event_records(spark, sf)
    supersets = key_superset(records, ["email_id"], priority=EVENT_PRIORITY)
    return counts.grid_stats(records, ["email_id"], supersets)


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1""")
def order_single(spark, sf):
    lines = select.project(table(spark, sf, "lineitem"), "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice")
    top = lines.where(F.col("l_extendedprice") > 0)
    return select.single(top.orderBy(F.col("l_extendedprice").desc_nulls_first(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@query("""
    SELECT doc_id, quality FROM (
        SELECT d.doc_id, l.quality * 100000000 + d.doc_id AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    WHERE quality IS NOT NULL ORDER BY quality ASC NULLS LAST LIMIT 50""")
def order_limit(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    keyed = joined.select("doc_id", (F.col("quality").cast("long") * 100_000_000 + F.col("doc_id")).alias("quality"))
    return select.limit(select.limit(select.order(keyed, "quality"), 50), 0)


@query(f"""
    SELECT email_id, sender, strftime(date_received, '%Y-%m-%d %H:%M:%S') AS date_received
    FROM ({CUSTOMER_EMAILS_SQL}) WHERE status = 'drafted' ORDER BY date_received DESC, email_id LIMIT 1""")
def first_ready_email(spark, sf):
    first = select.first_ready_email(customer_emails(spark, sf))
    return first.select("email_id", "sender", text_time("date_received").alias("date_received"))


@query(f"""
    SELECT attachment_id, status IN ('done', 'extracting') AS can_preview, replace(status, '_', ' ') AS label,
           filename || CASE WHEN length(filename) - 4 <> 1 THEN 's' ELSE '' END AS counted
    FROM ({ORDER_ATTACHMENTS_SQL})""")
def previewable(spark, sf):
    return order_attachments(spark, sf).select(
        "attachment_id", select.is_previewable().alias("can_preview"), status_label("status").alias("label"),
        F.concat("filename", plural(F.length("filename") - 4)).alias("counted"),
    )


@query("""
    SELECT c_mktsegment AS segment, c_custkey, c_name FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> ''""")
def non_empty_rows(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), "c_custkey", "c_name")
    return select.non_empty(rows, "segment").withColumn("c_name", or_dash(escape_html("c_name")))

"""Tables of changes applied to tables of rows."""

from pyspark.sql import functions as F

from quayside.catalogue.registry import (
    CUSTOMER_EMAILS_SQL, LINE_RECORDS_SQL, ORDER_ATTACHMENTS_SQL, customer_emails, line_records, map_text, money,
    order_attachments, query, table,
)
from quayside.operators import joins, merge, ranking


@query("""
    WITH old AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')),
         new AS (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
    SELECT COALESCE(old.o_orderkey, new.o_orderkey) AS o_orderkey,
           CASE WHEN old.o_orderkey IS NOT NULL THEN 'stored ' || old.o_orderkey ELSE 'made' END AS email_id,
           CASE WHEN new.o_orderkey IS NOT NULL THEN 'extracting' ELSE 'drafted' END AS status,
           CASE WHEN old.o_orderkey IS NOT NULL THEN 'old ' || old.o_orderpriority ELSE 'new ' || new.o_orderpriority END AS subject,
           new.o_orderkey IS NOT NULL AS is_incoming
    FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey""")
def merge_by_key(spark, sf):
    orders = table(spark, sf, "orders")

    def mails(df, tag, status):
        return df.select(
            F.concat(F.lit("stored "), "o_orderkey").alias("email_id"), F.col("o_orderkey").cast("string").alias("message_id"),
            F.concat(F.lit(f"{tag} "), "o_orderpriority").alias("subject"), F.lit(status).alias("status"), F.col("o_orderdate").alias("created_at"),
        )

    stored = mails(orders.where(F.col("o_orderstatus").isin("F", "O")), "old", "drafted")
    incoming = mails(orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), "new", "fetching")
    known = joins.existing_ids(incoming, stored).where("known_email_id IS NULL").select("message_id", F.lit(True).alias("made"))
    return merge.merge_emails(stored, incoming, "created_at").join(known, "message_id", "left").select(
        F.col("message_id").cast("long").alias("o_orderkey"), F.when(F.col("made"), "made").otherwise(F.col("email_id")).alias("email_id"),
        "status", "subject", "is_incoming",
    )


def customer_records(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("record_id"), F.col("c_nationkey").cast("long").alias("attachment_id"), F.lit(0).alias("record_pos"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("view"), F.lit("never")).alias("dynamic_data"),
        F.lit("start").alias("region"), F.lit(False).alias("is_validated"), F.lit(None).cast("timestamp").alias("created_at"),
    )


def event_edits(spark, sf):
    """Purchases replace the row, sign-ups set the region, views and clicks set a cell."""
    kind = F.col("event_type")
    return table(spark, sf, "events").where(kind != "error").select(
        F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"),
        F.when(kind == "purchase", "replace").otherwise("cell").alias("op"),
        F.when(kind == "signup", merge.REGION_FIELD).otherwise(kind).alias("field"), money("value").alias("value"),
        F.when(kind == "purchase", F.create_map(F.lit("bought"), money("value"))).alias("dynamic_data"),
        F.when((kind == "purchase") & (F.col("value") > 10), money("value")).alias("region"),
    )


@query("""
    WITH e AS (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS val FROM events),
    base AS (SELECT user_id, max(event_id) AS seq, arg_max(val, event_id) AS bought FROM e WHERE event_type = 'purchase' GROUP BY ALL),
    place AS (SELECT user_id, arg_max(val, event_id) AS region FROM e
              WHERE event_type = 'signup' OR (event_type = 'purchase' AND value > 10) GROUP BY ALL),
    cell AS (SELECT e.user_id, arg_max(val, event_id) FILTER (event_type = 'view') AS v,
                    arg_max(val, event_id) FILTER (event_type = 'click') AS c
             FROM e LEFT JOIN base USING (user_id) WHERE base.seq IS NULL OR e.event_id > base.seq GROUP BY ALL)
    SELECT c_custkey AS record_id, COALESCE(place.region, 'start') AS region, concat_ws(';',
        'bought=' || base.bought, 'click=' || cell.c, CASE WHEN base.seq IS NULL THEN 'segment=' || c_mktsegment END,
        'view=' || COALESCE(cell.v, CASE WHEN base.seq IS NULL THEN 'never' END)) AS cells
    FROM customer LEFT JOIN base ON base.user_id = c_custkey LEFT JOIN place ON place.user_id = c_custkey
    LEFT JOIN cell ON cell.user_id = c_custkey""")
def apply_edits(spark, sf):
    edited = merge.apply_edits(customer_records(spark, sf), event_edits(spark, sf))
    return edited.select("record_id", "region", map_text("dynamic_data").alias("cells"))


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def unmatched_edits(spark, sf):
    some = customer_records(spark, sf).where(F.col("dynamic_data")["segment"] == "BUILDING")
    return merge.unmatched_edits(some, event_edits(spark, sf)).select(F.col("seq").alias("event_id"))


@query("""
    SELECT c_custkey AS record_id, 'start' AS region, FALSE AS is_new, c_nationkey AS attachment_id FROM customer
    UNION ALL
    SELECT NULL, '', TRUE, arg_min(o_orderkey, (o_orderdate, o_orderkey)) FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey""")
def add_blank_rows(spark, sf):
    records = customer_records(spark, sf).withColumn("record_id", F.col("record_id").cast("string"))
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("email_id"), F.lit(1).alias("seq"))
    grown = merge.add_blank_rows(records, asked, order_attachments(spark, sf))
    new = F.length("record_id") == 64
    return grown.select(
        F.when(~new, F.col("record_id")).cast("long").alias("record_id"), "region", new.alias("is_new"), "attachment_id"
    )


@query("SELECT c_custkey AS email_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unmatched_requests(spark, sf):
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("email_id"))
    pending = order_attachments(spark, sf).where(F.col("status") == "pending")
    return merge.unmatched_requests(asked, pending).select("email_id")


@query(f"""
    SELECT email_id, CASE WHEN sender = 'BUILDING' THEN 'seen' ELSE status END AS status, TRUE AS checked
    FROM ({CUSTOMER_EMAILS_SQL})""")
def conditional_update(spark, sf):
    emails = customer_emails(spark, sf).withColumn("checked", F.lit(False))
    named = merge.conditional_update(emails, {"status": "seen"}, F.col("sender") == "BUILDING")
    return merge.conditional_update(named, {"checked": True}).select("email_id", "status", "checked")


@query(f"""
    SELECT email_id, CASE WHEN email_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
        THEN 'ready_for_validation' ELSE status END AS status FROM ({CUSTOMER_EMAILS_SQL})""")
def advance_status(spark, sf):
    done = order_attachments(spark, sf).where(F.col("status") == "pending").select("email_id")
    return merge.advance_status(customer_emails(spark, sf), done, "ready_for_validation").select("email_id", "status")


@query("""
    SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def delete_rows(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), "o_custkey")
    returned = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("record_id"))
    return merge.delete_rows(orders, returned).withColumnRenamed("record_id", "o_orderkey")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'changed' ELSE o_orderpriority END AS filename FROM orders""")
def replace_rows(spark, sf):
    files = order_attachments(spark, sf).select("attachment_id", "filename", "status")
    changed = files.where(F.col("status") == "error").withColumn("filename", F.lit("changed"))
    return merge.replace_rows(files, changed, "attachment_id").select(F.col("attachment_id").alias("o_orderkey"), "filename")


@query("""
    SELECT o_custkey AS email_id, bool_and(o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS all_selected,
           bool_or(o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS some_selected
    FROM orders GROUP BY o_custkey""")
def selection_state(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("email_id"), F.col("o_orderkey").alias("record_id"))
    ids = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"))
    return merge.selection_state(orders, ids, ["email_id"])


@query(f"""
    WITH e AS ({CUSTOMER_EMAILS_SQL}), a AS ({ORDER_ATTACHMENTS_SQL}), r AS ({LINE_RECORDS_SQL})
    SELECT 'emails.message_id repeated' AS check_name, (SELECT COUNT(*) FROM (SELECT sender FROM e GROUP BY 1 HAVING COUNT(*) > 1)) AS violations
    UNION ALL SELECT 'attachments without email', (SELECT COUNT(*) FROM a WHERE status <> 'error' AND (attachment_id % 6 = 0 OR email_id NOT IN (SELECT email_id FROM e)))
    UNION ALL SELECT 'records without attachment', (SELECT COUNT(*) FROM r WHERE record_pos = 2 OR attachment_id NOT IN (SELECT attachment_id FROM a WHERE status <> 'error'))
    UNION ALL SELECT 'emails.status unknown', (SELECT COUNT(*) FROM e WHERE email_id % 5 = 1)
    UNION ALL SELECT 'attachments.status unknown', (SELECT COUNT(*) FROM a WHERE status = 'pending' AND attachment_id % 4 <> 1)
    UNION ALL SELECT 'emails.subject missing', (SELECT COUNT(*) FROM e WHERE email_id % 7 = 0)
    UNION ALL SELECT 'emails.sender missing', (SELECT COUNT(*) FROM e WHERE sender = 'BUILDING')
    UNION ALL SELECT 'emails.date_received missing', (SELECT COUNT(*) FROM e WHERE email_id % 11 = 3)
    UNION ALL SELECT 'emails.status missing', (SELECT COUNT(*) FROM e WHERE email_id % 5 = 2)
    UNION ALL SELECT 'attachments.email_id missing', (SELECT COUNT(*) FROM a WHERE status <> 'error' AND attachment_id % 6 = 0)
    UNION ALL SELECT 'attachments.filename missing', (SELECT COUNT(*) FROM a WHERE status <> 'error' AND filename = '5-LOW')
    UNION ALL SELECT 'attachments.status missing', (SELECT COUNT(*) FROM a WHERE status <> 'error' AND attachment_id % 4 = 1)
    UNION ALL SELECT 'records.attachment_id missing', (SELECT COUNT(*) FROM r WHERE record_pos = 2)
    UNION ALL SELECT 'records.dynamic_data missing', (SELECT COUNT(*) FROM r WHERE region = 'R')""")
def integrity_report(spark, sf):
    """Segments stand for message ids (all repeat); failed attachments are left out (orphans), and every check is violated."""
    def without(df, **gone):
        return df.withColumns({c: F.when(~F.coalesce(F.expr(when), F.lit(False)), F.col(c)) for c, when in gone.items()})

    odd = F.when(F.col("email_id") % 5 == 1, "lost").otherwise(F.col("status"))
    emails = without(customer_emails(spark, sf).withColumn("message_id", F.col("sender")).withColumn("status", odd),
                     subject="email_id % 7 = 0", sender="sender = 'BUILDING'", date_received="email_id % 11 = 3", status="email_id % 5 = 2")
    kept = order_attachments(spark, sf).where(F.col("status") != "error")
    attachments = without(kept, email_id="attachment_id % 6 = 0", filename="filename = '5-LOW'", status="attachment_id % 4 = 1").withColumn(
        "status", F.when(F.col("status") == "pending", "odd").otherwise(F.col("status")))
    records = without(line_records(spark, sf), attachment_id="record_pos = 2", dynamic_data="region = 'R'")
    return merge.integrity_report(emails, attachments, records)


@query("""
    SELECT o_custkey AS email_id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS attachment_id FROM orders GROUP BY o_custkey""")
def first_attachment(spark, sf):
    return ranking.first_attachment(order_attachments(spark, sf))

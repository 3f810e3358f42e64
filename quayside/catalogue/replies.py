"""Replies built from events, read back."""

from pyspark.sql import functions as F

from quayside.catalogue.registry import DOCUMENT_ATTACHMENTS_SQL, EVENT_CELLS_SQL, document_attachments, map_text, money, query, table
from quayside.operators import replies
from quayside.plans import extract as extract_plan
from quayside.plans.diagnostics import retry_failed as retry_plan

# How a reply is garbled, by event type: fenced, wrapped in prose, two arrays, cut off, plain.


def event_replies(spark, sf):
    """Two objects per event: the event with its region, and the user with a key in capitals."""
    events = table(spark, sf, "events")
    first = F.to_json(F.create_map(
        F.lit("Val Ue"), money("value"), F.lit("k"), F.regexp_extract("props", r"(\d+)", 1), F.lit("region"), F.col("event_type")
    ))
    second = F.concat(F.lit('{"USER": '), F.col("user_id"), F.lit(', "ok": true, "tail": null}'))
    both = F.concat(F.lit("["), first, F.lit(", "), second, F.lit("]"))
    cut = F.concat(F.lit("["), first, F.lit(", "), F.expr("left({0}, length({0}) - 1)".format("_s")))
    return events.withColumn("_s", second).select(
        F.col("event_id").cast("string").alias("attachment_id"), "event_id", "event_type",
        F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), both, F.lit("\n```")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Here it is: "), both, F.lit(" - done")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("["), first, F.lit("] and also ["), second, F.lit("]")))
        .when(F.col("event_type") == "error", cut)
        .otherwise(both).alias("content"),
    )


_ALL_SQL = f"""
    WITH cells AS ({EVENT_CELLS_SQL}), pairs AS (
        SELECT CAST(event_id AS VARCHAR) AS attachment_id, event_type, 0 AS record_pos, event_type AS region,
               'k=' || k || ';val_ue=' || val AS cells FROM cells
        UNION ALL
        SELECT CAST(event_id AS VARCHAR), event_type, 1, NULL, 'ok=True;tail=None;user=' || user_id FROM cells)
    SELECT attachment_id, record_pos, region, cells,
           CASE event_type WHEN 'purchase' THEN '{{second}}' WHEN 'error' THEN '{{cut}}' ELSE 'outermost' END AS strategy
    FROM pairs"""


def _records(parsed):
    return replies.records_from_replies(parsed, ["strategy"]).select(
        "attachment_id", "record_pos", "region", map_text("dynamic_data").alias("cells"), "strategy"
    )


@query(_ALL_SQL.format(second="merged", cut="closed"))
def reply_roundtrip(spark, sf):
    resolved = event_replies(spark, sf).select("attachment_id", "content", F.lit(None).cast("string").alias("last_error"))
    return _records(replies.parsed_attempts(resolved))


@query(f"SELECT * FROM ({_ALL_SQL.format(second='first', cut='none')}) WHERE strategy = 'outermost' OR (strategy = 'first' AND record_pos = 0)")
def reply_first_mode(spark, sf):
    tries = event_replies(spark, sf).select(
        "attachment_id", F.lit(1).alias("attempt"), "content", F.lit(None).cast("string").alias("error")
    )
    return _records(replies.retry_results(tries))


@query("""
    SELECT CASE event_type WHEN 'purchase' THEN 'merged' WHEN 'error' THEN 'closed' ELSE 'outermost' END AS strategy,
           COUNT(*) AS n_replies, 2 * COUNT(*) AS n_records FROM events GROUP BY 1""")
def reply_repair(spark, sf):
    parsed = event_replies(spark, sf).select(replies.parse_reply("content").alias("p"))
    return parsed.groupBy(F.col("p.strategy").alias("strategy")).agg(
        F.count(F.lit(1)).alias("n_replies"), F.sum(F.size("p.elements")).alias("n_records")
    )


def event_attempts(spark, sf):
    """Attempts by event type: view ok at once; click fails, then gives nothing; purchase fails,
    then works; error fails three times and works at the fourth; signup gives nothing."""
    events = event_replies(spark, sf)
    plans = {
        "view": [("c", None)], "click": [(None, "boom"), ("[]", None)],
        "purchase": [(None, "boom"), (None, "bang"), ("c", None), (None, "late")],
        "error": [(None, "e1"), (None, "e2"), (None, "e3"), ("c", None)], "signup": [("[]", None)],
    }
    cases = None
    for kind, tries in plans.items():
        rows = F.array(*[
            F.struct(
                F.lit(i).alias("attempt"),
                (F.col("content") if text == "c" else F.lit(text).cast("string")).alias("content"),
                F.lit(error).cast("string").alias("error"),
            ) for i, (text, error) in enumerate(tries, 1)
        ])
        cases = F.when(F.col("event_type") == kind, rows) if cases is None else cases.when(F.col("event_type") == kind, rows)
    return events.select("attachment_id", F.inline(cases))


@query("""
    SELECT CAST(event_id AS VARCHAR) AS attachment_id,
           CASE event_type WHEN 'click' THEN 'error' ELSE 'done' END AS status,
           CASE event_type WHEN 'click' THEN 'boom' END AS error_message,
           CASE WHEN event_type IN ('view', 'purchase') THEN 2 WHEN event_type = 'error' THEN 2 ELSE 0 END AS record_count
    FROM events""")
def attempt_resolution(spark, sf):
    parsed = replies.parsed_attempts(replies.resolve_attempts(event_attempts(spark, sf)))
    return parsed.select("attachment_id", "status", "error_message", "record_count")


@query("""
    SELECT CASE event_type WHEN 'click' THEN 'error' ELSE 'done' END AS status, COUNT(*) AS n,
           CASE event_type WHEN 'click' THEN 'boom' END AS error_message
    FROM events GROUP BY ALL
    UNION ALL SELECT 'pending', COUNT(*), NULL FROM orders""")
def extract_flow(spark, sf):
    """Status of attachments after extraction; orders stand for attachments without replies."""
    answered = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("attachment_id"))
    waiting = table(spark, sf, "orders").select(F.concat(F.lit("order "), "o_orderkey").alias("attachment_id"))
    attachments = answered.unionByName(waiting).withColumns({
        "status": F.lit("pending"), "error_message": F.lit(None).cast("string")
    })
    done = extract_plan.extract(attachments, event_attempts(spark, sf))
    return done.attachments.groupBy("status", "error_message").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS attachment_id, CAST(chunk AS INT) AS chunk,
           md5('HEAD|' || substring(text, chunk * 12000 + 1, 12000) || '|TAIL') AS prompt_md5,
           length(substring(text, chunk * 12000 + 1, 12000)) + 10 AS prompt_length
    FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 11999) // 12000))) AS chunk FROM documents)""")
def request_text(spark, sf):
    """Whole texts in chunks."""
    asked = replies.build_requests(document_attachments(spark, sf), "HEAD|", "|TAIL", 12_000)
    return asked.select("attachment_id", "chunk", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_length"))


@query(f"""
    WITH a AS ({DOCUMENT_ATTACHMENTS_SQL}), new AS (
        SELECT CAST(event_id AS VARCHAR) AS attachment_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 ELSE 2 END AS n
        FROM events JOIN a ON a.attachment_id = CAST(event_id AS VARCHAR) WHERE a.status = 'error'),
    old AS (SELECT CAST(user_id AS VARCHAR) AS attachment_id, COUNT(*) AS n FROM events GROUP BY 1),
    hit AS (SELECT * FROM new WHERE n > 0)
    SELECT a.attachment_id, CASE WHEN hit.n > 0 THEN 'done' ELSE a.status END AS status,
           CASE WHEN hit.n > 0 THEN NULL ELSE a.error_message END AS error_message,
           COALESCE(hit.n, old.n, 0) AS n_records
    FROM a LEFT JOIN hit USING (attachment_id) LEFT JOIN old USING (attachment_id)""")
def retry_failed(spark, sf):
    attachments = document_attachments(spark, sf).drop("raw_text")
    stored = table(spark, sf, "events").select(
        F.concat(F.lit("old "), "event_id").alias("record_id"), F.col("user_id").cast("string").alias("attachment_id"),
        F.lit(0).alias("record_pos"), F.create_map("event_type", money("value")).alias("dynamic_data"),
        F.col("event_type").alias("region"),
    )
    tries = event_replies(spark, sf).select(
        "attachment_id", F.lit(1).alias("attempt"), "content", F.lit(None).cast("string").alias("error")
    )
    again = retry_plan(attachments, stored, tries)
    n = again.records.groupBy("attachment_id").agg(F.count(F.lit(1)).alias("n_records"))
    return again.attachments.join(n, "attachment_id", "left").select(
        "attachment_id", "status", "error_message", F.coalesce("n_records", F.lit(0).cast("long")).alias("n_records")
    )


@query("""
    SELECT CAST(event_id AS VARCHAR) AS attachment_id, 1 AS record_pos, CAST(user_id AS VARCHAR) AS element FROM events""")
def reply_rejects(spark, sf):
    """Elements that are not objects go to a reject table."""
    content = F.concat(F.lit('[{"a": "1"}, '), F.col("user_id"), F.lit("]"))
    resolved = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("attachment_id"), content.alias("content"), F.lit(None).cast("string").alias("last_error")
    )
    return replies.rejected_elements(replies.parsed_attempts(resolved))

"""Status events, as batch and as stream."""

from pyspark.sql import functions as F

from quayside.catalogue.registry import (
    DOCUMENT_ATTACHMENTS_SQL, FEED_SQL, FEED_STATUS, FEED_STATUS_SQL, FEED_TERMINAL, document_attachments, query,
    status_feed, table,
)
from quayside.operators import joins, ranking, select, status
from quayside.session import shared_path
from quayside.sources.events import append_status_events, stream_status_events
from quayside.streaming.status import (
    current_rows, dedup_writer, deduplicated_rows, event_window, recent_log_writer, recent_rows, upsert_writer,
)


def _feed(spark, sf):
    return status_feed(table(spark, sf, "events"))


_LATEST_SQL = f"SELECT attachment_id, arg_max({FEED_STATUS_SQL}, seq) AS status, max(seq) AS seq FROM ({FEED_SQL}) GROUP BY attachment_id"


@query(_LATEST_SQL)
def latest_status(spark, sf):
    return status.latest_status(_feed(spark, sf), FEED_STATUS)


_JOBS_SQL = f"""
    SELECT job_id, bool_or(type IN ('purchase', 'error')) AS finished, arg_max(type, seq) AS last_type, max(seq) AS last_seq
    FROM ({FEED_SQL}) GROUP BY job_id"""


@query(_JOBS_SQL)
def terminal_jobs(spark, sf):
    return status.job_states(_feed(spark, sf), FEED_TERMINAL)


@query(f"""
    WITH f AS ({FEED_SQL})
    SELECT f.job_id, f.seq, f.type FROM f JOIN (SELECT job_id, min(seq) AS stop FROM f WHERE type = 'error' GROUP BY 1) USING (job_id)
    WHERE seq <= stop""")
def events_up_to_end(spark, sf):
    return status.up_to_terminal(_feed(spark, sf), ["error"]).select("job_id", "seq", "type")


@query(f"SELECT seq, type FROM ({FEED_SQL}) WHERE job_id = 3")
def job_route(spark, sf):
    return status.job_events(_feed(spark, sf), 3).select("seq", "type")


_TOTALS_SQL = f"""
    SELECT job_id, CAST(SUM(CASE WHEN type = 'purchase' THEN record_count ELSE 0 END) AS BIGINT) AS total_records
    FROM ({FEED_SQL}) GROUP BY job_id"""


@query(_TOTALS_SQL)
def running_totals(spark, sf):
    return status.running_totals(_feed(spark, sf), "purchase")


@query(f"SELECT seq, job_id, type FROM ({FEED_SQL}) ORDER BY seq DESC LIMIT 50")
def recent_log(spark, sf):
    return select.recent_events(_feed(spark, sf)).select("seq", "job_id", "type")


_RECENT_SQL = f"""
    SELECT job_id, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM ({FEED_SQL}))
    WHERE rn <= 50"""


@query(_RECENT_SQL)
def recent_log_per_job(spark, sf):
    return ranking.recent_per_job(_feed(spark, sf)).select("job_id", "seq", "type")


@query(f"""
    SELECT a.attachment_id, COALESCE(l.status, a.status) AS status
    FROM ({DOCUMENT_ATTACHMENTS_SQL}) a LEFT JOIN ({_LATEST_SQL}) l ON CAST(l.attachment_id AS VARCHAR) = a.attachment_id""")
def live_over_stored(spark, sf):
    latest = status.latest_status(_feed(spark, sf), FEED_STATUS).withColumn("attachment_id", F.col("attachment_id").cast("string"))
    return joins.live_over_stored(document_attachments(spark, sf), latest).select("attachment_id", "status")


@query(f"""
    SELECT job_id, seq, '{{"type":"' || type || '","seq":' || seq || ',"attachment_id":' || attachment_id || '}}' AS payload
    FROM ({FEED_SQL})""")
def event_payload(spark, sf):
    feed = _feed(spark, sf).select("job_id", "type", "seq", "attachment_id")
    sent = status.event_payload(feed)
    return sent.select("job_id", F.get_json_object("payload", "$.seq").cast("long").alias("seq"), "payload")


# --- streaming ------------------------------------------------------------------------------------

def event_stream(spark, sf):
    """The events as a feed of four files, read one a micro-batch."""
    path = shared_path(spark, "events")
    append_status_events(table(spark, sf, "events").repartition(4), path)
    columns = ", ".join(f"{c} {t}" for c, t in table(spark, sf, "events").dtypes)
    return status_feed(stream_status_events(spark, path, columns, files_per_batch=1))


def run_upserts(spark, aggregated, name, key):
    folder = shared_path(spark, name)
    writer = upsert_writer(aggregated, f"{folder}/rows", f"{folder}/state", key, compact_every=2)
    writer.trigger(availableNow=True).start().awaitTermination()
    return current_rows(spark, f"{folder}/rows", key)


@query(_LATEST_SQL)
def stream_latest_status(spark, sf):
    return run_upserts(spark, status.latest_status(event_stream(spark, sf), FEED_STATUS), "latest", "attachment_id")


@query(_JOBS_SQL)
def stream_terminal_jobs(spark, sf):
    return run_upserts(spark, status.job_states(event_stream(spark, sf), FEED_TERMINAL), "jobs", "job_id")


@query(_TOTALS_SQL)
def stream_running_totals(spark, sf):
    return run_upserts(spark, status.running_totals(event_stream(spark, sf), "purchase"), "totals", "job_id")


def windowed_stream(spark, sf):
    """The events as a feed of four files, each later than the one before, by windows of event time."""
    path = shared_path(spark, "events")
    events = table(spark, sf, "events")
    cuts = events.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.01) if not events.isEmpty() else []
    quarter = F.lit(0)
    for cut in cuts:
        quarter = quarter + (F.col("event_id") > cut).cast("int")
    for i in range(len(cuts) + 1):
        append_status_events(events.where(quarter == i).coalesce(1), path)
    columns = ", ".join(f"{c} {t}" for c, t in events.dtypes)
    return event_window(status_feed(stream_status_events(spark, path, columns, files_per_batch=1)))


@query(_LATEST_SQL)
def stream_latest_status_bounded(spark, sf):
    parts = status.latest_status(windowed_stream(spark, sf), FEED_STATUS, ["window"])
    return status.merged_status(run_upserts(spark, parts, "latest", ["attachment_id", "window"]))


@query(_JOBS_SQL)
def stream_terminal_jobs_bounded(spark, sf):
    parts = status.job_states(windowed_stream(spark, sf), FEED_TERMINAL, ["window"])
    return status.merged_states(run_upserts(spark, parts, "jobs", ["job_id", "window"]))


@query(_TOTALS_SQL)
def stream_running_totals_bounded(spark, sf):
    parts = status.running_totals(windowed_stream(spark, sf), "purchase", ["window"])
    return status.merged_totals(run_upserts(spark, parts, "totals", ["job_id", "window"]))


@query(_RECENT_SQL)
def stream_recent_log(spark, sf):
    folder = shared_path(spark, "recent")
    writer = recent_log_writer(event_stream(spark, sf), f"{folder}/log", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return recent_rows(spark, f"{folder}/log").select("job_id", "seq", "type")


@query("SELECT DISTINCT attachment_id || '-' || type AS message_id FROM ({feed})".format(feed=FEED_SQL))
def stream_dedup(spark, sf):
    """Repeats are dropped however late they come."""
    named = event_stream(spark, sf).withColumn("message_id", F.concat_ws("-", "attachment_id", "type")).select("message_id")
    folder = shared_path(spark, "dedup")
    dedup_writer(named, f"{folder}/rows", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return deduplicated_rows(spark, f"{folder}/rows")

"""Streaming results equal their batch twins, also after a replayed batch."""

from pyspark.sql import functions as F

from quayside.catalogue.registry import FEED_STATUS, FEED_TERMINAL, status_feed
from quayside.operators import ranking, status
from quayside.sources.events import append_status_events, read_status_events, stream_status_events
from quayside.session import folders
from quayside.streaming.status import (
    current_rows, dedup_writer, deduplicated_rows, event_time, event_window, recent_log_writer, recent_rows, upsert_writer,
)

SCHEMA = "job_id long, seq long, ts timestamp, type string, attachment_id long, record_count int"


def feed_files(spark, path, n=6):
    events = status_feed(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    for i in range(n):
        append_status_events(events.where(F.col("seq") % n == i).coalesce(1), path)


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_aggregates(spark, tmp_path):
    path = str(tmp_path / "events")
    feed_files(spark, path)
    batch = read_status_events(spark, path, SCHEMA)
    for name, key, f in [
        ("latest", "attachment_id", lambda e: status.latest_status(e, FEED_STATUS)),
        ("jobs", "job_id", lambda e: status.job_states(e, FEED_TERMINAL)),
        ("totals", "job_id", lambda e: status.running_totals(e, "purchase")),
    ]:
        stream = stream_status_events(spark, path, SCHEMA, files_per_batch=1)
        out = str(tmp_path / name)
        run(upsert_writer(f(stream), out, str(tmp_path / f"{name}-state"), key, compact_every=2))
        kept = folders(spark, out)
        assert len([k for k in kept if k.startswith("base=")]) == 2 and len([k for k in kept if k.startswith("batch_id=")]) <= 4
        assert rows(current_rows(spark, out, key)) == rows(f(batch).select(*current_rows(spark, out, key).columns))


def test_recent_log_survives_new_files(spark, tmp_path):
    path, out, state = (str(tmp_path / p) for p in ("events", "log", "state"))
    feed_files(spark, path)

    def go():
        run(recent_log_writer(stream_status_events(spark, path, SCHEMA, files_per_batch=2), out, state, n=20))
        return rows(recent_rows(spark, out))

    assert go() == rows(ranking.recent_per_job(read_status_events(spark, path, SCHEMA), 20))
    feed_files(spark, path, 2)
    assert len(go()) == 200
    parts = folders(spark, out)
    assert len(parts) <= 10 and all(len(folders(spark, f"{out}/{p}")) <= 2 for p in parts)


def test_dedup(spark, tmp_path):
    path, out, state = (str(tmp_path / p) for p in ("events", "out", "state"))
    feed_files(spark, path)

    def go():
        named = stream_status_events(spark, path, SCHEMA, files_per_batch=2).withColumn(
            "message_id", F.when(F.col("seq") > 2, F.concat_ws("-", "job_id", "type"))).select("message_id", "seq")
        run(dedup_writer(named, out, state, parts=8))
        return [r.message_id for r in deduplicated_rows(spark, out).collect()]

    got = go()
    named = [g for g in got if g]
    assert len(named) == len(set(named)) == 50
    assert len(got) - len(named) == read_status_events(spark, path, SCHEMA).where("seq <= 2").count()
    feed_files(spark, path, 2)  # all of it again, and late
    assert len([g for g in go() if g]) == 50


def test_event_time_takes_timestamps_without_zone(spark):
    df = spark.readStream.schema("ts timestamp_ntz, x int").parquet("/root/testdata/sf0.001")
    assert dict(event_time(df).dtypes)["ts"] == "timestamp"


def test_state_leaves_with_the_watermark(spark, tmp_path):
    """The feed in order of time: state rows stay few while the windows they came from go, and the merged result is the batch's."""
    path = str(tmp_path / "events")
    events = status_feed(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    for i in range(6):
        append_status_events(events.where(F.floor(F.col("seq") * 6 / 10_000) == i).coalesce(1), path)
    batch = read_status_events(spark, path, SCHEMA)
    for name, key, f, merge in [
        ("latest", "attachment_id", lambda e, by: status.latest_status(e, FEED_STATUS, by), status.merged_status),
        ("jobs", "job_id", lambda e, by: status.job_states(e, FEED_TERMINAL, by), status.merged_states),
        ("totals", "job_id", lambda e, by: status.running_totals(e, "purchase", by), status.merged_totals),
    ]:
        keys, out = [key, "window"], str(tmp_path / name)
        stream = event_window(stream_status_events(spark, path, SCHEMA, files_per_batch=1))
        done = run(upsert_writer(f(stream, ["window"]), out, str(tmp_path / f"{name}-state"), keys, compact_every=2))
        held = [p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress]
        parts = current_rows(spark, out, keys)
        assert max(held) < parts.count() / 2 and held[-1] <= 2 * batch.select(key).distinct().count()
        assert rows(merge(parts)) == rows(f(batch, ()).select(*merge(parts).columns))


def test_recent_log_is_one_write_a_batch(spark, tmp_path):
    path, out, state = (str(tmp_path / p) for p in ("events", "log", "state"))
    feed_files(spark, path, 3)
    run(recent_log_writer(stream_status_events(spark, path, SCHEMA, files_per_batch=1), out, state, n=5))
    files = [f for p in folders(spark, out) for v in folders(spark, f"{out}/{p}") for f in folders(spark, f"{out}/{p}/{v}")]
    assert len(files) == len([v for p in folders(spark, out) for v in folders(spark, f"{out}/{p}")])
    assert {v for p in folders(spark, out) for v in folders(spark, f"{out}/{p}")} <= {"version=0", "version=1", "version=2"}
    again = rows(recent_rows(spark, out))
    assert again == rows(ranking.recent_per_job(read_status_events(spark, path, SCHEMA), 5))

"""Bloom filters, repeats left out without moving bodies, compaction of an ingested log."""

from pyspark.sql import functions as F

from quayside.operators import blooms
from quayside.plans.ingest import without_paths
from quayside.session import folders, pin
from quayside.sources.packed import stream_message_archives, write_message_archives
from quayside.streaming.ingest import ingested_state, message_writer
from tests.conftest import plan_of


def test_a_filter_passes_every_key_and_few_others(spark):
    keys = spark.range(30_000).select(F.col("id").cast("string").alias("k"))
    others = spark.range(30_000, 60_000).select(F.col("id").cast("string").alias("k"))
    both = keys.withColumn("known", F.lit(True)).unionByName(others.withColumn("known", F.lit(False)))
    marked = blooms.with_maybe(both, keys, "k", "maybe", pin, buckets=15).groupBy("known").agg(F.count_if("maybe").alias("n")).collect()
    n = {r.known: r.n for r in marked}
    assert n[True] == 30_000 and n[False] < 900
    none = blooms.with_maybe(both.limit(50), keys.limit(0), "k", "maybe", pin)
    assert none.where("maybe").isEmpty() and none.count() == 50
    assert blooms.with_maybe(spark.createDataFrame([(None,)], "k string"), keys, "k", "maybe", pin).count() == 1


def test_bodies_stay_where_they_are_at_any_number_of_repeats(spark, tmp_path):
    """With broadcasts by size switched off: only what a second filter passes is shuffled with its body."""
    spark.range(20_000).select(F.concat(F.lit("m/"), "id").alias("path"), F.encode(F.repeat(F.lit("x"), 20), "utf-8").alias("content")).write.parquet(str(tmp_path / "m"))
    messages = spark.read.parquet(str(tmp_path / "m"))
    gone = messages.where("substring(path, 3) % 3 > 0").select("path")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = sorted(f"m/{i}" for i in range(20_000) if i % 3 == 0)
        kept = without_paths(messages, gone)
        tree = plan_of(kept).split("\n\n")[0]
        assert "Exchange" not in tree.replace("BroadcastExchange", "") and "BroadcastHashJoin" in tree
        assert sorted(r.path for r in kept.collect()) == want
        # A filter that is far too small lets many through; those alone meet the paths.
        kept = without_paths(messages, gone, buckets=2)
        sure = plan_of(kept).split("\n\n")[0].split("Union")[1].split("SortMergeJoin")[0]
        assert "Exchange" not in sure.replace("BroadcastExchange", "")
        assert sorted(r.path for r in kept.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert without_paths(messages, gone.limit(0)).count() == 20_000


def mail(i, version):
    attached = f"Content-Type: message/rfc822\n\nContent-Type: text/plain\n\nbody {i} {version}\n"
    return f"Message-ID: <{i}@x>\nSubject: first {version}\nContent-Type: multipart/mixed; boundary=b\n\n--b\n{attached}\n--b--\n".encode()


def test_an_ingested_log_is_compacted(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", str(tmp_path / "out")
    plain = {}
    for n in range(9):
        rows = [(f"{n}/{i}", mail(i, n)) for i in range(n, n + 3)]
        for i in range(n, n + 3):
            plain.setdefault(i, [n, n])[1] = n
        write_message_archives(spark.createDataFrame(rows, "path string, content binary").coalesce(1), source, f"batch{n}").collect()
        message_writer(stream_message_archives(spark, source), target, str(tmp_path / "state"), compact_every=3).trigger(availableNow=True).start().awaitTermination()
        done = ingested_state(spark, target)
        told = done.emails.join(done.attachments, "email_id").select("message_id", "subject", "raw_text").collect()
        got = sorted((int(r.message_id[1:-3]), r.subject, r.raw_text.strip()) for r in told)
        assert got == [(i, f"first {a}", f"body {i} {b}") for i, (a, b) in sorted(plain.items())]
    assert len(folders(spark, f"{target}/emails")) <= 5 and len(folders(spark, f"{target}/_state")) == 4

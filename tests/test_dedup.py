"""Stream deduplication over many batches: results, files opened, replays."""

from pyspark.sql import functions as F

from quayside.session import folders, remove
from quayside.streaming import dedup


def feed(spark, path, i, names):
    spark.createDataFrame([(n, i) for n in names], "message_id string, batch long").coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, state, **settings):
    stream = spark.readStream.schema("message_id string, batch long").option("maxFilesPerTrigger", 1).parquet(path)
    query = dedup.dedup_writer(stream, out, state, **settings).trigger(availableNow=True).start()
    query.awaitTermination()


def test_files_opened_stay_few_over_fifty_batches(spark, tmp_path, monkeypatch):
    path, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    opened, asked, real = [], [], dedup.parts_to_open
    monkeypatch.setattr(dedup, "parts_to_open", lambda found, p: opened.append(real(found, p)) or opened[-1])
    look = dedup.suspects
    monkeypatch.setattr(dedup, "suspects", lambda new, p, known, key: asked.append(len(known)) or look(new, p, known, key))
    for i in range(50):
        again = [f"k{i - d}-{j}" for d, j in ((1, 3), (9, 5), (30, 7)) if i >= d]
        feed(spark, path, i, [f"k{i}-{j}" for j in range(40)] * 2 + again + [None])
    run(spark, path, out, state, parts=4, fan=4)
    rows = dedup.deduplicated_rows(spark, out).collect()
    named = [r.message_id for r in rows if r.message_id]
    assert len(named) == len(set(named)) == 50 * 40 and len(rows) - len(named) == 50
    assert all(r.message_id.startswith(f"k{r.batch}-") for r in rows if r.message_id)
    # Runs grow with the logarithm of the batches; of their parts those with a repeat are opened, and hardly another.
    assert max(asked) <= 3 * 3 and len(asked) == 49
    late = opened[-15:]
    assert max(map(len, late)) <= 12 and sum(map(len, late)) <= 5 * len(late)


def test_a_digest_rules_out_what_is_not_there_and_nothing_else(spark, tmp_path):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("message_id"), (F.col("id") % 3).cast("int").alias("part"))
    dedup.write_digest(keys, str(tmp_path), 0, 7, "message_id")
    (known,) = dedup.runs(spark, str(tmp_path))
    assert known[:2] == (0, 7) and known.buckets > 1
    assert dedup.suspects(keys, str(tmp_path), [known], "message_id").count() == 20_000
    others = keys.withColumn("message_id", F.concat(F.lit("x"), "message_id"))
    assert dedup.suspects(others, str(tmp_path), [known], "message_id").count() < 600


def test_a_replayed_batch_keeps_its_rows(spark, tmp_path):
    path, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    for i in range(4):
        feed(spark, path, i, [f"k{i}", "same"])
    run(spark, path, out, state, parts=2, fan=2)
    want = sorted(r.message_id for r in dedup.deduplicated_rows(spark, out).collect())
    assert want == ["k0", "k1", "k2", "k3", "same"]
    commits = sorted(int(n) for n in folders(spark, f"{state}/commits") if n.isdigit())
    remove(spark, f"{state}/commits/{commits[-1]}")
    run(spark, path, out, state, parts=2, fan=2)
    assert sorted(r.message_id for r in dedup.deduplicated_rows(spark, out).collect()) == want


def test_an_unfinished_batch_is_written_again(spark, tmp_path):
    path, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    for i in range(3):
        feed(spark, path, i, [f"k{i}", "same", None])
    run(spark, path, out, state, parts=2)
    remove(spark, f"{state}/commits/2")
    remove(spark, f"{out}/batch_id=2/_SUCCESS")
    remove(spark, f"{out}/_digests/level=0/run=2")
    run(spark, path, out, state, parts=2)
    rows = [r.message_id for r in dedup.deduplicated_rows(spark, out).collect()]
    assert sorted(r for r in rows if r) == ["k0", "k1", "k2", "same"] and rows.count(None) == 3

"""Message archives: exact round trips, every way of splitting them, batch and stream."""

import io
import mailbox
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quayside.sources.packed import messages_between, packed, read_message_archives, stream_message_archives, write_message_archives

LINES = st.lists(st.sampled_from([b"From ", b">From ", b">>From x", b"", b"text", b"\r", b"From", b" From ", b"\xff\x00"]), max_size=6).map(b"\n".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(LINES, max_size=6), st.integers(1, 60))
def test_any_split_gives_every_message_once(contents, step):
    data = b"".join(packed(f"m {i}\né", c) for i, c in enumerate(contents))
    found = [m for at in range(0, len(data), step) for m in messages_between(io.BytesIO(data), len(data), at, min(at + step, len(data)))]
    assert found == [(f"m {i}\né", c) for i, c in enumerate(contents)]


def test_messages_larger_than_a_piece(monkeypatch):
    monkeypatch.setattr("quayside.sources.packed._PIECE", 7)
    r = random.Random(1)
    contents = [bytes(r.choice(b"From \n>") for _ in range(r.randrange(200))) for _ in range(30)]
    data = b"".join(packed(str(i), c) for i, c in enumerate(contents))
    for step in (1, 13, 500, len(data)):
        found = [c for at in range(0, len(data), step) for _, c in messages_between(io.BytesIO(data), len(data), at, min(at + step, len(data)))]
        assert found == contents


@pytest.fixture
def messages(spark):
    rows = [(f"inbox/{i} é", f"Subject: {i}\n\nFrom here on\n>From there\n{'x' * (i * 37)}".encode()) for i in range(200)] + [("none", None), ("empty", b"")]
    return spark.createDataFrame(rows, "path string, content binary").repartition(3)


def rows(df):
    return sorted((r.path, bytes(r.content)) for r in df.collect())


def test_written_and_read_in_splits(spark, messages, tmp_path):
    want = sorted((r.path, bytes(r.content or b"")) for r in messages.collect())
    told = write_message_archives(messages, f"file://{tmp_path}/in", file_bytes=100_000).collect()
    assert len(told) > 3 and sum(r.messages for r in told) == 202
    assert not [p for p in (tmp_path / "in").iterdir() if p.name.startswith("_")]
    for split in (10_000, 1 << 30):
        got = read_message_archives(spark, f"file://{tmp_path}/in", split)
        assert rows(got) == want and (got.rdd.getNumPartitions() > 20) == (split == 10_000)
    write_message_archives(messages, f"file://{tmp_path}/in", file_bytes=100_000).collect()  # run again: replaced, not repeated
    assert rows(read_message_archives(spark, f"file://{tmp_path}/in")) == want
    boxes = [mailbox.mbox(r.archive) for r in told]  # any reader of mailboxes opens them
    assert sum(len(b) for b in boxes) == 202
    assert read_message_archives(spark, f"file://{tmp_path}/nothing").count() == 0


def test_stream_takes_new_archives_once(spark, messages, tmp_path):
    def go():
        query = stream_message_archives(spark, f"file://{tmp_path}/in", 50_000).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(
            availableNow=True).format("parquet").start(str(tmp_path / "out"))
        query.awaitTermination()
        return rows(spark.read.schema("path string, content binary").parquet(str(tmp_path / "out")))

    write_message_archives(messages.where("path < 'inbox/2'"), f"file://{tmp_path}/in", "a").collect()
    first = go()
    assert first and go() == first
    write_message_archives(messages.where("path >= 'inbox/2'"), f"file://{tmp_path}/in", "b").collect()
    assert go() == sorted((r.path, bytes(r.content or b"")) for r in messages.collect())

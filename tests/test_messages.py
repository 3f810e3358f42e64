"""Message files written here, read back through the sources and flows."""

import base64
import os
import random
from email.message import EmailMessage
from email.mime.message import MIMEMessage
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

import pytest
from pyspark.sql import functions as F

from quayside.plans.ingest import Snapshot, ingest, merge_ingested, superseded_paths, without_paths
from quayside.schemas import ATTACHMENTS, EMAILS, RECORDS
from quayside.sources import messages as m
from quayside.streaming.ingest import ingest_writer, ingested_state


def inner(text, subtype="plain"):
    msg = MIMEText(text, subtype, "utf-8")
    msg["Subject"] = "inner"
    return msg


def outer(message_id, *parts, subject="Positions", sender="broker@mail", date="Mon, 1 Jan 2024 10:00:00 +0530"):
    msg = MIMEMultipart()
    if message_id:
        msg["Message-ID"] = message_id
    msg["Subject"], msg["From"], msg["Date"] = subject, sender, date
    msg.attach(MIMEText("cover", "plain"))
    for part in parts:
        msg.attach(part)
    return msg


def eml_file(name, data):
    part = MIMEText("", "plain")
    part.replace_header("Content-Type", f'application/octet-stream; name="{name}"')
    part.replace_header("Content-Transfer-Encoding", "base64")
    part["Content-Disposition"] = f'attachment; filename="{name}"'
    part.set_payload(base64.encodebytes(data).decode())
    return part


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("mail")
    nested = outer("<nested>", MIMEMessage(outer("<mid>", MIMEMessage(inner("deep text")))))
    both = MIMEMultipart("alternative")
    both.attach(MIMEText("plain side", "plain"))
    both.attach(MIMEText("<p>html&nbsp;&amp;lt; side</p>", "html"))
    report = EmailMessage()
    report["Message-ID"] = "<report>"
    report.set_content("x")
    bad = b"Subject: b\r\nContent-Type: text/plain; charset=nope\r\n\r\ncaf\xc3\xa9 \xff"
    files = {
        "plain": outer("<plain>", MIMEMessage(inner("plain text"))),
        "html": outer("<html>", MIMEMessage(inner("<b>bold</b>  text", "html"))),
        "both": outer("<both>", MIMEMessage(both)),
        "nested": nested,
        "blank": outer("<blank>", MIMEMessage(inner(" \n  "))),
        "named": outer("<named>", eml_file("Doc.EML", b"Content-Type: text/plain\r\n\r\nfrom file"), eml_file("other.txt", b"no")),
        "charset": outer("<charset>", eml_file("bad.eml", bad)),
        "header": outer("<header>", MIMEMessage(inner("t")), subject="=?utf-8?B?" + base64.b64encode("Frü Liste".encode()).decode() + "?= TAIL"),
        "many": outer("<many>", *[MIMEMessage(inner(f"part {i}")) for i in range(7)]),
        "noid": outer(None, MIMEMessage(inner("no id")), date="yesterday"),
        "alone": inner("nothing attached"),
    }
    for name, msg in files.items():
        (out / f"{name}.eml").write_bytes(msg.as_bytes())
    (out / "status.eml").write_bytes(
        b"Message-ID: <status>\r\nContent-Type: multipart/report; boundary=b\r\n\r\n--b\r\nContent-Type: message/delivery-status\r\n\r\n"
        b"Status: 5.0.0\r\n\r\n--b--\r\n")
    (out / "raw.eml").write_bytes(b"Subject: caf\xe9\r\nFrom: =?bogus?Q?x?=\r\n\r\n\xff\xfe body")
    (out / "empty.eml").write_bytes(b"")
    (out / "skip.txt").write_bytes(b"Message-ID: <skip>\r\n\r\n")
    return out


def texts(spark, folder, **options):
    found = ingest(m.read_message_files(spark, str(folder)), **options)
    rows = found.attachments.join(found.emails, "email_id").select("message_id", "part_index", "filename", "raw_text")
    return {(r.message_id.strip("<>"), r.part_index): (r.filename, r.raw_text) for r in rows.collect()}


def test_attachments(spark, folder):
    got = texts(spark, folder, first_n=0)
    assert got[("plain", 2)] == ("attachment_002.eml", "plain text")
    assert got[("html", 2)][1] == "bold text"
    assert got[("both", 2)][1] == "plain side\n\nhtml < side"
    assert got[("nested", 2)][1] == "cover\n\ndeep text" and got[("nested", 5)] == ("attachment_005.eml", "deep text")
    assert got[("named", 2)] == ("Doc.EML", "from file")
    assert got[("charset", 2)][1] == "café �"
    assert {k[0] for k in got} == {"plain", "html", "both", "nested", "named", "charset", "header", "many"} | {
        k[0] for k in got if k[0].endswith("noid.eml")}
    assert len([k for k in got if k[0] == "many"]) == 7
    assert len([k for k in texts(spark, folder, first_n=5) if k[0] == "many"]) == 5
    assert texts(spark, folder) == got


def test_emails(spark, folder):
    rows = {r.message_id: r for r in ingest(m.read_message_files(spark, str(folder))).emails.collect()}
    assert len(rows) == 13 and "<skip>" not in rows
    assert rows["<header>"].subject.split() == ["Frü", "Liste", "TAIL"]
    assert rows["<plain>"].sender == "broker@mail" and str(rows["<plain>"].date_received) == "2024-01-01 04:30:00"
    assert any(k.endswith("noid.eml") for k in rows)


def test_filters_choose_before_parsing(spark, folder):
    assert {k[0] for k in texts(spark, folder, subject="LISTE", sender="BROKER")} == {"header"}
    assert texts(spark, folder, sender="nobody") == {}


BROKEN = [
    b"Subject: =?utf-8?B?a?=\r\nFrom: =?utf-8?Q?=ZZ?=\r\n\r\nx", b"Content-Type: message/rfc822\r\nContent-Transfer-Encoding: base64\r\n\r\n!!!!",
    b"Content-Type: multipart/mixed\r\n\r\nno boundary", b"Content-Type: text/plain; charset*=x''%zz\r\n\r\n\xff",
    b"Content-Disposition: attachment; filename*0*=bad'x'%E9; filename*1=.eml\r\nContent-Transfer-Encoding: uuencode\r\n\r\nbegin\r\n$$$",
    b"Message-ID: \xe9\xff\r\nDate: \xff\r\n\r\n", b"\x00\x01\x02", b"a" * 10_000, b"\n\n", b"Content-Type: \xff/\xfe; name=\"a.eml\"\r\n\r\nz",
]


def test_broken_messages_do_not_stop_the_job(spark):
    rng = random.Random(5)
    seeds = BROKEN + [outer("<x>", MIMEMessage(inner("t")), eml_file("a.eml", b"Subject: =?x?\r\n\r\nq")).as_bytes()]
    cases = list(seeds)
    for i in range(400):
        data = bytearray(rng.choice(seeds))
        for _ in range(rng.randrange(1, 8)):
            at = rng.randrange(len(data))
            data[at:at + rng.randrange(3)] = bytes([rng.choice(b"=?;\"'\r\n\x00\xff*:/ ")])
        cases.append(bytes(data))
    df = spark.createDataFrame([(f"p{i}", c) for i, c in enumerate(cases)], "path string, content binary")
    found = ingest(df, first_n=0)
    assert found.emails.count() > 0 and found.attachments.count() > 0
    assert m.explode_parts(df).select("path").distinct().count() == len(cases)


def test_packed_input_gives_the_same(spark, folder, tmp_path):
    m.read_message_files(spark, str(folder)).write.parquet(str(tmp_path / "packed"))
    packed = m.explode_parts(spark.read.parquet(str(tmp_path / "packed")))
    direct = m.explode_parts(m.read_message_files(spark, str(folder)))
    assert sorted(packed.collect(), key=str) == sorted(direct.collect(), key=str)


def test_merge_ingested(spark, folder):
    new = ingest(m.read_message_files(spark, str(folder)))
    empty = Snapshot(*[spark.createDataFrame([], s) for s in (EMAILS, ATTACHMENTS, RECORDS)])
    first = merge_ingested(empty, new)
    n_mail, n_att = first.emails.count(), first.attachments.count()
    assert n_mail == 13 and n_att == new.attachments.count()
    rec = first.attachments.limit(3).select(
        F.col("attachment_id").alias("record_id"), "attachment_id", F.lit(0).alias("record_pos"),
        F.create_map(F.lit("a"), F.lit("b")).alias("dynamic_data"), F.lit("x").alias("region"), F.lit(False).alias("is_validated"), "created_at")
    drafted = first.emails.withColumns({"status": F.lit("drafted"), "subject": F.lit("kept")})
    again = merge_ingested(Snapshot(drafted, first.attachments, rec), new)
    assert {(r.status, r.subject) for r in again.emails.collect()} == {("extracting", "kept")}
    assert again.emails.count() == n_mail and again.attachments.count() == n_att and again.records.count() == 0


def test_stream_ingest(spark, folder, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    names = sorted(p.name for p in folder.glob("*.eml"))
    for name in names[:6]:
        (source / name).write_bytes((folder / name).read_bytes())

    def run():
        ingest_writer(spark, str(source), target, str(tmp_path / "state"), files_per_batch=4).trigger(
            availableNow=True).start().awaitTermination()
        return ingested_state(spark, target)

    run()
    for name in names[6:]:
        (source / name).write_bytes((folder / name).read_bytes())
    second = (source / "many.eml").stat().st_mtime + 5
    newer = outer("<many>", MIMEMessage(inner("only one now")), subject="changed")
    (source / "many_again.eml").write_bytes(newer.as_bytes())
    os.utime(source / "many_again.eml", (second, second))
    state = run()
    mails = {r.message_id: r for r in state.emails.collect()}
    assert len(mails) == 13 and mails["<many>"].subject == "Positions"
    many = [r.raw_text for r in state.attachments.where(F.col("email_id") == mails["<many>"].email_id).collect()]
    assert many == ["only one now"]


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_repeats_in_one_batch(spark, folder, limit):
    """With the repeated paths sent to the messages, and with a shuffled join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    files = m.read_message_files(spark, str(folder)).where(F.col("path").endswith("many.eml"))
    newer = outer("<many>", MIMEMessage(inner("only one now")), subject="changed").as_bytes()
    both = files.unionByName(spark.createDataFrame([("z/later", newer)], "path string, content binary"))
    found = ingest(both)
    assert [r.subject for r in found.emails.collect()] == ["Positions"]
    assert [r.raw_text for r in found.attachments.collect()] == ["only one now"]
    paths = superseded_paths(m.with_headers(both))
    assert [r.path for r in without_paths(both, paths).collect()] == ["z/later"]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_worker_holds_a_bounded_piece_of_a_batch(spark):
    """Parsed messages leave in pieces by their bytes, and batches themselves are bounded, whatever the table's size."""
    import pandas as pd

    text = outer("<m>", MIMEMessage(inner("x" * 40_000))).as_bytes()
    batch = pd.DataFrame({"path": [f"p{i}" for i in range(300)], "content": [text] * 300})
    pieces = list(m._parse(iter([batch])))
    assert [p for piece in pieces for p in piece["path"]] == list(batch["path"])
    assert max(len(piece) for piece in pieces) * len(text) < m.PIECE_BYTES + len(text)
    rows = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("p"), "id").alias("path"), F.lit(text).alias("content"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    m.parse_messages(rows)
    sizes = rows.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n int")
    assert sizes.agg(F.max("n")).first()[0] <= 500


def test_archives_are_written_by_as_many_tasks_as_the_table_has_splits(spark, tmp_path, monkeypatch):
    from quayside.catalogue import messages as catalogue

    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 50).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    docs.repartition(12).write.option("maxRecordsPerFile", 5).parquet(str(tmp_path / "documents.parquet"))
    seen, write = [], catalogue.write_message_archives
    monkeypatch.setattr(catalogue, "write_message_archives", lambda messages, *rest: seen.append(messages.rdd.getNumPartitions()) or write(messages, *rest))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "4096")
    try:
        assert catalogue.packed_message_parts(spark, str(tmp_path)).count() == 120
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] >= 12

"""Properties, idempotence and hot keys on small tables built here."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.config_tables import zone_rules
from quayside.operators import counts, joins, merge, ranking, report, select, status, superset, zones
from quayside.plans import views
from quayside.plans.normalise import normalise
from quayside.plans.report import report as report_plan
from quayside.schemas import ATTACHMENTS, EMAILS, RECORDS, TABLES
from quayside.sources import tables


@pytest.fixture(scope="module")
def skewed(spark):
    """3 000 records of 40 e-mails; one e-mail, one zone and one attachment hold over a third."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        mail = 0 if i % 5 < 2 else rng.randrange(1, 40)
        att = f"{mail}-0" if i % 3 == 0 else f"{mail}-{rng.randrange(4)}"
        keys = rng.sample(["vessel_name", "dwt", "sdwt", "imo", "x y", "comments", "zz"], rng.randrange(0, 5))
        data = {k: rng.choice(["", " - ", "unknown", "v<1>", "7"]) for k in keys}
        region = rng.choice(["SINGAPORE"] * 5 + [None, "", " ", "AG", "Durban", "nowhere"])
        rows.append((f"r{i:05d}", att, i, data, region, mail, f"f{mail % 3}.eml" if mail % 4 else ""))
    return spark.createDataFrame(
        rows, "record_id string, attachment_id string, record_pos int, dynamic_data map<string,string>, region string, "
              "email_id int, filename string").repartition(16).cache()


def test_numbering_is_exact_under_skew(skewed):
    got = ranking.number_rows(skewed, ["email_id"], [F.col("record_pos")]).collect()
    want, by_mail = {}, {}
    for r in sorted(skewed.collect(), key=lambda r: r.record_pos):
        by_mail[r.email_id] = by_mail.get(r.email_id, 0) + 1
        want[r.record_id] = by_mail[r.email_id]
    assert {r.record_id: r.row_index for r in got} == want


def test_hot_group_is_numbered_in_many_tasks(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = skewed.orderBy("email_id", "record_pos").select("email_id", F.spark_partition_id().alias("p"))
        sizes = {(r.email_id, r.p) for r in ordered.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([p for mail, p in sizes if mail == 0]) >= 3


def test_numbering_without_groups_and_with_null_groups(spark, skewed):
    whole = ranking.number_rows(skewed, [], [F.col("record_pos")]).collect()
    assert sorted(r.row_index for r in whole) == list(range(1, 3001))
    nulls = spark.createDataFrame([(None, 2), (None, 1), (1, 1)], "g int, p int")
    assert sorted((str(r.g), r.p, r.row_index) for r in ranking.number_rows(nulls, ["g"], [F.col("p")]).collect()) == [
        ("1", 1, 1), ("None", 1, 1), ("None", 2, 2)]


def test_group_breaks_match_a_look_back(skewed):
    rows = views.grid(skewed).rows.collect()
    previous = {}
    for r in sorted(rows, key=lambda r: (r.email_id, r.row_index)):
        assert r.is_break == (previous.get(r.email_id) != r.attachment_id)
        previous[r.email_id] = r.attachment_id
        assert r.source_label == (r.filename.removesuffix(".eml") or r.attachment_id)


def test_superset_and_backfill_properties(skewed):
    keys = {r.email_id: r.superset for r in superset.key_superset(skewed, ["email_id"]).collect()}
    supersets = superset.key_superset(skewed, ["email_id"])
    once = superset.backfill_records(skewed, supersets, ["email_id"])
    twice = superset.backfill_records(once, superset.key_superset(once, ["email_id"]), ["email_id"])
    before = {r.record_id: r.dynamic_data for r in skewed.collect()}
    for r in once.collect():
        assert set(r.dynamic_data) == set(keys.get(r.email_id, []))
        assert {k: r.dynamic_data[k] for k in before[r.record_id]} == before[r.record_id]
    assert {r.record_id: r.dynamic_data for r in twice.collect()} == {r.record_id: r.dynamic_data for r in once.collect()}


def test_preview_keys_first_seen(skewed):
    got = {r.email_id: r.columns for r in superset.preview_keys(skewed, ["email_id"], "record_pos").collect()}
    want = {}
    for r in skewed.select("email_id", "record_pos", F.map_keys("dynamic_data").alias("keys")).orderBy("record_pos").collect():
        seen = want.setdefault(r.email_id, [])
        seen.extend(k for k in r["keys"] if k not in seen)
    assert got == {k: v for k, v in want.items() if v}


def test_zone_counts_sum_to_rows(spark, skewed):
    by_row = zones.zone_counts(zones.with_zone(skewed), ["email_id"])
    by_rule = zones.zone_counts(zones.match_rules(skewed, "region", zone_rules(spark)), ["email_id"])
    assert by_row.agg(F.sum("n_records")).first()[0] == 3000
    assert sorted(map(str, by_row.collect())) == sorted(map(str, by_rule.collect()))


def test_report_has_one_shape_at_every_size(skewed):
    fragments = report.report_fragments(skewed, rows_per_fragment=100)
    text = {}
    for f in sorted(fragments.collect(), key=lambda f: (f.email_id, f.zone_pos, f.fragment)):
        text[f.email_id] = text.get(f.email_id, "") + f.html
    whole = {}
    for f in sorted(report.report_fragments(skewed, rows_per_fragment=10_000).collect(), key=lambda f: (f.email_id, f.zone_pos)):
        whole[f.email_id] = whole.get(f.email_id, "") + f.html
    assert text == whole and sum(t.count("<tr><td>") for t in whole.values()) > 0
    assert sum(t.count("<tr>") - t.count("<thead>") for t in whole.values()) == 3000
    docs = report.report_documents(fragments, "Hello").collect()
    parts = {}
    for d in docs:
        parts.setdefault(d.email_id, []).append(d)
    pieces = {(f.email_id, f.zone_pos, f.fragment) for f in fragments.collect()}
    assert {(d.email_id, d.zone_pos, d.fragment) for d in docs} == pieces and len(parts[0]) > 1
    for mail, found in parts.items():
        html = "".join(d.html for d in sorted(found, key=lambda d: (d.zone_pos, d.fragment)))
        assert html.count("<!DOCTYPE html>") == html.count("</html>") == 1
        assert html.replace("\n", "").endswith("</body></html>") and whole[mail] in html.replace("\n", "").replace(
            "<!DOCTYPE html><html><body><p>Hello</p>", "")


def test_report_raw_and_escaped(spark):
    row = [("r", "a", 0, {"name": "<b>"}, "AG", 1, "f")]
    df = spark.createDataFrame(row, "record_id string, attachment_id string, record_pos int, dynamic_data map<string,string>, region string, email_id int, filename string")
    assert "<td>&lt;b&gt;</td>" in report.report_fragments(df).first().html
    assert "<td><b></td>" in report.report_fragments(df, raw=True).first().html


def test_report_flow(spark, skewed):
    emails = spark.createDataFrame([(i, "ready_for_validation") for i in range(45)], "email_id int, status string")
    pick = skewed.where("email_id in (1, 2)").select("record_id")
    done = report_plan(skewed, emails, pick)
    assert {r.email_id for r in done.documents.collect()} == {1, 2}
    assert {r.email_id for r in done.emails.where("status = 'drafted'").collect()} == {1, 2}
    assert done.markers.agg(F.sum("n_records")).first()[0] == pick.count()
    everything = report_plan(skewed, emails, pick.where("false"))
    assert everything.markers.agg(F.sum("n_records")).first()[0] == 3000


def test_semi_plus_anti_is_all(skewed):
    ids = skewed.where("region = 'AG'").select("record_id")
    kept, rest = joins.selected(skewed, ids), merge.delete_rows(skewed, ids)
    assert kept.count() + rest.count() == 3000
    assert merge.delete_rows(rest, ids).count() == rest.count()
    assert select.is_in(skewed, "record_id", [f"r{i:05d}" for i in range(1500)]).count() == 1500


def test_nesting_round_trip(spark):
    parents = spark.createDataFrame([(i,) for i in range(4)], "email_id int")
    children = spark.createDataFrame([(i % 3, i, f"a{i}") for i in range(50)], "email_id int, part_index int, attachment_id string")
    nested = joins.nest_children(parents, children, "email_id", "part_index", ["attachment_id"], "attachments", 10)
    rows = nested.collect()
    assert max(len(r.attachments) for r in rows) <= 10 and [len(r.attachments) for r in rows if r.email_id == 3] == [0]
    flat = joins.flatten_emails(nested).select("email_id", "part_index", "attachment_id")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, children.collect()))


def test_first_n_and_first_attachment(spark):
    rows = [(1, i, f"a{i}", None) for i in range(7)] + [(2, 3, "b3", None), (2, 1, "b1", None)]
    df = spark.createDataFrame(rows, "email_id int, part_index int, attachment_id string, created_at timestamp")
    assert ranking.first_n_attachments(df, 5).count() == 7 and ranking.first_n_attachments(df).count() == 9
    assert {r.email_id: r.attachment_id for r in ranking.first_attachment(df).collect()} == {1: "a0", 2: "b1"}


def test_latest_message(spark):
    df = spark.createDataFrame([(1, "Ann", "Open LIST"), (2, "Ann", "list 2"), (3, "Bob", "list 3")], "uid int, sender string, subject string")
    assert ranking.latest_message(df, "uid", "ann", "LIST").first().uid == 2
    assert ranking.latest_message(df, "uid", "nobody").count() == 0


def random_edits(rng, n):
    out = []
    for seq in range(n):
        op = rng.choice(["replace", "cell", "cell", "cell"])
        field = rng.choice(["a", "b", merge.REGION_FIELD]) if op == "cell" else None
        data = {rng.choice("abc"): str(seq)} if op == "replace" else None
        region = rng.choice([None, f"R{seq}"]) if op == "replace" else None
        out.append((f"r{0 if rng.random() < 0.5 else rng.randrange(6)}", seq, op, field, f"v{seq}" if op == "cell" else None, data, region))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_edits_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    edits = random_edits(rng, 60)
    state = {f"r{i}": ({"a": "0", "z": "9"}, "start") for i in range(5)}
    records = spark.createDataFrame([(k, m, r) for k, (m, r) in state.items()], "record_id string, dynamic_data map<string,string>, region string")
    for rid, _, op, field, value, data, region in edits:
        if rid not in state:
            continue
        m, r = state[rid]
        if op == "replace":
            m, r = data, region if region is not None else r
        elif field == merge.REGION_FIELD:
            r = value
        else:
            m = {**m, field: value}
        state[rid] = (m, r)
    feed = spark.createDataFrame(edits, "record_id string, seq long, op string, field string, value string, dynamic_data map<string,string>, region string")
    done = merge.apply_edits(records, feed)
    assert {r.record_id: (r.dynamic_data, r.region) for r in done.collect()} == state
    assert {r.record_id for r in merge.unmatched_edits(records, feed).collect()} <= {"r5"}


def test_merge_emails(spark):
    schema = "email_id string, message_id string, subject string, status string, created_at int"
    stored = spark.createDataFrame([("e1", "m1", "old", "drafted", 1), ("e0", None, "n", "drafted", 1)], schema)
    batch = spark.createDataFrame([(None, "m1", "new", "x", 2), (None, "m2", "second", "x", 4), (None, "m2", "first", "x", 3), (None, None, "free", "x", 5)], schema)
    once = merge.merge_emails(stored, batch, "created_at")
    got = {(r.message_id, r.subject, r.status, r.is_incoming) for r in once.collect()}
    assert got == {("m1", "old", "extracting", True), ("m2", "first", "extracting", True), (None, "free", "extracting", True), (None, "n", "drafted", False)}
    again = merge.merge_emails(once.drop("is_incoming"), batch.where("message_id is not null"), "created_at")
    assert {(r.email_id, r.message_id, r.subject) for r in again.collect()} == {(r.email_id, r.message_id, r.subject) for r in once.collect()}


def test_add_blank_rows(spark):
    records = spark.createDataFrame([], RECORDS)
    atts = spark.createDataFrame([("a2", 1, 2, None), ("a1", 1, 1, None)], "attachment_id string, email_id int, part_index int, created_at timestamp")
    asked = spark.createDataFrame([(1, 1), (1, 2), (9, 1)], "email_id int, seq int")
    grown = merge.add_blank_rows(records, asked, atts).collect()
    assert [(r.attachment_id, r.dynamic_data, r.region, r.is_validated) for r in grown] == [("a1", {}, "", False)] * 2
    assert len({r.record_id for r in grown}) == 2
    assert [r.email_id for r in merge.unmatched_requests(asked, atts).collect()] == [9]


def test_selection_state(spark):
    df = spark.createDataFrame([("a",), ("b",)], "record_id string")
    state = lambda ids: tuple(merge.selection_state(df, ids).first())
    assert state(df) == (True, True) and state(df.limit(1)) == (False, True) and state(df.where("false")) == (False, False)
    assert tuple(merge.selection_state(df.where("false"), df).first()) == (False, False)


def test_integrity(spark):
    now = "timestamp'2024-01-01'"
    mails = spark.sql(f"select * from values ('e1','m',null,'s',{now},'odd',{now}),('e2','m','x','s',{now},'drafted',{now}),('e3',null,'x','s',{now},'drafted',{now}) t(email_id,message_id,subject,sender,date_received,status,created_at)")
    atts = spark.sql("select 'a1' attachment_id, 'gone' email_id, 'f' filename, 'done' status")
    recs = spark.sql("select 'a1' attachment_id, map('a','b') dynamic_data union all select 'zz', map('a','b')")
    found = {r.check_name: r.violations for r in merge.integrity_report(mails, atts, recs).where("violations > 0").collect()}
    assert found == {"emails.message_id repeated": 1, "attachments without email": 1, "records without attachment": 1,
                     "emails.status unknown": 1, "emails.subject missing": 1}


def test_normalise_flow(spark, skewed):
    atts = skewed.select("attachment_id", "email_id").distinct()
    mails = spark.createDataFrame([(i, "extracting") for i in range(45)], "email_id int, status string")
    done = normalise(skewed.drop("email_id"), atts, mails)
    assert done.records.count() == 3000 and {r.status for r in done.emails.collect()} == {"ready_for_validation"}
    counted = counts.normalisation_counts(skewed, done.supersets).agg(F.sum("record_count")).first()[0]
    assert counted == 3000


def test_order_and_limit(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r.x for r in select.order(df, "x").collect()] == [1, 3, None]
    assert [r.x for r in select.order(df, "x", desc=True).collect()] == [None, 3, 1]
    assert select.limit(df, 0).count() == 3 and select.limit(df, 2).count() == 2 and select.single(df).count() == 1
    names = spark.createDataFrame([("b", "1", 0, "r1"), ("C", "2", 0, "r2"), ("", "a", 0, "r3")], "filename string, attachment_id string, record_pos int, record_id string")
    assert [r.record_id for r in select.by_source(names).collect()] == ["r2", "r3", "r1"]
    assert [r.record_id for r in select.by_source(names, "UNICODE").collect()] == ["r3", "r1", "r2"]
    assert select.where_all(df, []).count() == 3 and df.where(select.eq("x", None)).count() == 0


def test_status_helpers(spark):
    rows = [("j", 1, "attachment_saved", "a"), ("j", 2, "extraction_started", "a"), ("j", 3, "phase1_complete", None),
            ("j", 4, "extraction_done", "a"), ("k", 5, "extraction_error", "b")]
    df = spark.createDataFrame(rows, "job_id string, seq long, type string, attachment_id string")
    assert {r.attachment_id: r.status for r in status.latest_status(df).collect()} == {"a": "done", "b": "error"}
    assert sorted(r.seq for r in status.up_to_terminal(df).collect()) == [1, 2, 3, 5]
    assert {r.job_id: r.finished for r in status.job_states(df).collect()} == {"j": True, "k": False}
    assert '{"type":"extraction_error","seq":5,"attachment_id":"b"}' in {r.payload for r in status.event_payload(df).collect()}
    assert '{"type":"phase1_complete","data":3}' in {r.payload for r in status.wrapped_payload(df, "seq").collect()}


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, None, {"a": "b"}), (2, "given", {})], "n int, id string, m map<string,string>")
    written = tables.append_rows(df, path, "id", ["n"], json_nested=True)
    tables.append_rows(df, path, "id", ["n"], json_nested=True)
    back = tables.read_table(spark, path, "id, m")
    assert back.count() == 4 and {r.id for r in back.collect()} == {r.id for r in written.collect()} and {r.m for r in back.collect()} == {'{"a":"b"}', "{}"}
    tables.create_views(spark)
    tables.create_views(spark, emails=spark.createDataFrame([], EMAILS), attachments=spark.createDataFrame([], ATTACHMENTS))
    assert spark.table("records_full").count() == 0 and set(TABLES) <= {t.name for t in spark.catalog.listTables()}
    assert tables.read_table(spark, "emails").columns[0] == "email_id"


def test_write_report(spark, skewed, tmp_path):
    docs = report.report_documents(report.report_fragments(skewed, rows_per_fragment=100))
    tables.write_report(docs, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == docs.count()


def test_inbox(spark):
    mails = spark.sql("select * from values (1, timestamp'2024-01-02 10:05:00', 's', 'x', 'drafted'), (2, timestamp'2024-01-03 00:00:00', 's', 'y', 'fetching') t(email_id, date_received, sender, subject, status)")
    atts = spark.createDataFrame([("a1", 1, 1, "f", "pending"), ("a0", 1, 0, "f", "done"), ("b", 2, 0, "f", "error")], "attachment_id string, email_id int, part_index int, filename string, status string")
    latest = spark.createDataFrame([("a1", "extracting"), ("zz", "done")], "attachment_id string, status string")
    rows = views.inbox(mails, atts, latest).orderBy("list_pos").collect()
    assert [(r.attachment_id, r.status, r.can_preview, r.show_action) for r in rows] == [
        ("b", "error", False, False), ("a0", "done", True, True), ("a1", "extracting", True, False)]
    assert (rows[1].date, rows[1].time) == ("02 Jan 2024", "10:05")

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.operators import replies
from quayside.plans.diagnostics import retry_failed
from quayside.plans.extract import answered, extract

# reply -> (strategy, records) with all means, and number of records in first mode
REPLIES = {
    '```json\n[{"a":"1"}]\n```': ("outermost", 1, 1),
    'text [{"a":"1"}] text': ("outermost", 1, 1),
    '[{"a":"1"}] text [{"b":"2"}]': ("merged", 2, 1),
    '[x] then [{"b":"2"}]': ("merged", 1, 0),
    '[{"a":"1"},{"b":"2"': ("closed", 2, 0),
    '[{"a":"1"},{"b":"2"}': ("closed", 2, 0),
    '[{"a":"1"},{"b":"2': ("none", 0, 0),
    "no data": ("none", 0, 0), "[]": ("outermost", 0, 0), "": ("none", 0, 0), "[": ("none", 0, 0),
    '{"a": 1}': ("none", 0, 0), "[[[[": ("none", 0, 0), "[" * 5000 + "]" * 5000: ("outermost", 1, 1), "[" * 50_000 + "]" * 50_000: ("none", 0, 0),
    '[{"a": "\\ud800"}]': ("outermost", 1, 1), "[NaN]": ("outermost", 1, 1),
}


def attempts(spark, rows):
    return spark.createDataFrame(rows, "attachment_id string, attempt int, content string, error string")


def test_reply_vectors(spark):
    df = spark.createDataFrame([(r,) for r in REPLIES], "r string").select(
        "r", replies.parse_reply("r").alias("p"), replies.parse_reply("r", "first").alias("f")
    )
    got = {row.r: (row.p.strategy, len(row.p.elements), len(row.f.elements)) for row in df.collect()}
    assert got == REPLIES


def test_null_reply_and_bad_mode(spark):
    assert spark.createDataFrame([(None,)], "r string").select(replies.parse_reply("r").alias("p")).first().p.elements == []
    with pytest.raises(ValueError):
        replies.parse_reply("r", "other")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=4), st.one_of(st.text(max_size=6), st.integers(), st.booleans(), st.none()), max_size=4), max_size=4),
       st.sampled_from(["", "so: ", "```json\n"]))
def test_recovery_round_trip(items, before):
    strategy, found = replies._recover(before + json.dumps(items), "all")
    assert strategy == "outermost" and found == items


def test_value_forms(spark):
    reply = json.dumps([{"Val": 1.50, "ok": True, "no": None, "n": {"x": 1}, "region": None, "L": [1, "a"]}, {"region": 5}, {"region": {"x": 1}}])
    resolved = spark.createDataFrame([("a", reply, None)], "attachment_id string, content string, last_error string")
    rows = replies.records_from_replies(replies.parsed_attempts(resolved)).orderBy("record_pos").collect()
    assert rows[0].dynamic_data == {"val": "1.5", "ok": "True", "no": "None", "n": "{'x': 1}", "l": "[1, 'a']"}
    assert [r.region for r in rows] == [None, "5", '{"x":1}'] and len({r.record_id for r in rows}) == 3


def test_attempts(spark):
    rows = [
        ("a", 1, None, "boom"), ("a", 2, "[]", None),
        ("b", 1, "[]", None),
        ("c", 1, None, "boom"), ("c", 2, '[{"a":1}]', None),
        ("d", 1, None, "x"), ("d", 2, None, "y"), ("d", 3, None, "z"), ("d", 4, '[{"a":1}]', None),
        ("e", 1, None, None),
        ("f", 1, None, ""), ("f", 2, "[]", None),
        ("g", 1, "[]", None), ("g", 2, None, "later"),
        ("h", 2, '[{"a":1}]', None),
        ("i", 0, '[{"a":1},{"a":2}]', None), ("j", 3, None, "bad"), ("j", 3, '[{"b":1}]', None), ("j", 3, '[{"a":1}]', None),
    ]
    parsed = replies.parsed_attempts(replies.resolve_attempts(attempts(spark, rows)))
    got = {r.attachment_id: (r.status, r.error_message, r.record_count) for r in parsed.collect()}
    assert got == {
        "a": ("error", "boom", 0), "b": ("done", None, 0), "c": ("done", None, 1), "d": ("done", None, 1),
        "e": ("done", None, 0), "f": ("done", None, 0), "g": ("done", None, 0), "h": ("done", None, 1),
        "i": ("done", None, 2), "j": ("done", None, 1),
    }
    strict = replies.parsed_attempts(replies.resolve_attempts(attempts(spark, rows), compat=False))
    assert {r.attachment_id: r.status for r in strict.collect()}["a"] == "done"


def test_bad_elements(spark):
    rows = [("a", 1, '[{"k":"1"}, 5, {"k":"2"}]', None)]
    pending = spark.createDataFrame([("a", "pending", None), ("z", "pending", None)], "attachment_id string, status string, error_message string")
    kept = extract(pending, attempts(spark, rows))
    assert [r.record_pos for r in kept.records.orderBy("record_pos").collect()] == [0, 2]
    assert [r.element for r in kept.rejects.collect()] == ["5"]
    assert {r.attachment_id: r.status for r in kept.attachments.collect()} == {"a": "done", "z": "pending"}
    stopped = extract(pending, attempts(spark, rows), on_bad="stop")
    assert [r.record_pos for r in stopped.records.collect()] == [0]
    assert {r.attachment_id: r.status for r in stopped.attachments.collect()}["a"] == "extracting"


def test_requests_and_hook(spark):
    mail = spark.createDataFrame([("a", "t" * 13_000), ("b", None)], "attachment_id string, raw_text string")
    made = answered(mail, lambda r: r.select("attachment_id", "chunk", F.lit(1).alias("attempt"), F.length("prompt").alias("n")), 12_000, "H", "T")
    assert {(r.attachment_id, r.chunk): r.n for r in made.collect()} == {("a", 0): 12_002, ("a", 1): 1_002, ("b", 0): 2}


def test_replies_by_chunk(spark):
    rows = [("a", 0, 1, '[{"k":"1"}]', None), ("a", 1, 1, None, "late"), ("a", 1, 2, '[{"k":"2"},{"k":"3"}]', None), ("b", 0, 1, '[{"k":"4"}]', None), ("b", 1, 1, None, "boom")]
    tries = spark.createDataFrame(rows, "attachment_id string, chunk int, attempt int, content string, error string")
    pending = spark.createDataFrame([("a", "pending", None), ("b", "pending", None)], "attachment_id string, status string, error_message string")
    done = extract(pending, tries)
    assert sorted((r.attachment_id, r.chunk, r.record_pos, r.dynamic_data["k"]) for r in done.records.collect()) == [
        ("a", 0, 0, "1"), ("a", 1, 0, "2"), ("a", 1, 1, "3"), ("b", 0, 0, "4")]
    assert len({r.record_id for r in done.records.collect()}) == 4
    assert {r.attachment_id: (r.status, r.error_message) for r in done.attachments.collect()} == {"a": ("done", None), "b": ("error", "boom")}


def test_retry(spark):
    att = spark.createDataFrame(
        [("a", "f1", "error", "x"), ("b", "f2", "error", "y"), ("c", "f3", "done", None)],
        "attachment_id string, filename string, status string, error_message string")
    rec = spark.createDataFrame([("r1", "a", {"k": "old"}), ("r2", "b", {"k": "old"}), ("r3", "c", {"k": "old"})],
                                "record_id string, attachment_id string, dynamic_data map<string,string>")
    tries = attempts(spark, [
        ("a", 1, "[]", None), ("a", 2, '[{"k":"new"}] and [{"k":"lost"}]', None), ("b", 1, None, "504"), ("c", 1, '[{"k":"no"}]', None),
    ])
    done = retry_failed(att, rec, tries)
    assert {r.attachment_id: (r.status, r.error_message) for r in done.attachments.collect()} == {
        "a": ("done", None), "b": ("error", "y"), "c": ("done", None)}
    first = sorted((r.attachment_id, r.dynamic_data["k"]) for r in done.records.collect())
    assert first == [("a", "new"), ("b", "old"), ("c", "old")]
    again = retry_failed(att, done.records, tries)
    assert sorted((r.record_id, r.dynamic_data["k"]) for r in again.records.collect()) == sorted(
        (r.record_id, r.dynamic_data["k"]) for r in done.records.collect())

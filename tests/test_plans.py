"""Shape of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from quayside.catalogue import registry as r
from quayside.config_tables import zone_rules
from quayside.operators import joins, merge, ranking, replies, select, status, superset, zones
from quayside.operators.counts import error_details
from quayside.catalogue.messages import document_messages
from quayside.plans.ingest import _chosen
from quayside.sources.messages import message_attachments, parse_messages
from tests.conftest import plan_of

SF = "/root/testdata/sf0.01"


def test_zone_by_dictionary_moves_no_rows(spark):
    plan = plan_of(zones.with_zone(r.table(spark, SF, "documents"), "text").select("doc_id", "zone"))
    assert "Exchange" not in plan and "Join" not in plan


def test_zone_rules_meet_distinct_texts_once(spark):
    lines = r.table(spark, SF, "lineitem").withColumnRenamed("l_returnflag", "region")
    plan = plan_of(zones.match_rules(lines, "region", zone_rules(spark)))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    texts = spark.createDataFrame([(1, "west of Singapore")], "a long, s string")
    held = plan_of(zones._holding(texts, zone_rules(spark).select(F.col("priority").alias("a"), F.col("keyword").alias("s"))))
    assert "NestedLoop" not in held and "Cartesian" not in held and "Join Inner" in held


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(r.table(spark, SF, "orders").where(select.eq("o_orderstatus", "O")).select("o_orderkey"))
    assert "EqualTo(o_orderstatus,O)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_text_stays_out_of_joins_that_do_not_need_it(spark):
    docs = r.document_attachments(spark, SF)
    events = r.table(spark, SF, "events").select(F.col("user_id").cast("string").alias("attachment_id"), F.col("event_id").alias("record_id"))
    for df in (joins.record_counts(docs, events), joins.live_over_stored(docs, docs.select("attachment_id", "status")).select("attachment_id", "status")):
        assert all("text" not in schema for schema in re.findall(r"ReadSchema: (.*)", plan_of(df)))
    assert "text" in plan_of(error_details(docs))


def test_first_n_limits_before_the_shuffle(spark):
    plan = plan_of(ranking.first_n_attachments(r.conversation_attachments(spark, SF), 5))
    assert re.search(r"WindowGroupLimit", plan) and "Partial" in plan


def test_superset_counts_before_the_shuffle(spark):
    plan = plan_of(superset.key_superset(r.event_records(spark, SF), ["email_id"]))
    below = plan.split("\n\n")[0].split("Exchange")[-1]
    assert "HashAggregate" in below and "Generate" in below


def test_attachment_text_is_not_shuffled(spark):
    plan = plan_of(message_attachments(parse_messages(document_messages(spark, SF)), 5))
    assert "Exchange" not in plan and "Sort" not in plan and "MapInPandas" in plan


def test_status_feed_is_hashed(spark):
    feed = r.status_feed(r.table(spark, SF, "events"))
    tree = plan_of(status.latest_status(feed, r.FEED_STATUS)).split("\n\n")[0]
    assert "SortAggregate" not in tree and tree.count("HashAggregate") == 2


def test_headers_are_decoded_once(spark):
    plan = plan_of(_chosen(document_messages(spark, SF), "src1", "liste"))
    assert plan.split("\n\n")[0].count("ArrowEvalPython") == 1


def test_reply_is_parsed_once(spark):
    resolved = r.table(spark, SF, "documents").select(F.col("doc_id").alias("attachment_id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("last_error"))
    plan = plan_of(replies.records_from_replies(replies.parsed_attempts(resolved), ["strategy"]))
    assert plan.split("\n\n")[0].count("ArrowEvalPython") == 1
    assert len(set(re.findall(r"parse\([^)]*\)#\d+", plan))) == 1


@pytest.fixture
def small_skew_limits(spark):
    """Adaptive limits low enough for the hot key of a test table to count as skewed."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key in conf:
        spark.conf.unset(key)


def test_hot_keys_of_joins_are_split(spark, small_skew_limits):
    """A third of the line items sits under one e-mail; its share of the join is spread out."""
    lines = r.table(spark, SF, "lineitem").select(
        F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(F.col("l_suppkey")).alias("email_id"),
        F.create_map(F.col("l_returnflag"), F.col("l_linestatus")).alias("dynamic_data"), F.col("l_orderkey").alias("record_id"),
        F.col("l_orderkey").alias("attachment_id"), F.lit("f").alias("filename"), F.lit("r").alias("region"), F.lit(0).alias("record_pos"),
    ).repartition(8).cache()
    emails = r.table(spark, SF, "supplier").select(F.col("s_suppkey").alias("email_id"), "s_name")
    feed = lines.select(F.col("email_id").alias("job_id"), F.col("record_id").alias("seq"), F.lit("x").alias("type"))
    hot_files = lines.withColumn("attachment_id", F.col("email_id"))
    for df in (
        superset.backfill_records(lines, superset.key_superset(lines, ["email_id"]), ["email_id"]),
        status.up_to_terminal(feed, ["x"]),
        ranking.with_group_break(hot_files, ["email_id"], "attachment_id", "record_id"),
        merge.delete_rows(lines, emails.where("email_id > 5"), "email_id"),
        lines.join(emails, "email_id"),
    ):
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()

"""Row numbers by boundary carry: against a window, over every way of cutting groups into partitions, and their plans."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.catalogue import registry as r
from quayside.catalogue.report import line_report_records
from quayside.operators import joins, report
from quayside.operators.numbering import number_rows, place_in_run
from tests.conftest import plan_of

SF = "/root/testdata/sf0.01"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def by_window(df, by, order):
    return df.withColumn("want", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


@pytest.mark.parametrize("groups,rows", [(1, 5000), (2, 5000), (40, 5000), (4000, 5000), (3, 7)])
def test_numbers_equal_a_window_for_few_and_many_groups(spark, groups, rows):
    rng = random.Random(groups)
    names = [None, float("nan"), -0.0, 0.0] + [float(i) for i in range(4, groups)]
    data = [(rng.choice(names[:groups]), None if rng.random() < 0.5 else "k", i) for i in range(rows)]
    df = by_window(spark.createDataFrame(data, "g double, h string, i long").repartition(7), ["g", "h"], ["i"])
    got = number_rows(df, ["g", "h"], [F.col("i")], "n")
    assert got.count() == rows and got.where("n <> want").isEmpty()


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", None]), max_size=5), min_size=1, max_size=6))
def test_places_within_partitions_are_carried_over_batches(spark, parts):
    """One partition whose batches cut its runs anywhere."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    values = [v for p in parts for v in p]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string").coalesce(1)
    got = {x.i: (x.place, x.edge) for x in place_in_run(df, ["v"], "place", "edge").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    place = 0
    for i, v in enumerate(values):
        place = place + 1 if i and values[i - 1] == v else 1
        assert got[i] == (place, i in (0, len(values) - 1))


def test_a_group_over_many_partitions_and_an_empty_table(spark):
    df = spark.range(0, 3000, 1, 11).withColumn("g", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")))
    got = number_rows(by_window(df, ["g"], ["id"]), ["g"], [F.col("id")], "n")
    assert got.where("n <> want").isEmpty() and got.count() == 3000
    assert number_rows(df.where("false"), ["g"], [F.col("id")]).count() == 0
    assert [x.n for x in number_rows(df, [], [F.col("id")], "n").orderBy("id").collect()] == list(range(1, 3001))


def test_numbered_rows_meet_no_table_of_groups(spark, no_broadcast):
    lines = r.table(spark, SF, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    tree = plan_of(number_rows(lines, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")])).split("\n\n")[0]
    assert "SortMergeJoin" not in tree and "ShuffledHashJoin" not in tree and "BroadcastHashJoin" in tree


def test_report_rows_cross_the_network_once_after_their_sort(spark, no_broadcast):
    tree = plan_of(report.report_fragments(line_report_records(spark, SF))).split("\n\n")[0]
    # The second join is that of the fragments' totals, a row per fragment.
    assert tree.count("SortMergeJoin") == 2
    rows_side = tree[tree.index("SortMergeJoin"):].split("BroadcastHashJoin")[0]
    assert rows_side.count("Exchange") == 1 and "Exchange" not in tree[:tree.index("SortMergeJoin")]


def test_children_of_small_parents_are_not_sorted_globally(spark):
    children = r.conversation_attachments(spark, SF)
    parents = children.select("email_id").distinct()
    nested = joins.nest_children(parents, children, "email_id", "part_index", ["attachment_id", "filename"], "c")
    assert "rangepartitioning" not in plan_of(nested)
    split = joins.nest_children(parents, children, "email_id", "part_index", ["attachment_id", "filename"], "c", per_row=3)
    flat = nested.select("email_id", F.explode("c").alias("c")).collect()
    assert sorted(map(str, flat)) == sorted(map(str, split.select("email_id", F.explode("c").alias("c")).collect()))
    assert split.agg(F.max(F.size("c"))).first()[0] == 3


def test_chunks_of_gathered_parents_need_no_global_sort(spark, monkeypatch):
    """Two children a row: parents of a few children are cut where they are gathered, and equal those ranked by the sort."""
    parents = spark.range(6).withColumnRenamed("id", "p")
    rows = [(i % 5, None if i % 7 == 0 else i % 4, f"r{i}" if i % 9 else None, {"k": str(i)}) for i in range(61)] + [(None, 1, "x", {})]
    children = spark.createDataFrame(rows, "p long, at int, r string, m map<string,string>").repartition(3)

    def nest(most):
        monkeypatch.setattr(joins, "GATHERED", most)
        return joins.nest_children(parents, children, "p", "at", ["r", "m"], "c", per_row=2)

    cut = nest(1000)
    assert "rangepartitioning" not in plan_of(cut)
    rows = sorted((q.p, q.chunk, str(q.c)) for q in cut.collect())
    assert [r[:2] for r in rows if r[0] == 5] == [(5, 0)] and len(rows) == 4 * 6 + 7 + 1
    assert rows == sorted((q.p, q.chunk, str(q.c)) for q in nest(2).collect())


def test_text_is_there_once_per_chunk_of_records(spark):
    attachments = spark.createDataFrame([("a", "f", "long text"), ("b", "g", None)], "attachment_id string, filename string, raw_text string")
    records = spark.createDataFrame(
        [("a", i % 5 if i % 5 else None, f"r{i}", {"k": str(i)}, None, False) for i in range(25)] + [(None, 1, "x", {}, None, False)],
        "attachment_id string, record_pos int, record_id string, dynamic_data map<string,string>, region string, is_validated boolean")
    for per_row, chunks in ((1000, 1), (10, 3)):
        rows = joins.attachment_documents(attachments, records, per_row).orderBy("attachment_id", "chunk").collect()
        assert [(x.attachment_id, x.chunk) for x in rows] == [("a", c) for c in range(chunks)] + [("b", 0)]
        ordered = [rec for x in rows[:-1] for rec in x.records]
        assert [rec.record_pos for rec in ordered] == sorted((rec.record_pos for rec in ordered), key=lambda p: (p is None, p or 0))
        assert all(rec.dynamic_data == {"k": rec.record_id[1:]} for rec in ordered) and len(ordered) == 25 and rows[-1].records == []

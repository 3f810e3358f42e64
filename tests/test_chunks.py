"""Supersets in chunks: a group of very many keys, null groups, stored nulls."""

from pyspark.sql import functions as F

from quayside.operators import superset

SCHEMA = "email_id long, record_id string, dynamic_data map<string,string>"


def test_chunks_equal_the_whole_superset(spark):
    rows = [(g, f"r{g}-{i}", {f"k{(i * 7 + j) % 23}": None if j == 2 else f"v{i}-{j}" for j in range(i % 5)}) for g in (1, 2, None) for i in range(40)]
    rows += [(9, "empty", {}), (9, "null", None)]
    records = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = {r.email_id: r.superset for r in superset.key_superset(records, ["email_id"], priority=["k3", "zz"]).collect()}
    chunks = superset.superset_chunks(records, ["email_id"], priority=["k3", "zz"], per_chunk=4)
    joined = {}
    for r in sorted(chunks.collect(), key=lambda r: r.chunk):
        assert 1 <= len(r["keys"]) <= 4
        joined.setdefault(r.email_id, []).extend(r["keys"])
    assert joined == {g: keys for g, keys in whole.items() if keys} and 9 in whole
    filled = {}
    for r in superset.backfill_chunks(records, chunks, ["email_id"]).collect():
        filled.setdefault(r.record_id, {}).update(zip(r["keys"], r["values"]))
    dense = superset.backfill_records(records, superset.key_superset(records, ["email_id"], priority=["k3", "zz"]), ["email_id"])
    assert filled == {r.record_id: r.dynamic_data for r in dense.collect() if r.dynamic_data}


def test_a_group_of_a_million_keys(spark):
    """Ten thousand records with a hundred keys of their own each, in one group: no value holds more than a chunk."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda j: F.concat_ws("_", F.lit("key"), F.col("id"), j))
    records = spark.range(10_000).select(F.lit(1).alias("email_id"), F.col("id").cast("string").alias("record_id"), F.map_from_arrays(keys, keys).alias("dynamic_data"))
    chunks = superset.superset_chunks(records, ["email_id"]).persist()
    told = chunks.agg(F.count("*").alias("n"), F.max(F.size("keys")).alias("most"), F.sum(F.size("keys")).alias("keys")).first()
    assert (told.n, told.most, told["keys"]) == (1000, 1000, 1_000_000)
    cells = superset.record_cells(records, chunks, ["email_id"])
    told = cells.agg(F.max(F.size("cells")).alias("most"), F.sum(F.size("cells")).alias("cells"), F.countDistinct("record_id").alias("records")).first()
    assert told.most <= 100 and (told["cells"], told.records) == (1_000_000, 10_000)
    some = records.where("record_id = '77'")
    row = superset.backfill_chunks(some, chunks, ["email_id"]).agg(F.count("*").alias("n"), F.max(F.size("values")).alias("most"), F.sum(F.size(F.filter("values", lambda v: v != ""))).alias("own")).first()
    assert (row.n, row.most, row.own) == (1000, 1000, 100)
    chunks.unpersist()

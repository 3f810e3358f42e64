"""Schemaless maps."""

from pyspark.sql import functions as F

from quayside.catalogue.registry import EVENT_CELLS_SQL, EVENT_PRIORITY, event_records, map_text, money, query, table
from quayside.functions import maps
from quayside.functions.text import or_dash
from quayside.operators import superset
from quayside.operators.select import grid_columns
from quayside.plans.normalise import normalise

_KEYS_SQL = """
    SELECT DISTINCT user_id, unnest([event_type, 'k']) AS key FROM events"""
_RANK_SQL = "CASE key WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END"


@query(f"SELECT user_id AS email_id, string_agg(key, ',' ORDER BY {_RANK_SQL}, key) AS superset FROM ({_KEYS_SQL}) GROUP BY user_id")
def key_superset(spark, sf):
    keys = superset.key_superset(event_records(spark, sf), ["email_id"], priority=EVENT_PRIORITY)
    return keys.select("email_id", F.array_join("superset", ",").alias("superset"))


@query(f"SELECT user_id AS email_id, key, row_number() OVER (PARTITION BY user_id ORDER BY {_RANK_SQL}, key) AS key_pos FROM ({_KEYS_SQL})")
def superset_rows(spark, sf):
    return superset.superset_rows(event_records(spark, sf), ["email_id"], priority=EVENT_PRIORITY)


@query(f"""
    SELECT user_id AS email_id, string_agg(key || ':' || upper(key), ',' ORDER BY {_RANK_SQL}, key) AS columns
    FROM ({_KEYS_SQL}) WHERE key <> 'region' GROUP BY user_id""")
def superset_columns(spark, sf):
    keys = superset.key_superset(event_records(spark, sf), ["email_id"], priority=EVENT_PRIORITY)
    shown = F.transform(grid_columns("superset"), lambda c: F.concat_ws(":", c["key"], c["header"]))
    return keys.select("email_id", F.array_join(shown, ",").alias("columns"))


@query("""
    SELECT user_id AS email_id, string_agg(key, ',' ORDER BY event_id, pos) AS columns FROM (
        SELECT user_id, key, event_id, pos, row_number() OVER (PARTITION BY user_id, key ORDER BY event_id, pos) AS rn
        FROM (SELECT user_id, event_id, unnest([event_type, 'k']) AS key, unnest([0, 1]) AS pos FROM events))
    WHERE rn = 1 GROUP BY user_id""")
def preview_keys(spark, sf):
    keys = superset.preview_keys(event_records(spark, sf), ["email_id"], "record_pos")
    return keys.select("email_id", F.array_join("columns", ",").alias("columns"))


_BACKFILL_SQL = f"""
    WITH keys AS ({_KEYS_SQL}), cells AS ({EVENT_CELLS_SQL})
    SELECT CAST(c.event_id AS VARCHAR) AS record_id, keys.key,
           CASE WHEN keys.key = c.event_type THEN val WHEN keys.key = 'k' THEN c.k ELSE '' END AS value
    FROM cells c JOIN keys USING (user_id)"""


@query(_BACKFILL_SQL)
def backfill_long(spark, sf):
    records = event_records(spark, sf)
    supersets = superset.key_superset(records, ["email_id"], priority=EVENT_PRIORITY)
    filled = superset.backfill_records(records, supersets, ["email_id"])
    return filled.select("record_id", F.explode_outer("dynamic_data").alias("key", "value"))


@query(f"""
    SELECT email_id, chunk, string_agg(key, ',' ORDER BY key_pos) AS keys FROM (
        SELECT user_id AS email_id, key, row_number() OVER w AS key_pos, CAST((row_number() OVER w - 1) // 2 AS BIGINT) AS chunk FROM ({_KEYS_SQL})
        WINDOW w AS (PARTITION BY user_id ORDER BY {_RANK_SQL}, key))
    GROUP BY email_id, chunk""")
def superset_chunks(spark, sf):
    chunks = superset.superset_chunks(event_records(spark, sf), ["email_id"], priority=EVENT_PRIORITY, per_chunk=2)
    return chunks.select("email_id", "chunk", F.array_join("keys", ",").alias("keys"))


@query(_BACKFILL_SQL)
def backfill_chunks(spark, sf):
    """The same cells, two keys of a group a row."""
    records = event_records(spark, sf)
    chunks = superset.superset_chunks(records, ["email_id"], priority=EVENT_PRIORITY, per_chunk=2)
    filled = superset.backfill_chunks(records, chunks, ["email_id"])
    cell = F.explode(F.arrays_zip("keys", "values")).alias("c")
    return filled.select("record_id", cell).select("record_id", F.col("c")["keys"].alias("key"), F.col("c")["values"].alias("value"))


@query(_BACKFILL_SQL)
def normalise_flow(spark, sf):
    """The whole flow; attachments come from the events themselves."""
    records = event_records(spark, sf)
    attachments = records.select("attachment_id", "email_id").distinct()
    emails = records.select("email_id").distinct().withColumn("status", F.lit("extracting"))
    done = normalise(records.drop("email_id"), attachments, emails, EVENT_PRIORITY)
    return done.records.select("record_id", F.explode_outer("dynamic_data").alias("key", "value"))


@query("""
    SELECT p_partkey, 'brand=' || p_brand || ';part_name=' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END
           || ';part_size=' || p_size AS cells FROM part""")
def normalise_keys(spark, sf):
    raw = F.map_concat(
        F.create_map(F.lit("Part Name"), F.col("p_name"), F.lit("BRAND"), F.col("p_brand"), F.lit("Part Size"), F.col("p_size").cast("string")),
        F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("part name"), F.col("p_type"))).otherwise(
            F.from_json(F.lit("{}"), "map<string,string>")),
    )
    parts = table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    return parts.select("p_partkey", map_text(maps.normalise_keys("raw")).alias("cells"))


@query("""
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type END AS region,
           CASE WHEN p_size % 2 = 0 THEN 'brand=' || p_brand ELSE 'brand=' || p_brand || ';region=' || p_type END AS cells
    FROM part""")
def split_region(spark, sf):
    name = F.when(F.col("p_size") % 2 == 0, "region").otherwise("Region")
    parts = table(spark, sf, "part").select("p_partkey", F.create_map(name, F.col("p_type"), F.lit("brand"), F.col("p_brand")).alias("raw"))
    region, rest = maps.split_region("raw")
    split = parts.select("p_partkey", region.alias("region"), rest.alias("rest"))
    return split.select("p_partkey", "region", map_text(maps.normalise_keys("rest")).alias("cells"))


@query("""
    SELECT p_partkey,
           CASE WHEN p_size % 4 = 0 THEN 'no. ' || p_size ELSE CAST(p_size AS VARCHAR) END AS dwt,
           CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS coating,
           CASE WHEN p_size % 3 = 0 THEN '—' ELSE p_brand END AS shown
    FROM part""")
def alias_cells(spark, sf):
    size = F.col("p_size").cast("string")
    dwt = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" no. "), size, F.lit("\n"))).otherwise(F.lit(" Unknown "))
    raw = F.create_map(
        F.lit("dwt"), dwt, F.lit("sdwt"), F.concat(F.lit(" "), size, F.lit(" ")),
        F.lit("coating"), F.when(F.col("p_size") % 3 == 0, F.lit("N/A")).when(F.col("p_size") % 3 == 1, F.lit(None)).otherwise(F.col("p_brand")),
        F.lit("tank_coating"), F.when(F.col("p_size") % 3 == 0, F.lit(" - ")).otherwise(F.col("p_brand")),
    )
    parts = table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    coating = maps.alias_cell("raw", ["coating", "tank_type", "tank_coating"])
    return parts.select(
        "p_partkey", maps.alias_cell("raw", ["dwt", "sdwt"]).alias("dwt"), coating.alias("coating"), or_dash(coating).alias("shown")
    )


@query("""
    SELECT o_orderkey, 'priority=' || o_orderpriority || ';status=' || CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS cells
    FROM orders""")
def cell_edits(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")).alias("m")
    )
    edited = F.when(F.col("o_orderstatus") == "O", maps.set_cell("m", F.lit("status"), F.lit("open"))).otherwise(F.col("m"))
    return orders.select("o_orderkey", map_text(edited).alias("cells"))


@query("SELECT event_id, COALESCE(CASE WHEN event_type = 'view' THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END, '') AS view FROM events")
def map_default(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.create_map("event_type", money("value")).alias("m"))
    return events.select("event_id", maps.value_or("m", "view").alias("view"))

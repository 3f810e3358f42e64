"""Query registry and the stand-ins that give the provided tables the engine's shapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.config_tables import UNSPECIFIED, ZONE_RULES, ZONES
from quayside.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(prepare(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- zones in SQL -----------------------------------------------------------------------------

RULES_SQL = "(VALUES " + ", ".join(f"({p}, '{k}', '{z}')" for p, k, z in ZONE_RULES) + ") AS rules(priority, keyword, zone)"
ZONES_SQL = "(VALUES " + ", ".join(
    f"('{n}', {i}, CAST({lat} AS DOUBLE), CAST({lng} AS DOUBLE))" for i, (n, lat, lng) in enumerate(ZONES)
) + ") AS zones(zone, zone_pos, lat, lng)"


def zone_map_sql(places: str) -> str:
    """CTE body (text, zone) for a relation with a column ``text``."""
    return f"""
        SELECT p.text, COALESCE(arg_min(r.zone, r.priority), '{UNSPECIFIED}') AS zone
        FROM (SELECT DISTINCT text FROM {places}) p
        LEFT JOIN {RULES_SQL.replace('AS rules', 'AS r')}
          ON p.text IS NOT NULL AND p.text <> ''
         AND (contains(lower(trim(p.text)), r.keyword) OR contains(r.keyword, lower(trim(p.text))))
        GROUP BY p.text"""


# --- free-text places -------------------------------------------------------------------------

PLACE_TEXTS = [
    "", " ", "SINGAPORE", "Port Klang", "UNSPECIFIED", "AG", "US", "EAST", "PORT", "LAGOS", "Copenhagen", "ROMANIA",
    "FUKUOKA", "MIDDLE EAST", " open CHENNAI ", "Sydney / Melbourne", "Durban",
]
PLACES_SQL = "[" + ", ".join(f"'{t}'" for t in PLACE_TEXTS) + "]"


def place_text(number: Column, fallback: Column) -> Column:
    """A place by row number; every so often the table's own region name, or null."""
    n = len(PLACE_TEXTS)
    slot = (number % (n + 2)).cast("int")
    listed = F.get(F.array(*[F.lit(t) for t in PLACE_TEXTS]), slot)
    return F.when(slot < n, listed).when(slot == n, fallback)


def place_text_sql(number: str, fallback: str) -> str:
    n = len(PLACE_TEXTS)
    slot = f"({number} % {n + 2})"
    return f"CASE WHEN {slot} < {n} THEN {PLACES_SQL}[{slot} + 1] WHEN {slot} = {n} THEN {fallback} END"


def supplier_places(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        table(spark, sf, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "s_name", "s_nationkey", "r_name",
                place_text(F.col("s_suppkey"), F.col("r_name")).alias("region"))
    )


SUPPLIER_PLACES_SQL = f"""
    SELECT s_suppkey, s_name, s_nationkey, r_name, {place_text_sql('s_suppkey', 'r_name')} AS region
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


# --- conversations as e-mails with attachments --------------------------------------------------

def conversation_attachments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("attachment_id"), F.col("conv_id").alias("email_id"),
        F.col("turn").alias("part_index"), F.concat("role", F.lit("_"), "turn", F.lit(".EML")).alias("filename"),
        F.col("text").alias("raw_text"), F.when(F.col("role") == "user", "pending").otherwise("done").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )


# --- documents and labels as attachments with a status -------------------------------------------

def document_attachments(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 0, "error").when(F.col("quality") == 1, "done").otherwise("pending")
    return docs.select(
        F.col("doc_id").cast("string").alias("attachment_id"), F.col("source").alias("email_id"),
        F.col("doc_id").alias("part_index"), F.concat("source", F.lit("_"), "doc_id", F.lit(".eml")).alias("filename"),
        F.col("text").alias("raw_text"), status.alias("status"),
        F.when(status == "error", F.concat(F.lit("quality "), F.col("quality"))).alias("error_message"),
    )


DOCUMENT_ATTACHMENTS_SQL = """
    SELECT CAST(d.doc_id AS VARCHAR) AS attachment_id, source AS email_id, d.doc_id AS part_index,
           source || '_' || d.doc_id || '.eml' AS filename, text AS raw_text,
           CASE WHEN quality = 0 THEN 'error' WHEN quality = 1 THEN 'done' ELSE 'pending' END AS status,
           CASE WHEN quality = 0 THEN 'quality ' || quality END AS error_message
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


# --- events as records with ragged maps ------------------------------------------------------------

EVENT_PRIORITY = ["view", "purchase"]


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)").cast("string")


def event_records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("record_id"), F.col("event_id").alias("record_pos"),
        F.col("user_id").alias("email_id"),
        F.concat_ws("-", "user_id", "event_type").alias("attachment_id"),
        F.create_map("event_type", money("value"), F.lit("k"), F.regexp_extract("props", r"(\d+)", 1)).alias("dynamic_data"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("region"),
    )


EVENT_CELLS_SQL = """
    SELECT event_id, user_id, event_type, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS val,
           regexp_extract(props, '([0-9]+)', 1) AS k
    FROM events"""


# --- events as a status feed -------------------------------------------------------------------------

# The feed's own words for the four attachment states.
FEED_STATUS = {"signup": "pending", "view": "extracting", "click": "done", "purchase": "done", "error": "error"}
FEED_TERMINAL = ["purchase", "error"]


def status_feed(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % 10).alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("type"), F.col("user_id").alias("attachment_id"),
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("record_count"),
    )


FEED_SQL = """
    SELECT user_id % 10 AS job_id, event_id AS seq, event_type AS type, user_id AS attachment_id,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS record_count
    FROM events"""
FEED_STATUS_SQL = (
    "CASE type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'extracting' "
    "WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' END"
)


# --- customers, orders and line items as e-mails, attachments and records -----------------------------

def customer_emails(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("email_id"), F.col("c_name").alias("subject"), F.col("c_mktsegment").alias("sender"),
        F.when(F.col("c_acctbal") < 0, "fetching").otherwise("drafted").alias("status"),
        F.concat(F.lit("<"), "c_custkey", F.lit("@mail>")).alias("message_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey") * 60).alias("date_received"),
    )


CUSTOMER_EMAILS_SQL = """
    SELECT c_custkey AS email_id, c_name AS subject, c_mktsegment AS sender,
           CASE WHEN c_acctbal < 0 THEN 'fetching' ELSE 'drafted' END AS status,
           '<' || c_custkey || '@mail>' AS message_id,
           make_timestamp((1700000000 + c_custkey * 60) * 1000000) AS date_received
    FROM customer"""


def order_attachments(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "error").otherwise("pending")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("attachment_id"), F.col("o_custkey").alias("email_id"),
        F.col("o_orderkey").alias("part_index"), F.col("o_orderpriority").alias("filename"), status.alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


ORDER_ATTACHMENTS_SQL = """
    SELECT o_orderkey AS attachment_id, o_custkey AS email_id, o_orderkey AS part_index, o_orderpriority AS filename,
           CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'error' ELSE 'pending' END AS status,
           o_orderdate AS created_at
    FROM orders"""

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def line_records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", *LINE_KEY).alias("record_id"), F.col("l_orderkey").alias("attachment_id"),
        F.col("l_linenumber").alias("record_pos"),
        F.create_map(F.lit("part"), F.col("l_partkey").cast("string"), F.lit("flag"), F.col("l_returnflag")).alias("dynamic_data"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("region"), (F.col("l_linestatus") == "F").alias("is_validated"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


LINE_RECORDS_SQL = """
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record_id, l_orderkey AS attachment_id,
           l_linenumber AS record_pos, CAST(l_partkey AS VARCHAR) AS part, l_returnflag AS flag,
           NULLIF(l_returnflag, 'N') AS region, l_linestatus = 'F' AS is_validated, l_shipdate AS created_at
    FROM lineitem"""


def text_time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def map_text(m: Column | str) -> Column:
    """Map as sorted ``key=value`` text, for comparison."""
    entries = F.map_entries(m)
    return F.array_join(F.array_sort(F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("<null>")))
    )), ";")

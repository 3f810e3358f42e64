"""Text and date functions on whole texts."""

from pyspark.sql import functions as F

from quayside.catalogue.registry import query, table, text_time
from quayside.functions import dates, text
from quayside.sources.tables import with_ids

_WS = r"[ \t\n\r\f\x0B]"
HTML_TEXT_SQL = (
    "trim(regexp_replace(replace(replace(replace(replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), "
    "'&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '" + _WS + r"{{2,}}', ' ', 'g'), E' \t\n\r\f\x0B')"
)


@query(f"SELECT page_id, {HTML_TEXT_SQL.format(c='html')} AS text FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_to_text("html").alias("text"))


@query(r"""
    SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\S+')) AS n_words FROM pages""")
def html_word_count(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.word_count("html").cast("long").alias("n_words"))


@query("""
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'P' THEN 'now' ELSE strftime(
               o_orderdate - CASE WHEN o_orderstatus = 'O' THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END,
               '%Y-%m-%d %H:%M:%S') END AS received
    FROM orders""")
def rfc_date_parse(spark, sf):
    """Order dates written as mail headers: UTC, +0530, and a form that does not parse."""
    day = F.element_at(F.array(*[F.lit(d) for d in ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]]), F.dayofweek("o_orderdate"))
    zone = F.when(F.col("o_orderstatus") == "O", "+0530").when(F.col("o_orderstatus") == "P", "+0000 (UTC)").otherwise("+0000")
    header = F.concat(day, F.lit(", "), F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss"), F.lit(" "), zone)
    orders = table(spark, sf, "orders").select("o_orderkey", header.alias("header"))
    now = F.timestamp_seconds(F.lit(0))
    parsed = orders.select("o_orderkey", dates.received_at("header", now).alias("ts"))
    return parsed.select("o_orderkey", F.when(F.col("ts") == now, "now").otherwise(text_time("ts")).alias("received"))


@query("SELECT event_id, strftime(ts, '%d %b %Y') AS date, strftime(ts, '%H:%M') AS time FROM events")
def display_dates(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", dates.display_date("ts").alias("date"), dates.display_time("ts").alias("time")
    )


@query(r"""
    SELECT doc_id, trim(text, E' \t\n\r\f\x0B') AS stripped, length(text) - length(replace(text, 'e', '')) AS n_e,
           substring(text, 1, 500) AS head, greatest(length(text) - 500, 0) AS more, upper(replace(lang || '_' || source, '_', ' ')) AS label,
           regexp_replace(source || '.EML', '(?i)\.eml$', '') AS stem, replace(lower(source || ' X'), ' ', '_') AS key_form
    FROM documents""")
def text_functions(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id", text.strip("text").alias("stripped"), text.count_char("text", "e").alias("n_e"),
        text.prefix("text", 500).alias("head"), text.remainder_length("text", 500).alias("more"),
        text.header_label(F.concat_ws("_", "lang", "source")).alias("label"),
        text.file_stem(F.concat("source", F.lit(".EML"))).alias("stem"),
        text.key_form(F.concat("source", F.lit(" X"))).alias("key_form"),
    )


@query("""
    SELECT conv_id, turn, md5(text || chr(10) || chr(10) || role) AS joined, role = 'user' AS is_named
    FROM conversations""")
def joined_texts(spark, sf):
    conv = table(spark, sf, "conversations")
    parts = F.array("text", F.lit(""), "role", F.lit(""))
    name = F.concat("role", F.when(F.col("role") == "user", ".EML").otherwise(".txt"))
    return conv.select(
        "conv_id", "turn", F.md5(text.join_non_empty("\n\n", parts)).alias("joined"), text.is_message_name(name).alias("is_named")
    )


@query("""
    SELECT doc_id, md5(trim(text, E' \\t\\n\\r')) AS body FROM documents""")
def fence_strip(spark, sf):
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n```"))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.strip_fences(fenced)).alias("body"))


@query("""
    SELECT o_orderkey, sha256('=' || o_orderkey || chr(1) || '=' || o_orderpriority || chr(1) || '!') AS id FROM orders""")
def stable_ids(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.lit(None).cast("string").alias("none"))
    return with_ids(orders, "id", ["o_orderkey", "o_orderpriority", "none"]).select("o_orderkey", "id")

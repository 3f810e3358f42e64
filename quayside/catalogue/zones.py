"""Zone classification and counts."""

from pyspark.sql import functions as F

from quayside import config_tables
from quayside.catalogue.registry import (
    RULES_SQL,
    SUPPLIER_PLACES_SQL, ZONES_SQL, place_text, place_text_sql, query, supplier_places, table, zone_map_sql,
)
from quayside.operators import zones


def zone_report(spark, sf):
    return zones.in_zone_order(zones.zone_counts(zones.with_zone(supplier_places(spark, sf))))


@query(f"""
    WITH s AS ({SUPPLIER_PLACES_SQL}), z AS ({zone_map_sql('(SELECT region AS text FROM s)')}),
         g AS (SELECT COALESCE(z.zone, 'UNSPECIFIED') AS zone, COUNT(*) AS n_records
               FROM s LEFT JOIN z ON s.region = z.text GROUP BY ALL)
    SELECT g.zone, g.n_records, c.lat, c.lng, c.zone_pos
    FROM g JOIN {ZONES_SQL.replace('AS zones', 'AS c')} ON c.zone = g.zone""")
def zone_report_counts(spark, sf):
    return zone_report(spark, sf)


@query(f"""
    WITH s AS ({SUPPLIER_PLACES_SQL}), z AS ({zone_map_sql('(SELECT region AS text FROM s)')})
    SELECT s.s_nationkey AS email_id, COALESCE(z.zone, 'UNSPECIFIED') AS zone, COUNT(*) AS n_records,
           CAST(SUM(l_quantity) AS BIGINT) AS quantity
    FROM lineitem JOIN s ON l_suppkey = s_suppkey LEFT JOIN z ON s.region = z.text GROUP BY ALL""")
def zone_lineitems(spark, sf):
    """Line items per nation and zone. Quantities are summed per supplier before the join."""
    per_supplier = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")
    )
    placed = zones.with_zone(supplier_places(spark, sf))
    return per_supplier.join(placed, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.col("s_nationkey").alias("email_id"), "zone"
    ).agg(F.sum("n").alias("n_records"), F.sum("q").cast("long").alias("quantity"))


def _part_places(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", place_text(F.col("p_partkey"), F.concat("p_name", F.lit(" "), "p_type")).alias("region")
    )


_PART_PLACES_SQL = f"SELECT p_partkey, {place_text_sql('p_partkey', chr(39).join(['p_name || ', ' ', ' || p_type']))} AS region FROM part"
_PART_ZONES_SQL = f"""
    WITH s AS ({_PART_PLACES_SQL}), z AS ({zone_map_sql('(SELECT region AS text FROM s)')})
    SELECT p_partkey, region, COALESCE(z.zone, 'UNSPECIFIED') AS zone FROM s LEFT JOIN z ON s.region = z.text"""


@query(_PART_ZONES_SQL)
def zone_match_vectors(spark, sf):
    return zones.with_zone(_part_places(spark, sf))


@query(_PART_ZONES_SQL)
def zone_match_rules(spark, sf):
    return zones.match_rules(_part_places(spark, sf), "region", config_tables.zone_rules(spark))


@query(_PART_ZONES_SQL)
def zone_match_equality(spark, sf):
    """Rules that come as rows of any type of table, here joined to themselves under other priorities."""
    rules = config_tables.zone_rules(spark)
    later = rules.select((F.col("priority") + 1000).alias("priority"), "keyword", F.lit("LATER").alias("zone"))
    return zones.match_rules(_part_places(spark, sf), "region", rules.unionByName(later))


@query(f"""
    WITH z AS ({zone_map_sql('documents')})
    SELECT d.doc_id, d.lang, z.zone FROM documents d JOIN z ON d.text = z.text""")
def zone_match_texts(spark, sf):
    """Whole document texts against the rule table."""
    return zones.match_rules(table(spark, sf, "documents"), "text", config_tables.zone_rules(spark)).select("doc_id", "lang", "zone")


@query(f"""
    WITH z AS ({zone_map_sql('documents')})
    SELECT d.doc_id, d.lang, z.zone FROM documents d JOIN z ON d.text = z.text""")
def zone_match_documents(spark, sf):
    """Whole document texts as places."""
    return zones.with_zone(table(spark, sf, "documents"), "text").select("doc_id", "lang", "zone")


@query(f"""
    WITH s AS ({_PART_PLACES_SQL}),
    best AS (SELECT s.p_partkey, arg_max(r.zone, length(r.keyword) * 10000 - r.priority) AS zone
             FROM s JOIN {RULES_SQL.replace('AS rules', 'AS r')}
               ON regexp_matches(lower(trim(s.region)), '(^|[^a-z0-9_])' || regexp_escape(r.keyword) || '($|[^a-z0-9_])') GROUP BY 1)
    SELECT s.p_partkey, COALESCE(best.zone, 'UNSPECIFIED') AS zone FROM s LEFT JOIN best USING (p_partkey)""")
def zone_match_words(spark, sf):
    """Opt-in mode: whole words, longest keyword first."""
    return zones.with_zone(_part_places(spark, sf), mode="word").select("p_partkey", "zone")

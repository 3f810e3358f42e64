"""Zone reports."""

from pyspark.sql import functions as F

from quayside.catalogue.registry import SUPPLIER_PLACES_SQL, ZONES_SQL, query, supplier_places, table, zone_map_sql
from quayside.config_tables import DEFAULT_INTRO
from quayside.operators import report
from quayside.operators.zones import with_zone
from quayside.plans.report import report as report_plan
from quayside.session import shared_path
from quayside.sources.tables import write_report


def line_report_records(spark, sf):
    """Line items as records of their supplier's nation; places are classified before the join."""
    size = F.col("p_size").cast("string")
    data = F.create_map(
        F.lit("name"), F.col("p_name"), F.lit("dwt"), F.when(F.col("p_size") > 25, size).otherwise(F.lit(" - ")),
        F.lit("tank_type"), F.when(F.col("p_type") == "ECONOMY", F.lit("epoxy <1>")),
        F.lit("last_cargo"), F.when(F.col("l_returnflag") == "R", F.col("p_brand")).otherwise(F.lit("Unknown")),
    )
    return (
        table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(with_zone(supplier_places(spark, sf)), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_id"),
            F.col("s_nationkey").alias("email_id"), F.col("s_suppkey").alias("attachment_id"), F.col("s_name").alias("filename"),
            F.col("l_orderkey").alias("record_pos"), data.alias("dynamic_data"), "region", "zone",
        )
    )


_CELLS_SQL = f"""
    s AS ({SUPPLIER_PLACES_SQL}), z AS ({zone_map_sql('(SELECT region AS text FROM s)')}),
    cells AS (
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record_id, s_nationkey AS email_id,
               s_name, s_suppkey, l_orderkey, COALESCE(z.zone, 'UNSPECIFIED') AS zone, p_name AS vessel,
               CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '' END AS dwt,
               CASE WHEN p_type = 'ECONOMY' THEN 'epoxy &lt;1&gt;' ELSE '' END AS coating,
               CASE WHEN l_returnflag = 'R' THEN p_brand ELSE '' END AS cargo
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN s ON l_suppkey = s_suppkey LEFT JOIN z ON s.region = z.text),
    groups AS (
        SELECT email_id, zone, COUNT(*) AS n_records, bool_or(vessel <> '') AS a1, bool_or(dwt <> '') AS a2,
               bool_or(coating <> '') AS a3, bool_or(cargo <> '') AS a4 FROM cells GROUP BY ALL)"""


@query(f"""
    WITH {_CELLS_SQL}
    SELECT * FROM (
        SELECT email_id, zone, unnest([0, 1, 3, 9]) AS pos, unnest(['VESSEL', 'DWT', 'COATING', 'LAST CARGO']) AS header,
               unnest([a1, a2, a3, a4]) AS active FROM groups)
    WHERE active""")
def active_columns(spark, sf):
    cells = report.with_cells(line_report_records(spark, sf))
    summary = report.zone_summary(cells, ["email_id", "zone"])
    return report.active_columns(summary, ["email_id", "zone"]).withColumn("active", F.lit(True))


def _cell_sql(active, value):
    return f"CASE WHEN {active} THEN '<td>' || COALESCE(NULLIF({value}, ''), '—') || '</td>' ELSE '' END"


def _head_sql(active, header):
    return f"CASE WHEN {active} THEN '<th>{header}</th>' ELSE '' END"


_FRAGMENTS_SQL = f"""
    {_CELLS_SQL},
    numbered AS (
        SELECT c.*, g.n_records, a1, a2, a3, a4,
               row_number() OVER (PARTITION BY c.email_id, c.zone ORDER BY s_name, s_suppkey, l_orderkey, record_id) AS rn
        FROM cells c JOIN groups g ON c.email_id = g.email_id AND c.zone = g.zone),
    rows AS (
        SELECT email_id, zone, n_records, rn, (rn - 1) // 1000 AS fragment, a1, a2, a3, a4,
               '<tr>' || {_cell_sql('a1', 'vessel')} || {_cell_sql('a2', 'dwt')} || {_cell_sql('a3', 'coating')}
               || {_cell_sql('a4', 'cargo')} || '</tr>' AS html
        FROM numbered),
    fragments AS (
        SELECT email_id, zone, fragment, n_records,
               CASE WHEN fragment = 0 THEN '<h3>' || zone || '</h3><table><thead><tr>' || {_head_sql('a1', 'VESSEL')}
                    || {_head_sql('a2', 'DWT')} || {_head_sql('a3', 'COATING')} || {_head_sql('a4', 'LAST CARGO')}
                    || '</tr></thead><tbody>' ELSE '' END
               || string_agg(html, '' ORDER BY rn)
               || CASE WHEN fragment = (n_records - 1) // 1000 THEN '</tbody></table>' ELSE '' END AS html
        FROM rows GROUP BY email_id, zone, fragment, n_records, a1, a2, a3, a4)"""


@query(f"WITH {_FRAGMENTS_SQL} SELECT email_id, zone, CAST(fragment AS BIGINT) AS fragment, n_records, md5(html) AS html_md5, length(html) AS n_chars FROM fragments")
def zone_html(spark, sf):
    made = report.report_fragments(line_report_records(spark, sf))
    return made.select("email_id", "zone", "fragment", "n_records", F.md5("html").alias("html_md5"), F.length("html").alias("n_chars"))


@query(f"""
    WITH {_FRAGMENTS_SQL},
    placed AS (
        SELECT f.*, z.zone_pos, count(*) OVER (PARTITION BY email_id) AS n, row_number() OVER (PARTITION BY email_id ORDER BY zone_pos, fragment) AS k
        FROM fragments f JOIN {ZONES_SQL.replace('AS zones', 'AS z')} ON z.zone = f.zone)
    SELECT email_id, zone_pos, CAST(fragment AS BIGINT) AS fragment,
           md5(CASE WHEN k = 1 THEN '<!DOCTYPE html><html><body><p>{DEFAULT_INTRO}</p>' ELSE chr(10) END || html
               || CASE WHEN k = n THEN '</body></html>' ELSE '' END) AS html_md5
    FROM placed""")
def report_documents(spark, sf):
    """The whole flow: one document per nation, in pieces."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("email_id"), F.lit("ready_for_validation").alias("status"))
    done = report_plan(line_report_records(spark, sf), nations)
    return done.documents.select("email_id", "zone_pos", "fragment", F.md5("html").alias("html_md5"))


@query(f"""
    WITH {_CELLS_SQL}
    SELECT c.email_id, z.zone, z.zone_pos, z.lat, z.lng, COUNT(*) AS n_records
    FROM cells c JOIN {ZONES_SQL.replace('AS zones', 'AS z')} ON z.zone = c.zone GROUP BY ALL""")
def zone_markers(spark, sf):
    return report.zone_markers(line_report_records(spark, sf)).select("email_id", "zone", "zone_pos", "lat", "lng", "n_records")


@query("""
    SELECT n_nationkey AS email_id, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
           THEN 'drafted' ELSE 'ready_for_validation' END AS status FROM nation""")
def report_status(spark, sf):
    """E-mails with a report become drafted."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("email_id"), F.lit("ready_for_validation").alias("status"))
    return report_plan(line_report_records(spark, sf), nations).emails


@query(f"""
    WITH {_FRAGMENTS_SQL}
    SELECT email_id, COUNT(*) AS n_pieces, CAST(SUM(length(html)) + COUNT(*) - 1 + {len('<!DOCTYPE html><html><body><p></p></body></html>') + len(DEFAULT_INTRO)} AS BIGINT) AS n_chars
    FROM fragments GROUP BY email_id""")
def report_written(spark, sf):
    """Documents written as Parquet and read back."""
    path = shared_path(spark, "report")
    write_report(report.report_documents(report.report_fragments(line_report_records(spark, sf))), path)
    return spark.read.parquet(path).groupBy("email_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(F.length("html")).alias("n_chars"))


@query(f"""
    WITH {_CELLS_SQL}
    SELECT NULLIF(email_id, 7) AS email_id, zone, COUNT(*) AS n_rows FROM cells GROUP BY ALL""")
def report_null_group(spark, sf):
    """Records without an e-mail keep their tables: no row of a report is lost."""
    records = line_report_records(spark, sf).withColumn("email_id", F.nullif(F.col("email_id"), F.lit(7)))
    made = report.report_fragments(records)
    rows = (F.length("html") - F.length(F.replace("html", F.lit("<tr>"), F.lit("")))) / 4 - (F.col("fragment") == 0).cast("int")
    return made.groupBy("email_id", "zone").agg(F.sum(rows).cast("long").alias("n_rows"))

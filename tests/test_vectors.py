"""Values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quayside import config_tables
from quayside.functions import dates, maps, text
from quayside.functions.zones import zone_of
from quayside.operators import replies, superset, zones

ZONE_VECTORS = {
    None: "UNSPECIFIED", "": "UNSPECIFIED", " ": "STRAITS/SEA", "UNSPECIFIED": "FAR EAST", "AG": "INDIA",
    "US": "AG/MIDDLE EAST", "EAST": "FAR EAST", "PORT": "STRAITS/SEA", "LAGOS": "AG/MIDDLE EAST",
    "COPENHAGEN": "AG/MIDDLE EAST", "ROMANIA": "AG/MIDDLE EAST", "FUKUOKA": "EUROPE", "MIDDLE EAST": "UNSPECIFIED",
    "ASIA": "UNSPECIFIED", "AMERICA": "UNSPECIFIED", "EUROPE": "EUROPE", "AFRICA": "AFRICA", " Sikka ": "INDIA",
    "singapore\nstraits": "STRAITS/SEA", "china\njapan": "FAR EAST", "geelong\nmumbai": "FAR EAST", "\n": "STRAITS/SEA",
    "port\nklang": "UNSPECIFIED", "East China": "FAR EAST", "Hong Kong / Manila": "STRAITS/SEA",
}


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(expr.alias("x")).first().x


def plain_zone(region):
    """The rule read row by row, as a check that shares nothing with the expression."""
    if not region:
        return "UNSPECIFIED"
    place = region.strip().lower()
    hits = [(p, z) for p, k, z in config_tables.ZONE_RULES if k in place or place in k]
    return min(hits)[1] if hits else "UNSPECIFIED"


def test_config_tables(spark):
    assert len(config_tables.ZONE_RULES) == 72 == len({k for _, k, _ in config_tables.ZONE_RULES})
    assert len(config_tables.PRIORITY_KEYS) == 22 and len(config_tables.REPORT_COLUMNS) == 13
    assert config_tables.zones(spark).count() == 8
    assert config_tables.report_columns(spark).count() == 13 and config_tables.priority_keys(spark).count() == 22


@pytest.mark.parametrize("path", ["expression", "operator", "rules", "short blocks"])
def test_zone_vectors(spark, path, monkeypatch):
    keywords = [k for _, k, _ in config_tables.ZONE_RULES]
    texts = list(ZONE_VECTORS) + [k[1:] for k in keywords] + [f"at {k.upper()} / x" for k in keywords] + ["zz", "x" * 60]
    df = spark.createDataFrame([(t,) for t in texts], "region string")
    if path == "expression":
        df = df.withColumn("zone", zone_of("region"))
    elif path == "operator":
        df = zones.with_zone(df)
    else:
        monkeypatch.setattr(zones, "BLOCK_CHARS", 256 if path == "rules" else 3)
        df = zones.match_rules(df, "region", config_tables.zone_rules(spark))
    got = {r.region: r.zone for r in df.collect()}
    assert got == {t: plain_zone(t) for t in texts}
    assert {t: got[t] for t in ZONE_VECTORS} == ZONE_VECTORS


def test_zone_word_mode(spark):
    rows = [("AG",), ("LAGOS",), ("Hong Kong port",), ("UNSPECIFIED",), ("east china sea",), ("uk-based",)]
    df = zones.with_zone(spark.createDataFrame(rows, "region string"), mode="word")
    assert [r.zone for r in df.collect()] == [
        "AG/MIDDLE EAST", "UNSPECIFIED", "FAR EAST", "UNSPECIFIED", "FAR EAST", "EUROPE",
    ]


def test_zone_coordinates_default(spark):
    df = zones.with_coordinates(spark.createDataFrame([("INDIA",), ("NOWHERE",)], "zone string"))
    assert {r.zone: (r.lat, r.lng) for r in df.collect()} == {"INDIA": (20.59, 78.96), "NOWHERE": (0.0, 0.0)}


def test_superset_order(spark):
    rows = [(1, {"dwt": "1", "zeta": "2", "Alpha": "3"}), (1, {"vessel_name": "4", "beta": "5"}), (2, {}), (3, {"é": "1", "z": "1", "Z": "1"})]
    df = spark.createDataFrame(rows, "email_id int, dynamic_data map<string,string>")
    got = {r.email_id: r.superset for r in superset.key_superset(df, ["email_id"]).collect()}
    assert got == {1: ["vessel_name", "dwt", "Alpha", "beta", "zeta"], 2: [], 3: ["Z", "z", "é"]}


def test_backfill(spark):
    df = spark.createDataFrame([({"a": "1", "n": None}, ["a", "b", "n"])], "m map<string,string>, s array<string>")
    once = df.select(maps.backfill("m", "s").alias("m"), "s")
    assert once.first().m == {"a": "1", "b": "", "n": None}
    assert once.select(maps.backfill("m", "s").alias("m")).first().m == once.first().m


def test_maps(spark):
    m = "map<string,string>"
    assert one(spark, maps.normalise_keys("m"), m=(m, {"Last Cargo": "x", "last cargo": "y", "A": None})) == {"last_cargo": "y", "a": None}
    assert one(spark, maps.normalise_keys("m"), m=(m, {})) == {}
    region, rest = maps.split_region("m")
    assert one(spark, F.struct(region.alias("r"), rest.alias("m")), m=(m, {"region": "SIKKA", "dwt": "1"})) == ("SIKKA", {"dwt": "1"})
    upper = one(spark, F.struct(region.alias("r"), rest.alias("m")), m=(m, {"Region": "SIKKA"}))
    assert upper.r is None and upper.m == {"Region": "SIKKA"}
    for data, cell in [({"dwt": " Unknown ", "sdwt": " 12 "}, "12"), ({"dwt": "-"}, ""), ({"dwt": "0"}, "0"), ({"dwt": None, "sdwt": "N/A"}, ""), ({}, "")]:
        assert one(spark, maps.alias_cell("m", ["dwt", "sdwt"]), m=(m, data)) == cell
    assert one(spark, maps.set_cell("m", F.lit("a"), F.lit("2")), m=(m, {"a": "1", "b": "3"})) == {"a": "2", "b": "3"}
    cells = one(spark, maps.report_cells("m"), m=(m, {"name": "N", "sire_valid": "s", "cbm": " 9 ", "imo": "none"}))
    assert cells == ["N", "", "", "", "", "", "", "", "9", "", "s", "", ""]
    assert one(spark, maps.filled_mask("c", 13), c=("array<string>", cells)) == 1 + (1 << 8) + (1 << 10)


HTML_VECTORS = {
    "<p>a&nbsp;&amp;lt;b</p>": "a <b", "a  b": "a b", "x < y": "x < y", "<<<<": "<<<<", "<>": "<>", "a<b\nc>d": "a d",
    "<script>s = 1</script>t": "s = 1 t", " \n one \t two ": "one two", "<a><b": "<b", "": "", "a > b < c": "a > b < c",
}


@pytest.mark.parametrize("html", HTML_VECTORS)
def test_html_to_text(spark, html):
    assert one(spark, text.html_to_text("h"), h=("string", html)) == HTML_VECTORS[html]


def test_long_hostile_text_stays_linear(spark):
    n = 400_000
    df = spark.createDataFrame([("<" * n,), (" " * n + "x",), ("x" + " " * n,), ("[" * n,)], "h string")
    rows = df.select(F.length(text.html_to_text("h")).alias("n"), replies.parse_reply("h").alias("p")).collect()
    assert [r.n for r in rows] == [n, 1, 1, n] and all(r.p.elements == [] for r in rows)


def test_scalars(spark):
    s = "string"
    assert one(spark, text.word_count("h"), h=(s, "<p>a b</p><p>c</p>")) == 3
    assert one(spark, text.word_count("h"), h=(s, None)) == 0
    assert one(spark, text.word_count("h"), h=(s, "a\ufeffb\x1cc \u3000 d<>e")) == 4
    assert one(spark, text.file_stem("f"), f=(s, "X.EML")) == "X"
    assert one(spark, text.part_filename("f", F.lit(3)), f=(s, "")) == "attachment_003.eml"
    assert one(spark, text.strip("f"), f=(s, "\x1c  a b \n")) == "a b" == "\x1c  a b \n".strip()
    assert one(spark, text.is_blank("f"), f=(s, " \x1f")) and one(spark, text.is_blank("f"), f=(s, None))
    assert one(spark, text.strip_fences("f"), f=(s, "```json\n[1]\n```  ")) == "[1]"
    assert one(spark, text.count_char("f", "{"), f=(s, "{{}")) == 2
    assert one(spark, text.plural("n"), n=("int", 1)) == "" and one(spark, text.plural("n"), n=("int", 0)) == "s"
    assert one(spark, text.or_dash("f"), f=(s, "")) == "—" == one(spark, text.or_dash("f"), f=(s, None))
    assert one(spark, text.text_length("f"), f=(s, None)) == 0
    assert one(spark, text.remainder_length("f", 3), f=(s, "abcde")) == 2
    assert one(spark, text.status_label("f"), f=(s, "ready_for_validation")) == "ready for validation"
    assert one(spark, text.escape_html("f"), f=(s, '<a> & "b"')) == "&lt;a&gt; &amp; &quot;b&quot;"


def test_whitespace_is_what_python_strips():
    import sys

    assert set(text.WHITESPACE) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}


DATE_VECTORS = {
    "Mon, 1 Jan 2024 10:00:00 +0530": "2024-01-01 04:30:00", "Mon, 01 jan 2024 10:00:00 +05:30": "2024-01-01 04:30:00",
    "Tue, 29 Feb 2024 23:59:59 -0100": "2024-03-01 00:59:59", "Mon, 1 Jan 2024 10:00:00 +0000 (UTC)": None,
    "Mon, 1 Jan 2024 10:00:00 GMT": None, "1 Jan 2024 10:00:00 +0000": None, "Mon, 31 Feb 2024 10:00:00 +0000": None,
    "Mon, 1 Jan 2024 25:00:00 +0000": None, "": None, None: None, "a|b|c|d|e|f|g|h": None,
    "Mon,  1 Jan 2024  9:05:07 Z": "2024-01-01 09:05:07",
}


def test_mail_dates(spark):
    df = spark.createDataFrame([(d,) for d in DATE_VECTORS], "d string")
    got = {r.d: r.t for r in df.select("d", F.date_format(dates.mail_date("d"), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()}
    assert got == DATE_VECTORS
    fallback = df.where("d = ''").select(dates.received_at("d").alias("t")).first().t
    assert abs((fallback - dt.datetime.now()).total_seconds()) < 24 * 3600

"""Fixed dictionaries. Order is meaning in all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: zone keywords, in matching order -------------------------------------
ZONE_KEYWORDS: list[tuple[str, list[str]]] = [
    ("STRAITS/SEA", [
        "singapore", "straits", "johor", "batam", "bintan", "tanjung uban", "tanjung pelepas", "merak", "surabaya",
        "java", "indonesia", "lombok", "kalimantan", "malaysia", "kuantan", "port klang", "manila", "philippines",
    ]),
    ("FAR EAST", [
        "hong kong", "china", "japan", "korea", "taiwan", "chiba", "tokyo", "yokohama", "yangoon", "yangon",
        "myanmar", "vietnam", "nha be", "hai phong", "thailand", "eci", "east china", "lianyungang", "geelong",
    ]),
    ("INDIA", [
        "mumbai", "kandla", "sikka", "vizag", "cochin", "chennai", "india", "nhava sheva", "kolkata", "haldia",
    ]),
    ("AG/MIDDLE EAST", [
        "fujairah", "uae", "kuwait", "saudi", "oman", "ag", "jubail", "ruwais", "bahrain", "muscat",
    ]),
    ("EUROPE", ["rotterdam", "antwerp", "hamburg", "europe", "uk", "amsterdam"]),
    ("AFRICA", ["durban", "cape town", "africa", "mombasa", "dar es salaam"]),
    ("OCEANIA", ["australia", "sydney", "melbourne", "new zealand"]),
]

# --- Fixed values: fallback zone --------------------------------------------------------
UNSPECIFIED = "UNSPECIFIED"

# --- Fixed values: zones in display order with latitude and longitude --------------------
ZONES: list[tuple[str, float, float]] = [
    ("STRAITS/SEA", 1.35, 103.82),
    ("FAR EAST", 31.23, 121.47),
    ("INDIA", 20.59, 78.96),
    ("AG/MIDDLE EAST", 25.20, 55.27),
    ("EUROPE", 51.50, -0.13),
    ("AFRICA", -26.20, 28.05),
    ("OCEANIA", -33.87, 151.21),
    ("UNSPECIFIED", 0.0, 20.0),
]

# --- Fixed values: report columns, header and the keys tried in turn ---------------------
REPORT_COLUMNS: list[tuple[str, list[str]]] = [
    ("VESSEL", ["vessel_name", "name"]),
    ("DWT", ["dwt", "sdwt"]),
    ("BUILT", ["built"]),
    ("COATING", ["coating", "tank_type", "tank_coating"]),
    ("IMO", ["imo_type", "imo"]),
    ("OPEN", ["open_location", "open"]),
    ("OPEN DATE", ["open_date", "opening_date", "dates", "date"]),
    ("SEEKING", ["seeking", "basis", "eta_foc"]),
    ("CAPACITY", ["cargo_tank_cap", "cargo_tank_capacity", "cbm", "dwt_cbm"]),
    ("LAST CARGO", ["last_3_cargoes", "last_3_cargos", "last_cargos", "last_cargo"]),
    ("SIRE", ["sire", "sire_valid"]),
    ("L3C", ["l3c"]),
    ("COMMENTS", ["comments"]),
]

# --- Fixed values: keys listed first in a superset, in this order ------------------------
PRIORITY_KEYS: list[str] = [
    "vessel_name", "dwt", "built", "imo", "flag", "region", "open_date", "laycan", "coating", "last_cargo", "space",
    "direction", "speed", "loa", "beam", "draft", "holds", "hatches", "cranes", "grain_cap", "bale_cap", "owner",
]

# --- Fixed values: lower-cased cell texts that mean "no value" ---------------------------
NULL_TOKENS: list[str] = ["unknown", "none", "n/a", "-", ""]

# --- Fixed values: status words ----------------------------------------------------------
EMAIL_STATUSES = ["fetching", "extracting", "ready_for_validation", "drafted"]
ATTACHMENT_STATUSES = ["pending", "extracting", "done", "error"]
READY_STATUSES = ["ready_for_validation", "drafted"]
PREVIEW_STATUSES = ["done", "extracting"]

# --- Fixed values: event type to attachment status, and the types that end a job ---------
EVENT_STATUS: dict[str, str] = {
    "attachment_saved": "pending",
    "extraction_started": "extracting",
    "extraction_done": "done",
    "extraction_error": "error",
}
TERMINAL_EVENTS = ["phase1_complete", "phase1_failed", "drafting_done", "phase2_failed"]

# --- Fixed values: limits ----------------------------------------------------------------
PREVIEW_CHARS = 1_000
RECENT_EVENTS = 50

# The sentence used when no introduction is given.
DEFAULT_INTRO = "All open positions on record, one table for each trade zone."

ZONE_RULES: list[tuple[int, str, str]] = [
    (priority, keyword, zone)
    for priority, (zone, keyword) in enumerate(
        (zone, keyword) for zone, keywords in ZONE_KEYWORDS for keyword in keywords
    )
]


def zone_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONE_RULES, "priority int, keyword string, zone string")


def zones(spark: SparkSession) -> DataFrame:
    rows = [(name, pos, lat, lng) for pos, (name, lat, lng) in enumerate(ZONES)]
    return spark.createDataFrame(rows, "zone string, zone_pos int, lat double, lng double")


def report_columns(spark: SparkSession) -> DataFrame:
    rows = [(pos, header, keys) for pos, (header, keys) in enumerate(REPORT_COLUMNS)]
    return spark.createDataFrame(rows, "pos int, header string, keys array<string>")


def priority_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PRIORITY_KEYS)), "pos int, key string")

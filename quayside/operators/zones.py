"""Zone classification and zone counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quayside.config_tables import UNSPECIFIED, ZONE_RULES
from quayside.functions.zones import Rules, place_of, zone_coordinate, zone_of_place, zone_or_default, zone_position
from quayside.operators.joins import attach
from quayside.operators.runs import holding, run_counts
from quayside.session import pin

GRAM_CHARS = 4
BLOCK_CHARS = 256
KEY_RUNS = 64
# Pieces of up to so many runs and characters are carried to the wholes; others meet them by joins.
CARRIED_RUNS = 100_000
CARRIED_CHARS = 1 << 20


def with_zone(df: DataFrame, region: str = "region", mode: str = "compat", rules: Rules = ZONE_RULES) -> DataFrame:
    """Add ``zone`` by the fixed dictionary, row by row in the scan stage: nothing is shuffled.

    The trimmed place is a column of its own, so that it is computed once per row.
    """
    placed = df.withColumn("_place", place_of(region))
    return placed.withColumn("zone", zone_or_default(region, zone_of_place("_place", mode, rules))).drop("_place")


def match_rules(df: DataFrame, region: str, rules: DataFrame) -> DataFrame:
    """Add ``zone`` by a rule table (priority, keyword, zone) of any size; same result as ``with_zone``.

    Each distinct text is matched once, by a positional index: a keyword inside a text has its rarest run of
    characters there, and a text inside a keyword likewise. What meets on such a run is
    verified at the one place it can be, so no text is compared with all rules. Zones come back to the rows by the
    texts' digests.
    """
    text = place_of(region)
    # Lengths and digests are columns of their own: what asks for them reads no text.
    told = {"_id": F.monotonically_increasing_id(), "_length": F.length("_text"), "_key": F.sha2("_text", 256)}
    places = pin(df.where(F.col(region) != "").select(text.alias("_text")).distinct().withColumns(told))
    rules = pin(rules.where(F.col("keyword").isNotNull()).select("priority", "keyword", "zone").withColumn("_rule", F.monotonically_increasing_id()))
    texts = places.select(F.col("_id").alias("a"), F.col("_text").alias("s"), F.col("_length").alias("length"))
    words = rules.select(F.col("_rule").alias("a"), F.col("keyword").alias("s"))
    inside_text = _holding(texts, words).toDF("_id", "_rule")
    inside_word = _holding(words, texts).toDF("_rule", "_id").select("_id", "_rule")
    hits = inside_text.unionByName(inside_word).join(rules.select("_rule", "priority", "zone"), "_rule")
    best = hits.groupBy("_id").agg(F.min_by("zone", "priority").alias("_zone")).join(places.select("_id", "_key"), "_id").select("_key", "_zone")
    keyed = df.withColumn("_key", F.when(F.col(region) != "", F.sha2(text, 256)))
    return attach(keyed, best, ["_key"]).withColumn("zone", F.coalesce("_zone", F.lit(UNSPECIFIED))).drop("_key", "_zone")


def _grams(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """(a, gram, at): every run of characters of the given lengths in the texts of ``rows`` (a, s), with its 1-based place.

    Texts are cut into overlapping blocks by one pass of a pattern, so a place deep inside a long
    text costs no more than one at its beginning. The rows carry no text but the gram. Length 0 is the
    empty run that every text has, once.
    """
    blocks = _blocks(rows, max(sizes, default=1) - 1 if any(sizes) else 0)
    places = blocks.select("a", "number", "block", F.explode(F.sequence(F.lit(1), F.least(F.length("block"), F.lit(BLOCK_CHARS)))).alias("at"))
    lengths = F.explode(F.array(*[F.lit(n) for n in sizes if n]).cast("array<int>")).alias("size")
    runs = places.select("a", "number", "block", "at", lengths).where(F.col("at") + F.col("size") - 1 <= F.length("block"))
    grams = runs.select("a", F.substring("block", F.col("at"), F.col("size")).alias("gram"), (F.col("number") * BLOCK_CHARS + F.col("at")).alias("at"))
    return grams.unionByName(rows.select("a", F.lit("").alias("gram"), F.lit(1).alias("at"))) if 0 in sizes else grams


def _runs(pieces: DataFrame) -> DataFrame:
    """(b, gram, offset, tried, length): of each piece's runs of GRAM_CHARS, or itself where it is shorter, at most about KEY_RUNS, evenly spaced.

    A piece may be keyed by any of its runs, so a long one needs no more to find a rare one.
    """
    size = F.least(F.length("s"), F.lit(GRAM_CHARS))
    last = F.greatest(F.length("s") - size + 1, F.lit(1))
    step = F.ceil(last / F.lit(KEY_RUNS)).cast("int")
    offsets = pieces.select("a", "s", size.alias("size"), F.sequence(F.lit(1), last, step).alias("offsets"))
    each = offsets.select("a", "s", "size", F.size("offsets").alias("tried"), F.explode("offsets").alias("offset"))
    return each.select(F.col("a").alias("b"), F.substring("s", F.col("offset"), F.col("size")).alias("gram"), "offset", "tried", F.length("s").alias("length"))


def _blocks(rows: DataFrame, more: int) -> DataFrame:
    """(a, number, block): the texts of ``rows`` (a, s) in blocks of BLOCK_CHARS, each with up to ``more`` characters of what follows."""
    pattern = f"(?s)(?=(.{{1,{BLOCK_CHARS + more}}})).{{1,{BLOCK_CHARS}}}"
    return rows.select("a", F.posexplode(F.regexp_extract_all("s", F.lit(pattern), F.lit(1))).alias("number", "block"))


def _holding(wholes: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pairs (whole, piece) of ids where the text of one contains that of the other. Both have columns (a, s), and length where it is known.

    A positional index of short runs of characters: of its runs of GRAM_CHARS (or itself, where it is shorter) each piece is
    keyed by the one that is rarest among the wholes, with its place inside the piece. A whole that has that run
    somewhere can hold the piece at one place only, which is verified. A piece with a run that no whole
    has is out before that, and one longer than all wholes before it is cut into runs. Postings are an id, a run and a
    place. A piece that is one run needs no verification; others meet blocks of the wholes' texts, each block
    only where a candidate begins, or one of its further stretches of BLOCK_CHARS.

    Pieces that are few enough to be carried are looked for where the wholes are read, by the same runs: none of the wholes' runs becomes a row.
    """
    wholes, pieces = (x if "length" in x.columns else x.withColumn("length", F.length("s")) for x in (wholes, pieces))
    longest = wholes.agg(F.max("length")).first()[0]
    pieces = pieces.where(F.col("length") <= F.lit(longest))
    # Keys, candidates and hits are tables whose size is known: small ones go to the texts, and no text's runs are shuffled to meet them.
    keyed = pin(_runs(pieces))
    chars = F.sum(F.col("length") / F.col("tried")).alias("chars")
    told = keyed.agg(F.max("length").alias("most"), F.collect_set(F.length("gram")).alias("sizes"), F.count(F.lit(1)).alias("runs"), chars).first()
    if told["runs"] <= CARRIED_RUNS and (told["chars"] or 0) <= CARRIED_CHARS:
        return _holding_carried(wholes, pieces, keyed)
    postings = pin(_grams(wholes, sorted(told["sizes"])).join(pin(keyed.select("gram").distinct()), "gram", "left_semi"))
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = keyed.join(counts, "gram").groupBy("b").agg(
        F.min(F.struct("n", "offset", "gram")).alias("seed"), F.count(F.lit(1)).alias("found"), F.max("tried").alias("tried"), F.max("length").alias("length"))
    seeds = pin(rarest.where("found = tried").select("b", F.col("seed")["gram"].alias("gram"), F.col("seed")["offset"].alias("offset"), "length"))
    sure = postings.join(seeds.where(F.col("length") <= GRAM_CHARS), "gram").select("a", "b").distinct()
    start = (F.col("at") - F.col("offset")).alias("start")
    candidates = postings.join(seeds.where(F.col("length") > GRAM_CHARS), "gram").where("at >= offset").select("a", "b", start)
    parts = pieces.where(F.length("s") > GRAM_CHARS).select(
        F.col("a").alias("b"), F.posexplode(F.regexp_extract_all("s", F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))).alias("part", "chunk"))
    parts = pin(parts.join(seeds.select("b", F.ceil(F.col("length") / F.lit(BLOCK_CHARS)).alias("parts")), "b"))
    begun = candidates.join(parts, "b").withColumn("from", F.col("start") + F.col("part") * BLOCK_CHARS)
    looked = pin(begun.select(
        "a", "b", "start", "parts", "chunk", F.expr(f"int(from div {BLOCK_CHARS})").alias("number"), (F.col("from") % BLOCK_CHARS + 1).cast("int").alias("here")))
    blocks = _blocks(wholes, min(told["most"] or 1, BLOCK_CHARS) - 1)
    met = blocks.join(looked, ["a", "number"]).where(F.substring("block", F.col("here"), F.length("chunk")) == F.col("chunk"))
    verified = met.groupBy("a", "b", "start", "parts").agg(F.count(F.lit(1)).alias("n")).where("n = parts").select("a", "b").distinct()
    return sure.unionByName(verified)


def _holding_carried(wholes: DataFrame, pieces: DataFrame, keyed: DataFrame) -> DataFrame:
    """As ``_holding``, for pieces that are carried: the runs are counted in one pass over the wholes, the pieces with their rarest run found in another.

    Equal pieces are looked for once, under a number; their ids come back by a join on it.
    """
    spark, whole, piece = wholes.sparkSession, wholes.schema["a"].dataType, pieces.schema["a"].dataType
    grams: dict[object, list[bytes]] = {}
    for b, gram in keyed.select("b", F.col("gram").cast("binary")).collect():
        grams.setdefault(b, []).append(bytes(gram))
    if not grams:
        return spark.createDataFrame([], StructType([StructField("a", whole), StructField("b", piece)]))
    known = sorted({gram for of_piece in grams.values() for gram in of_piece if gram})
    counts = dict(zip(known, run_counts(wholes, known))) | {b"": 1}
    seeds = {b: min(of_piece, key=lambda gram: (counts[gram], gram)) for b, of_piece in grams.items()}
    numbers: dict[bytes, tuple[int, bytes]] = {}
    ids = []
    for b, text in pieces.select("a", F.col("s").cast("binary")).collect():
        if b in seeds and counts[seeds[b]]:
            ids.append((numbers.setdefault(bytes(text), (len(numbers), seeds[b]))[0], b))
    named = pin(spark.createDataFrame(ids, StructType([StructField("number", LongType()), StructField("b", piece)])))
    found = holding(wholes, [(number, text, seed) for text, (number, seed) in numbers.items()])
    return found.join(named, "number").select("a", "b").distinct()


def with_coordinates(df: DataFrame) -> DataFrame:
    """Add latitude and longitude of ``zone``; (0, 0) for an unknown one."""
    return df.withColumns({"lat": zone_coordinate("zone", "lat"), "lng": zone_coordinate("zone", "lng")})


def zone_counts(zoned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records per zone with coordinates and display position."""
    counts = zoned.groupBy(*(by or []), "zone").agg(F.count(F.lit(1)).alias("n_records"))
    return with_coordinates(counts).withColumn("zone_pos", zone_position("zone"))


def in_zone_order(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.orderBy(*(by or []), "zone_pos", "zone")

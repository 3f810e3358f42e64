"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import decontaminate, embeddings, hard_negatives, languages, licenses, merkle, mixing, secrets, simhash, token_counts, toxicity, url_lists, warc
from quayside.llm.common import table
from quayside.llm.oracles import EMBEDDINGS_SQL, HARD_NEGATIVES_SQL, LICENSES_SQL, MERKLE_SQL, MIX_SQL, WARC_SQL

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.train(docs, labels.where(~held_out))
    worst = F.array_max(F.transform("offending", lambda s: F.struct(s["score"].alias("score"), s["start"], s["end"])))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"), worst["start"].alias("worst_start"), worst["end"].alias("worst_end"))


@query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.close_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


@query()
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in secrets.BASE_RULES]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def only(kind):
        return F.filter("secrets", lambda s: s["kind"] == kind)

    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *[F.size(only(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"))


@query(MIX_SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.json") -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), token_counts.read_pieces(vocabulary)).drop("text")


@query(WARC_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.with_revisits(table(spark, sf_dir, "pages"))
    files = warc.write_archives(rows, warc.archive_folder(spark))
    return warc.read_archives(files).select(
        F.col("item_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "digest_ok", "error")


LIST_EVENTS_SQL = r"""
    SELECT 'list' || (page_id % 3) AS list, action, day,
           CASE page_id % 4 WHEN 0 THEN host WHEN 1 THEN regexp_replace(host, '^[^.]*[.]', '') WHEN 2 THEN host || '/' || regexp_extract(url, '://[^/]*/([^/?#]*/)', 1) ELSE host || '/' END AS entry
    FROM (SELECT page_id, url, regexp_extract(url, '://([^/:?#]*)', 1) AS host, DATE '2020-01-01' + CAST(page_id * 13 % 1461 AS INT) AS day,
                 CASE WHEN page_id % 5 < 2 THEN 'remove' ELSE 'add' END AS action
          FROM pages) h"""


def list_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated list entries derived from the pages: hosts, their parents, leading paths and roots, added and removed by turns."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"://([^/:?#]*)", 1)
    kind = F.col("page_id") % 4
    entry = F.when(kind == 0, host).when(kind == 1, F.regexp_replace(host, r"^[^.]*[.]", "")).when(
        kind == 2, F.concat(host, F.lit("/"), F.regexp_extract("url", r"://[^/]*/([^/?#]*/)", 1))).otherwise(F.concat(host, F.lit("/")))
    return pages.select(
        F.concat(F.lit("list"), F.col("page_id") % 3).alias("list"), entry.alias("entry"),
        F.when(F.col("page_id") % 5 < 2, "remove").otherwise("add").alias("action"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") * 13 % 1461).cast("int")).alias("at"))


@query(rf"""
WITH events AS ({LIST_EVENTS_SQL}),
daily AS (SELECT list, lower(regexp_extract(entry, '^[^/]*')) || regexp_replace(entry, '^[^/]*', '') AS entry, day, bool_or(action = 'remove') AS gone FROM events WHERE entry <> '' GROUP BY ALL),
dated AS (SELECT *, COALESCE(lead(day) OVER (PARTITION BY list, entry ORDER BY day), DATE '9999-12-31') AS stop FROM daily),
captures AS (SELECT page_id, url, DATE '2020-01-01' + CAST(page_id * 37 % 1461 AS INT) AS fetched_at,
                    lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host,
                    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*/|/)', 1) AS folder FROM pages),
keys AS (SELECT c.*, unnest(list_distinct(list_concat(
             list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) || [host || '/'],
             list_transform(range(2, len(string_split(folder, '/'))), lambda i: host || array_to_string(string_split(folder, '/')[1:i], '/') || '/')))) AS entry FROM captures c WHERE host <> ''),
hits AS (SELECT DISTINCT k.page_id, d.list FROM keys k JOIN dated d ON k.entry = d.entry AND k.fetched_at >= d.day AND k.fetched_at < d.stop WHERE NOT d.gone)
SELECT c.page_id, c.url, CAST(c.fetched_at AS VARCHAR) AS fetched_at, COALESCE(string_agg(h.list, ',' ORDER BY h.list), '') AS lists, count(h.list) > 0 AS blocked
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id GROUP BY c.page_id, c.url, c.fetched_at""")
def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") * 37 % 1461).cast("int")).alias("fetched_at"))
    found = url_lists.listed_captures(captures, list_events(spark, sf_dir))
    return found.withColumn("fetched_at", F.col("fetched_at").cast("string"))


@query(LICENSES_SQL)
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_summary(table(spark, sf_dir, "documents"))


@query(EMBEDDINGS_SQL)
def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(MERKLE_SQL)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query()
def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = languages.train(docs.where(~languages.held_out(F.col("doc_id"))))
    return languages.identify(docs, model).select(
        "doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query(HARD_NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, shifted)

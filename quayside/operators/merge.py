"""Tables of changes applied to tables of rows. Every function returns the new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.config_tables import ATTACHMENT_STATUSES, EMAIL_STATUSES
from quayside.functions.ids import stable_id
from quayside.functions.text import let
from quayside.operators.joins import without_removed
from quayside.operators.ranking import first_attachment

REGION_FIELD = "__region__"


def replace_rows(df: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Untouched rows plus changed ones."""
    return without_removed(df, changed, key).unionByName(changed)


def delete_rows(df: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows without the listed ids; an id that is not there is no error."""
    return without_removed(df, ids, key)


def conditional_update(df: DataFrame, values: dict[str, object], where: Column | None = None) -> DataFrame:
    """Set columns on the rows that match; on all rows without a condition."""
    def new(name: str, value) -> Column:
        value = value if isinstance(value, Column) else F.lit(value)
        return value if where is None else F.when(where, value).otherwise(F.col(name))

    return df.withColumns({name: new(name, value) for name, value in values.items()})


def advance_status(emails: DataFrame, done: DataFrame, status: str) -> DataFrame:
    """Set the status of the listed e-mails."""
    marked = done.select("email_id").distinct().withColumn("_hit", F.lit(True))
    return emails.join(marked, "email_id", "left").withColumn(
        "status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))
    ).drop("_hit")


def merge_emails(emails: DataFrame, incoming: DataFrame, order: str, nameless_key: list[str] | None = None) -> DataFrame:
    """Upsert by message id.

    A known message keeps its row and only goes back to ``extracting``; a new one is inserted.
    Repeats within the batch count as the first of them. A message without id is always new; it is
    identified by ``nameless_key`` (a path, a content hash), by default by all its columns, so only rows
    alike in all of them share an id.
    Returns the e-mail snapshot with ``is_incoming`` marking the rows this batch touched.
    """
    fields = [c for c in emails.columns if c not in ("email_id", "message_id", "status")]
    with_id = incoming.where(F.col("message_id").isNotNull())
    firsts = with_id.groupBy("message_id").agg(F.min_by(F.struct(*fields), order).alias("_new"))
    merged = (
        emails.where(F.col("message_id").isNotNull())
        .select("message_id", F.struct("email_id", "status", *fields).alias("_old"))
        .join(firsts, "message_id", "full")
    )
    touched = F.col("_new").isNotNull()
    kept = [F.when(F.col("_old").isNotNull(), F.col("_old")[f]).otherwise(F.col("_new")[f]).alias(f) for f in fields]
    known = merged.select(
        F.coalesce(F.col("_old.email_id"), stable_id("message_id")).alias("email_id"), "message_id",
        F.when(touched, F.lit("extracting")).otherwise(F.col("_old.status")).alias("status"),
        *kept, touched.alias("is_incoming"),
    )
    nameless = incoming.where(F.col("message_id").isNull()).select(
        stable_id(F.lit("nameless"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in nameless_key or incoming.columns]).alias("email_id"), "message_id", F.lit("extracting").alias("status"),
        *fields, F.lit(True).alias("is_incoming"),
    )
    untouched = emails.where(F.col("message_id").isNull()).withColumn("is_incoming", F.lit(False))
    return known.unionByName(nameless).unionByName(untouched).select(*emails.columns, "is_incoming")


def apply_edits(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply an edit feed in ``seq`` order.

    ``replace`` sets the whole map (and the region when given), ``cell`` one field, where the
    field ``__region__`` stands for the region. The feed is collapsed per record and field
    first, so a record edited a million times reaches the join as one row.
    """
    is_replace, is_cell = F.col("op") == "replace", F.col("op") == "cell"
    is_region = is_cell & (F.col("field") == REGION_FIELD)
    region = F.when(is_replace, F.col("region")).when(is_region, F.coalesce("value", F.lit("")))
    whole = edits.groupBy("record_id").agg(
        F.max(F.when(is_replace, F.col("seq"))).alias("_base_seq"),
        F.max_by("dynamic_data", F.when(is_replace, F.col("seq"))).alias("_base"),
        F.max_by(region, F.when(region.isNotNull(), F.col("seq"))).alias("_region"),
    )
    cells = (
        edits.where(is_cell & ~is_region)
        .groupBy("record_id", "field").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
        .groupBy("record_id").agg(F.collect_list(F.struct("field", "value", "seq")).alias("_cells"))
    )
    base = F.coalesce("_base", "dynamic_data")
    valid = F.filter(
        F.coalesce(F.col("_cells"), F.array().cast("array<struct<field:string,value:string,seq:bigint>>")),
        lambda c: F.col("_base_seq").isNull() | (c["seq"] > F.col("_base_seq")),
    )
    new_cells = let(valid, lambda cs: F.map_from_entries(F.transform(cs, lambda c: F.struct(c["field"], c["value"]))))
    edited = (
        records.join(whole, "record_id", "left").join(cells, "record_id", "left")
        .withColumn("_new", F.when(F.col("_cells").isNotNull(), new_cells))
    )
    overlaid = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key("_new", k)), F.col("_new"))
    return edited.withColumns({
        "dynamic_data": F.when(F.col("_new").isNull(), base).otherwise(overlaid),
        "region": F.coalesce("_region", "region"),
    }).select(*records.columns)


def unmatched_edits(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of records that do not exist."""
    return without_removed(edits, records, "record_id")


def add_blank_rows(records: DataFrame, requests: DataFrame, attachments: DataFrame) -> DataFrame:
    """One empty record per request (email_id, seq), under the e-mail's first attachment."""
    wanted = requests.select("email_id", "seq").join(first_attachment(attachments), "email_id")
    blank = {
        "record_id": stable_id(F.lit("manual"), "email_id", "seq"),
        "attachment_id": F.col("attachment_id"),
        "record_pos": F.lit(None),
        "dynamic_data": F.from_json(F.lit("{}"), "map<string,string>"),
        "region": F.lit(""),
        "is_validated": F.lit(False),
        "created_at": F.current_timestamp(),
    }
    types = {f.name: f.dataType for f in records.schema}
    return records.unionByName(wanted.select(*[
        blank.get(c, F.lit(None)).cast(types[c]).alias(c) for c in records.columns
    ]))


def unmatched_requests(requests: DataFrame, attachments: DataFrame) -> DataFrame:
    return without_removed(requests, attachments, "email_id")


def replace_children(
    attachments: DataFrame, records: DataFrame, new_records: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Swap the records of every attachment that has new ones and mark it done.

    An attachment without new records keeps its rows, status and error.
    """
    done = new_records.select("attachment_id").distinct()
    new_snapshot = without_removed(records, new_records, "attachment_id").unionByName(
        new_records, allowMissingColumns=True
    ).select(*records.columns)
    marked = attachments.join(done.withColumn("_done", F.lit(True)), "attachment_id", "left")
    return conditional_update(marked, {"status": "done", "error_message": None}, F.col("_done")).select(
        *attachments.columns
    ), new_snapshot


def apply_extraction(attachments: DataFrame, parsed: DataFrame) -> DataFrame:
    """Attachment snapshot with status and error of the parsed replies; others unchanged."""
    outcome = parsed.select("attachment_id", F.struct("status", "error_message").alias("_o"))
    hit = F.col("_o").isNotNull()
    return conditional_update(
        attachments.join(outcome, "attachment_id", "left"),
        {"error_message": F.coalesce(F.col("_o.error_message"), F.col("error_message")), "status": F.col("_o.status")},
        hit,
    ).select(*attachments.columns)


def selection_state(records: DataFrame, ids: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whether all, and whether some, rows are selected; an empty table is not fully selected."""
    marked = records.join(ids.select("record_id").distinct().withColumn("_hit", F.lit(True)), "record_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return marked.groupBy(*(by or [])).agg(
        F.coalesce(F.bool_and(hit), F.lit(False)).alias("all_selected"),
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("some_selected"),
    )


# --- integrity ------------------------------------------------------------------------------

def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return without_removed(children, parents, key)


def integrity_report(emails: DataFrame, attachments: DataFrame, records: DataFrame) -> DataFrame:
    """Number of violations per constraint; zero rows are listed too."""
    def row(check: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(check).alias("check_name"), "violations")

    def rows_of(name: str, df: DataFrame, columns: list[str], statuses: list[str] | None = None) -> DataFrame:
        """All checks of a table that a row decides by itself, in one pass."""
        counts = {f"{name}.{c} missing": F.count_if(F.col(c).isNull()) for c in columns}
        if statuses:
            counts[f"{name}.status unknown"] = F.count_if(~F.col("status").isin(statuses))
        found = df.agg(*[n.alias(f"_{i}") for i, n in enumerate(counts.values())])
        pairs = [F.struct(F.lit(check).alias("check_name"), F.col(f"_{i}").alias("violations")) for i, check in enumerate(counts)]
        return found.select(F.inline(F.array(*pairs)))

    checks = [
        row("emails.message_id repeated", duplicates(emails, "message_id")),
        row("attachments without email", orphans(attachments, emails, "email_id")),
        row("records without attachment", orphans(records, attachments, "attachment_id")),
        rows_of("emails", emails, ["subject", "sender", "date_received", "status"], EMAIL_STATUSES),
        rows_of("attachments", attachments, ["email_id", "filename", "status"], ATTACHMENT_STATUSES),
        rows_of("records", records, ["attachment_id", "dynamic_data"]),
    ]
    report = checks[0]
    for check in checks[1:]:
        report = report.unionByName(check)
    return report

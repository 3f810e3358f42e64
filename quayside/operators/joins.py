"""Joins between e-mails, attachments and records.

None carries a broadcast hint: which side is small depends on the data, and adaptive
execution decides from measured sizes. Wide text columns are projected away first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quayside.operators.numbering import number_rows
from quayside.session import pin

CHILDREN_PER_ROW = 1_000
# Children of one parent that are gathered in one array before it is cut into chunks.
GATHERED = 1_000


def attach(rows: DataFrame, per_key: DataFrame, on: list[str], how: str = "left", nulls: bool = False) -> DataFrame:
    """Join a table of one row per key to rows whose keys may be hot.

    The per-key side is pinned first, for two reasons. Its size is then known, so a small one is
    broadcast and the rows stay where they are. And a large one is read from a table: adaptive
    execution splits a hot key only between two plain shuffles, not against an aggregate that is
    already placed by that key. With ``nulls`` null keys meet null keys, as they do when rows are
    grouped: the join is then on a text that tells null from all values.
    """
    other = pin(per_key)
    if not nulls:
        return rows.join(other, on, how)
    keys = {f"_key_{c}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("!")) for c in on}
    return rows.withColumns(keys).join(other.withColumns(keys).drop(*on), list(keys), how).drop(*keys)


def records_full(records: DataFrame, attachments: DataFrame, emails: DataFrame) -> DataFrame:
    """Records with their source file and e-mail. The small tables meet first: records cross the network once."""
    sources = attachments.select("attachment_id", "email_id", "filename").join(
        emails.select("email_id", "subject", "date_received"), "email_id"
    )
    return records.select(
        "record_id", "attachment_id", "record_pos", "dynamic_data", "region", "is_validated", "created_at"
    ).join(sources, "attachment_id")


def record_counts(attachments: DataFrame, records: DataFrame) -> DataFrame:
    """Records per attachment, zero included. Counting first keeps a hot attachment off one task."""
    counts = records.groupBy("attachment_id").agg(F.count("record_id").alias("record_count"))
    return attachments.select("attachment_id", "filename", "status").join(counts, "attachment_id", "left").withColumn(
        "record_count", F.coalesce("record_count", F.lit(0).cast("long"))
    )


def nest_children(
    parents: DataFrame, children: DataFrame, key: str, position: str, fields: list[str], name: str,
    per_row: int = CHILDREN_PER_ROW,
) -> DataFrame:
    """Parents with their children as an ordered array; ``[]`` where there are none.

    A parent with more than ``per_row`` children continues on further rows (``chunk`` 1, 2, ...),
    so no array grows with the data. Chunks follow the children's rank, whatever their
    positions; children without a position come last. Children are gathered by key, sorted there and cut into chunks; only those of
    parents with more than GATHERED (or ``per_row``) children are ranked by a sort over all of them.
    """
    others = [f for f in fields if f != position]
    rows = children.where(F.col(key).isNotNull()).select(key, position, *others)
    maps = [f for f in others if isinstance(children.schema[f].dataType, MapType)]
    # Maps have no order: they are compared, and sorted by, as lists of entries.
    sortable = {f: F.map_entries(f).alias(f) if f in maps else F.col(f) for f in others}
    item = F.struct(F.col(position).isNull().alias("_last"), position, *sortable.values())

    def whole(i: Column, f: str) -> Column:
        return (F.map_from_entries(i[f]) if f in maps else i[f]).alias(f)

    def gathered(df: DataFrame, *by) -> DataFrame:
        found = df.groupBy(key, *by).agg(F.array_sort(F.collect_list(item)).alias("_items"))
        return found.withColumn(name, F.transform("_items", lambda i: F.struct(i[position].alias(position), *[whole(i, f) for f in others])))

    def cut(df: DataFrame) -> DataFrame:
        """Chunks of ordered arrays: a parent's children are sorted where they are gathered, so their ranks are their places."""
        starts = F.posexplode(F.sequence(F.lit(1), F.size(name), F.lit(per_row))).alias("chunk", "_from")
        return df.select(key, name, starts).select(key, F.col("chunk").cast("long").alias("chunk"), F.slice(name, F.col("_from"), F.lit(per_row)).alias(name))

    most = max(per_row, GATHERED)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > most).select(key)
    if large.isEmpty():
        nested = cut(gathered(rows))
    else:
        # A parent with more children than one task should gather needs their ranks from a sort over all of them.
        large = pin(large)
        order = [F.col(position).asc_nulls_last(), *sortable.values()]
        ranked = number_rows(selected(rows, large, key), [key], order, "_rank")
        chunked = gathered(ranked, F.floor((F.col("_rank") - 1) / F.lit(per_row)).alias("chunk")).select(key, "chunk", name)
        nested = chunked.unionByName(cut(gathered(without_removed(rows, large, key))))
    empty = F.array().cast(nested.schema[name].dataType)
    return parents.join(nested, key, "left").withColumns({
        "chunk": F.coalesce("chunk", F.lit(0).cast("long")),
        name: F.coalesce(name, empty),
    })


def emails_with_attachments(emails: DataFrame, attachments: DataFrame, per_row: int = CHILDREN_PER_ROW) -> DataFrame:
    fields = ["attachment_id", "filename", "status", "error_message"]
    return nest_children(emails, attachments, "email_id", "part_index", fields, "attachments", per_row)


def flatten_emails(nested: DataFrame, name: str = "attachments") -> DataFrame:
    """One row per attachment; e-mails with an empty list vanish. Clashing names get ``email_``."""
    child = nested.schema[name].dataType.elementType.fieldNames()
    outer = [
        F.col(c).alias(f"email_{c}" if c in child else c) for c in nested.columns if c not in (name, "chunk")
    ]
    return nested.select(*outer, F.explode(name).alias("_child")).select("*", "_child.*").drop("_child")


def selected(records: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """Ids may repeat; they are made distinct and pinned, so that a hot key of the records can still be split."""
    return records.join(pin(ids.select(key).distinct()), key, "left_semi").select(*records.columns)


def selected_or_all(records: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """The selected records, or all of them when nothing is selected. The ids are pinned, as both questions need them."""
    ids = pin(ids.select(key).distinct())
    return records if ids.isEmpty() else records.join(ids, key, "left_semi").select(*records.columns)


def without_removed(children: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """As ``selected``, the other way round."""
    return children.join(pin(removed.select(key).distinct()), key, "left_anti").select(*children.columns)


def cascade_delete(
    emails: DataFrame, attachments: DataFrame, records: DataFrame, removed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove e-mails by id, then their attachments, then the records of those."""
    gone = attachments.join(removed.select("email_id"), "email_id", "left_semi").select("attachment_id")
    return (
        without_removed(emails, removed, "email_id"),
        without_removed(attachments, removed, "email_id"),
        without_removed(records, gone, "attachment_id"),
    )


def existing_ids(incoming: DataFrame, emails: DataFrame) -> DataFrame:
    """Incoming messages with the id of the stored e-mail of the same message id, if any."""
    known = emails.where(F.col("message_id").isNotNull()).select("message_id", F.col("email_id").alias("known_email_id"))
    return incoming.join(known, "message_id", "left")


def live_over_stored(attachments: DataFrame, latest: DataFrame) -> DataFrame:
    """The status seen in the event feed replaces the stored one."""
    live: Column = F.nullif(F.col("_live"), F.lit(""))
    return (
        attachments.join(latest.select("attachment_id", F.col("status").alias("_live")), "attachment_id", "left")
        .withColumn("status", F.coalesce(live, "status"))
        .drop("_live")
    )


def attachment_with_records(attachments: DataFrame, records: DataFrame) -> DataFrame:
    """Raw text next to each extracted record; attachments without records keep one row. The text is copied
    to every record, as the rows say; ``attachment_documents`` has it once."""
    return attachments.select("attachment_id", "filename", "raw_text").join(
        records.select("attachment_id", "record_id", "record_pos", "dynamic_data", "region", "is_validated"),
        "attachment_id", "left",
    )


def attachment_documents(attachments: DataFrame, records: DataFrame, per_row: int = CHILDREN_PER_ROW) -> DataFrame:
    """Attachments with their raw text and their ordered records as an array: a text is there once per ``per_row`` records.

    Records are nested before they meet the texts, so no text crosses the network more than once
    a chunk, whatever the number of records.
    """
    fields = ["record_pos", "record_id", "dynamic_data", "region", "is_validated"]
    return nest_children(attachments.select("attachment_id", "filename", "raw_text"), records, "attachment_id", "record_pos", fields, "records", per_row)


def list_emails(emails: DataFrame, attachments: DataFrame) -> DataFrame:
    """E-mails newest first, an e-mail's chunks in order."""
    nested = emails_with_attachments(emails, attachments)
    return nested.orderBy(F.col("date_received").desc_nulls_first(), "email_id", "chunk")

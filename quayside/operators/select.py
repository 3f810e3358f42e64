"""Projections, predicates, ordering and limits."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.config_tables import PREVIEW_STATUSES, READY_STATUSES, RECENT_EVENTS
from quayside.functions.text import (
    ColumnLike, col, contains_ignoring_case, header_label, is_blank, or_else,
)


# --- predicates -----------------------------------------------------------------------

def eq(column: str, value) -> Column:
    """Equality with SQL null semantics: comparing with None matches nothing."""
    return F.col(column) == F.lit(value)


def is_in(df: DataFrame, column: str, values: Iterable | DataFrame) -> DataFrame:
    """Membership, as a semi join at every length; an empty list keeps nothing, nulls match nothing.

    Listed values are cast to the column's type, as a comparison with a literal would be.
    """
    kind = df.schema[column].dataType
    if not isinstance(values, DataFrame):
        texts = [(None if v is None else str(v),) for v in values]
        values = df.sparkSession.createDataFrame(texts, "value string")
    wanted = values.toDF(column).select(F.col(column).cast(kind)).distinct()
    return df.join(wanted, column, "left_semi").select(*df.columns)


def where_all(df: DataFrame, predicates: Iterable[Column]) -> DataFrame:
    """All predicates hold; no predicate means no filter."""
    predicates = list(predicates)
    return df.where(reduce(and_, predicates)) if predicates else df


def from_sender(df: DataFrame, sender: str) -> DataFrame:
    return df.where(contains_ignoring_case("sender", sender))


def subject_contains(df: DataFrame, needle: str) -> DataFrame:
    return df.where(contains_ignoring_case("subject", needle))


def drop_blank_text(df: DataFrame, column: str = "raw_text") -> DataFrame:
    return df.where(~is_blank(column))


def only_errors(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "error")


def is_ready(status: ColumnLike = "status") -> Column:
    return col(status).isin(READY_STATUSES)


def is_previewable(status: ColumnLike = "status") -> Column:
    return col(status).isin(PREVIEW_STATUSES)


def non_empty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


# --- projections ----------------------------------------------------------------------

def project(df: DataFrame, columns: str = "*") -> DataFrame:
    """Column list as written in a select clause, ``*`` by default."""
    return df.select(*[name.strip() for name in columns.split(",")])


def draft_payload(records: DataFrame) -> DataFrame:
    return records.select("record_id", "dynamic_data", "region", "attachment_id", "filename")


def grid_columns(superset: ColumnLike) -> Column:
    """Superset without ``region``, each key with its header label."""
    return F.transform(
        F.array_remove(col(superset), "region"),
        lambda key: F.struct(key.alias("key"), header_label(key).alias("header")),
    )


# --- order and limit ------------------------------------------------------------------

def order(df: DataFrame, column: str, desc: bool = False) -> DataFrame:
    """Nulls last ascending, first descending."""
    key = F.col(column)
    return df.orderBy(key.desc_nulls_first() if desc else key.asc_nulls_last())


def limit(df: DataFrame, n: int | None) -> DataFrame:
    """No limit when ``n`` is missing or zero."""
    return df.limit(n) if n else df


def single(df: DataFrame) -> DataFrame:
    return df.limit(1)


def newest_first(emails: DataFrame) -> DataFrame:
    return emails.orderBy(F.col("date_received").desc_nulls_first(), "email_id")


def source_key(collation: str | None = None) -> Column:
    """Sort key of a record's source: file name, or the attachment id where there is none.
    Binary order by default; a collation such as ``UNICODE`` gives a reader's order."""
    key = or_else("filename", F.col("attachment_id").cast("string"), F.lit(""))
    return F.collate(key, collation) if collation else key


def by_source(records: DataFrame, collation: str | None = None) -> DataFrame:
    return records.orderBy(source_key(collation), "attachment_id", "record_pos", "record_id")


def by_filename(attachments: DataFrame) -> DataFrame:
    return attachments.orderBy(F.col("filename").asc_nulls_last(), "attachment_id")


def recent_events(events: DataFrame, n: int = RECENT_EVENTS) -> DataFrame:
    return events.orderBy(F.col("seq").desc()).limit(n)


def first_ready_email(emails: DataFrame) -> DataFrame:
    return newest_first(emails.where(is_ready())).limit(1)

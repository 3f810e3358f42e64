"""Date expressions, independent of the session time zone except for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.functions.text import ColumnLike, col, let

# --- Fixed values: the accepted e-mail date form, `Mon, 1 Jan 2024 10:00:00 +0530` ---------
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MAIL_DATE = (
    r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun),\s+(\d{1,2})\s+(" + "|".join(_MONTHS) + r")\s+(\d{4})\s+"
    r"(\d{1,2}:\d{1,2}:\d{1,2})\s+(?:(?-i:Z)|([+-])(\d\d):?([0-5]\d)(?::?([0-5]\d))?)\z"
)


def mail_date(c: ColumnLike) -> Column:
    """Timestamp of an e-mail date header; null when the text has another form."""
    text = col(c)
    fields = F.split(F.regexp_replace(text, _MAIL_DATE, "$1|$2|$3|$4|$5|$6|$7|$8"), r"\|")
    return F.when(text.rlike(_MAIL_DATE), let(fields, _instant))


def _instant(field: Column) -> Column:
    """Timestamp from day, month, year, time, sign and the offset's hours, minutes, seconds."""
    def number(i: int) -> Column:
        return F.coalesce(F.nullif(field[i], F.lit("")), F.lit("0")).cast("long")

    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(field[1])).cast("string")
    local = F.concat(field[2], F.lit("-"), month, F.lit("-"), field[0], F.lit(" "), field[3], F.lit("+00:00"))
    offset = number(5) * 3600 + number(6) * 60 + number(7)
    signed = F.when(field[4] == "-", -offset).otherwise(offset)
    return F.when(offset < 86400, F.timestamp_seconds(F.unix_seconds(local.try_cast("timestamp")) - signed))


def received_at(c: ColumnLike, now: Column | None = None) -> Column:
    return F.coalesce(mail_date(c), F.current_timestamp() if now is None else now)


def display_date(c: ColumnLike) -> Column:
    return F.date_format(col(c), "dd MMM yyyy")


def display_time(c: ColumnLike) -> Column:
    return F.date_format(col(c), "HH:mm")

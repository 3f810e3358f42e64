"""Text expressions. All run inside the JVM.

Whitespace is the Unicode notion: Java's ``\\s`` under ``(?U)`` plus the four ASCII
separators 1C-1F. Trimming takes a character set, not a pattern, and tag removal stops at
the last ``>``, so one very long text stays linear.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

_SPACE = r"[\s\x1C-\x1F]"

# --- Fixed values: characters that end a word in the report's word count ------------------
_WORD = r"[^\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"

# --- Fixed values: code points that count as whitespace -----------------------------------
WHITESPACE = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))

# --- Fixed values: entities replaced, in this order --------------------------------------
_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a lambda variable is not re-computed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: ColumnLike) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def is_blank(c: ColumnLike) -> Column:
    """Null, empty or whitespace only."""
    return ~F.coalesce(col(c).rlike(r"(?U)[^\s\x1C-\x1F]"), F.lit(False))


def remove_tags(c: ColumnLike, allow_empty: bool = False) -> Column:
    """Replace every ``<...>`` by a blank. ``allow_empty`` also takes ``<>``."""
    text = col(c)
    tail = F.substring_index(text, ">", -1)
    head = F.left(text, F.length(text) - F.length(tail))
    return F.concat(F.regexp_replace(head, "<[^>]*>" if allow_empty else "<[^>]+>", " "), tail)


def html_to_text(c: ColumnLike) -> Column:
    plain = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ENTITIES, remove_tags(c))
    return strip(F.regexp_replace(plain, rf"(?U){_SPACE}{{2,}}", " "))


def word_count(html: ColumnLike) -> Column:
    words = F.regexp_count(remove_tags(html, allow_empty=True), F.lit(_WORD))
    return F.coalesce(words, F.lit(0))


def strip_fences(c: ColumnLike) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)```(?:json)?[\s\x1C-\x1F]*", ""))


def or_else(*values: ColumnLike | Column) -> Column:
    """First value that is neither null nor empty; the last one as it is."""
    columns = [col(v) for v in values]
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in columns[:-1]], columns[-1])


def or_dash(c: ColumnLike) -> Column:
    return or_else(c, F.lit("—"))


def header_label(key: ColumnLike) -> Column:
    return F.upper(F.translate(col(key), "_", " "))


def status_label(status: ColumnLike) -> Column:
    return or_else(F.translate(col(status), "_", " "), F.lit("pending"))


def key_form(key: ColumnLike) -> Column:
    return F.translate(F.lower(col(key)), " ", "_")


def is_message_name(filename: ColumnLike) -> Column:
    return F.lower(col(filename)).endswith(".eml")


def file_stem(filename: ColumnLike) -> Column:
    return F.regexp_replace(col(filename), r"(?i)\.eml\z", "")


def part_filename(filename: ColumnLike, index: ColumnLike) -> Column:
    return or_else(filename, F.format_string("attachment_%03d.eml", col(index)))


def prefix(c: ColumnLike, n: int) -> Column:
    return F.substring(col(c), 1, n)


def remainder_length(c: ColumnLike, n: int) -> Column:
    return F.greatest(text_length(c) - F.lit(n), F.lit(0))


def text_length(c: ColumnLike) -> Column:
    return F.coalesce(F.length(col(c)), F.lit(0))


def count_char(c: ColumnLike, char: str) -> Column:
    text = col(c)
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def join_non_empty(separator: str, values: Column) -> Column:
    return F.array_join(F.filter(values, lambda v: v != ""), separator)


def plural(n: ColumnLike, suffix: str = "s") -> Column:
    return F.when(col(n) != 1, F.lit(suffix)).otherwise(F.lit(""))


def escape_html(c: ColumnLike) -> Column:
    steps = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), steps, col(c))


def contains_ignoring_case(c: ColumnLike, needle: str) -> Column:
    return F.contains(F.lower(col(c)), F.lit(needle.lower()))

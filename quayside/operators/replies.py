"""From noisy model replies to record rows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.ids import stable_id
from quayside.functions.maps import normalise_keys, split_region
from quayside.functions.text import ColumnLike, col, let
from quayside.session import pin

PARSED = "strategy string, elements array<string>"


def build_requests(attachments: DataFrame, head: str, tail: str, chars: int) -> DataFrame:
    """Prompts (attachment_id, chunk, prompt) over the whole text, ``chars`` characters each.

    Every attachment has a chunk 0, also without text; the chunks' texts joined in order are the
    text.
    """
    text = F.coalesce("raw_text", F.lit(""))
    count = F.greatest(F.ceil(F.length(text) / F.lit(chars)), F.lit(1)).cast("int")
    cut = attachments.select("attachment_id", text.alias("_text"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    part = F.substring("_text", F.col("chunk") * chars + 1, F.lit(chars))
    return cut.select("attachment_id", "chunk", F.concat(F.lit(head), part, F.lit(tail)).alias("prompt"))


# --- array recovery: strict JSON in Python, because Spark's reader accepts trailing text ----

# Fixed value: what opens or closes a fenced block in a reply.
_FENCE = re.compile(r"```(?:json)?\s*")


def _list_in(text: str) -> list | None:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, list) else None


def _bracket_spans(text: str):
    """Each ``[`` with the nearest ``]`` after it, left to right, without overlap."""
    start = text.find("[")
    while start >= 0:
        end = text.find("]", start)
        if end < 0:
            return
        yield text[start:end + 1]
        start = text.find("[", end)


def _recover(reply: str | None, mode: str) -> tuple[str, list]:
    text = _FENCE.sub("", reply or "")
    start, end = text.find("["), text.rfind("]")
    whole = _list_in(text[start:end + 1]) if 0 <= start < end else None
    if whole is not None:
        return "outermost", whole
    if mode == "first":
        first = next(_bracket_spans(text), None)
        found = _list_in(first) if first is not None else None
        return ("first", found) if found is not None else ("none", [])
    merged = [item for span in _bracket_spans(text) for item in _list_in(span) or []]
    if merged:
        return "merged", merged
    if start >= 0:
        rest = text[start:].rstrip()
        rest += "}" * (rest.count("{") - rest.count("}"))
        closed = _list_in(rest if rest.endswith("]") else rest + "]")
        if closed:
            return "closed", closed
    return "none", []


def _element_json(item) -> str:
    """Element as JSON with every value as text, in Python's ``str`` form; the region keeps its type.
    One nested too deeply to write becomes ``null``, which is no object and so a reject."""
    try:
        if isinstance(item, dict):
            item = {k: v if isinstance(v, str) or k == "region" else str(v) for k, v in item.items()}
        return json.dumps(item)
    except RecursionError:
        return "null"


def _parser(mode: str):
    @F.pandas_udf(PARSED)
    def parse(replies: pd.Series) -> pd.DataFrame:
        found = [_recover(reply, mode) for reply in replies]
        return pd.DataFrame({
            "strategy": [strategy for strategy, _ in found],
            "elements": [[_element_json(item) for item in items] for _, items in found],
        })

    # Keeps the optimizer from parsing again in every filter and projection on the result.
    return parse.asNondeterministic()


def parse_reply(content: ColumnLike, mode: str = "all") -> Column:
    """Struct (strategy, elements): the JSON array found in a reply, one JSON text per element.

    ``all`` tries the outermost brackets, then merges every small array that parses, then
    closes a cut-off array. ``first`` (retry) stops after the first small array.
    """
    if mode not in ("all", "first"):
        raise ValueError(f"unknown mode {mode!r}")
    return _parser(mode)(col(content))


def is_object(element: Column) -> Column:
    return F.startswith(element, F.lit("{"))


# --- attempts -------------------------------------------------------------------------------

def resolve_attempts(replies: DataFrame, compat: bool = True) -> DataFrame:
    """First attempt that did not fail, and the error still standing at that point.

    All attempts count, whatever their numbers. Of several rows with one attempt number the one that did
    not fail counts, and of those the one with the smallest content. With ``compat`` an error
    raised before the successful attempt stays recorded, as it decides the status of an empty
    result; otherwise success clears it.
    """
    tries = replies.where(F.col("attempt").isNotNull()).select("attachment_id", "attempt", "content", "error")
    ok = F.col("error").isNull()
    numbers = pin(tries.groupBy("attachment_id").agg(F.min(F.when(ok, F.col("attempt"))).alias("won")))
    won = F.col("won").isNotNull()
    best = tries.where(ok).join(numbers.where(won), "attachment_id").where("attempt = won").groupBy("attachment_id").agg(
        F.min(F.coalesce("content", F.lit(""))).alias("content"))
    failed = tries.where(~ok).join(numbers, "attachment_id").where("won is null or attempt < won")
    standing = failed.groupBy("attachment_id").agg(F.max(F.struct("attempt", "error"))["error"].alias("last_error"))
    out = numbers.join(best, "attachment_id", "left").join(standing, "attachment_id", "left")
    last_error = F.col("last_error") if compat else F.when(~won, F.col("last_error"))
    return out.select("attachment_id", "content", last_error.alias("last_error"))


# --- records --------------------------------------------------------------------------------

def parsed_attempts(resolved: DataFrame, on_bad: str = "reject") -> DataFrame:
    """Parse resolved replies: adds ``elements``, ``strategy``, ``record_count``, ``status``.

    ``on_bad`` says what an element that is not an object does: ``reject`` leaves only it out;
    ``stop`` keeps the elements before it and leaves the attachment in ``extracting``.
    """
    parsed = resolved.withColumn("_p", parse_reply("content")).select(
        "attachment_id", "last_error", F.col("_p.strategy").alias("strategy"), F.col("_p.elements").alias("elements")
    )
    failed = (F.size("elements") == 0) & (F.coalesce("last_error", F.lit("")) != "")
    first_bad = F.array_position(F.transform("elements", is_object), False).cast("int")
    if on_bad == "stop":
        kept = F.when(first_bad > 0, F.slice("elements", F.lit(1), first_bad - 1)).otherwise(F.col("elements"))
        status = F.when(failed, "error").when(first_bad > 0, "extracting").otherwise("done")
        count = F.when(first_bad > 0, 0).otherwise(F.size("elements"))
    elif on_bad == "reject":
        kept, status = F.col("elements"), F.when(failed, "error").otherwise("done")
        count = F.size(F.filter("elements", is_object))
    else:
        raise ValueError(f"unknown on_bad {on_bad!r}")
    return parsed.select(
        "attachment_id", "strategy", kept.alias("elements"), status.alias("status"),
        F.when(status == "error", F.col("last_error")).alias("error_message"), count.alias("record_count"),
    )


def _elements(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return parsed.select("attachment_id", *(keep or []), F.posexplode("elements").alias("record_pos", "element"))


def rejected_elements(parsed: DataFrame) -> DataFrame:
    return _elements(parsed).where(~is_object(F.col("element")))


def records_from_replies(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One record row per object element; region split off, keys normalised."""
    raw = _elements(parsed, keep).where(is_object(F.col("element"))).withColumn(
        "_m", F.from_json("element", "map<string,string>")
    )
    region, rest = split_region("_m")
    return raw.select(
        stable_id("attachment_id", "record_pos").alias("record_id"), "attachment_id", "record_pos",
        let(rest, normalise_keys).alias("dynamic_data"), region.alias("region"),
        F.lit(False).alias("is_validated"), *(keep or []),
    )


def retry_results(replies: DataFrame) -> DataFrame:
    """First attempt with an object in its array (retry rules), per attachment that has one.

    The parsed tries are pinned; the winning numbers are found on them without their texts, and
    the elements of the winners are fetched once. Of several winners with one attempt number the one
    with the smallest elements counts.
    """
    tried = replies.where(F.col("error").isNull() & F.col("attempt").isNotNull())
    parsed = pin(tried.select("attachment_id", "attempt", parse_reply("content", "first").alias("_p")).select(
        "attachment_id", "attempt", F.col("_p.strategy").alias("strategy"), F.col("_p.elements").alias("elements")
    ).where(F.exists("elements", is_object)))
    first = pin(parsed.groupBy("attachment_id").agg(F.min("attempt").alias("attempt")))
    found = parsed.join(first, ["attachment_id", "attempt"])
    return found.groupBy("attachment_id").agg(F.min(F.struct("elements", "strategy")).alias("_p")).select(
        "attachment_id", F.col("_p.strategy").alias("strategy"), F.col("_p.elements").alias("elements")
    )

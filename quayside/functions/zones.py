"""First-match zone classification as one CASE expression: no shuffle, no lookup table to ship."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.config_tables import UNSPECIFIED, ZONE_RULES, ZONES
from quayside.functions.text import ColumnLike, col, let, strip

Rules = list[tuple[int, str, str]]


def _first_true(cases: list[tuple[Column, str]]) -> Column:
    chain = F.when(cases[0][0], F.lit(cases[0][1]))
    for condition, zone in cases[1:]:
        chain = chain.when(condition, F.lit(zone))
    return chain.otherwise(F.lit(UNSPECIFIED))


def _touches(place: Column, keywords: list[str]) -> Column:
    """Some keyword is inside the place, or has the place inside it.

    The first test loops over a constant array: the same tests written out would make one method
    too long for the JVM to compile. The second takes all keywords as one text, one per line; a
    place with a line break is inside no keyword.
    """
    inside = F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(place, k))
    around = F.contains(F.lit("\n".join(keywords)), place) & ~F.contains(place, F.lit("\n"))
    return inside | around


def place_of(region: ColumnLike) -> Column:
    return F.lower(strip(region))


def zone_of_place(place: ColumnLike, mode: str = "compat", rules: Rules = ZONE_RULES) -> Column:
    """Zone of a trimmed, lower-cased place.

    ``compat``: the first rule, in priority order, that touches the place. Neighbouring rules of
    one zone are decided together.
    ``word``: the longest keyword that occurs as whole words.
    """
    text = col(place)
    if mode == "compat":
        runs = groupby(sorted(rules), key=lambda rule: rule[2])
        return _first_true([(_touches(text, [k for _, k, _ in run]), zone) for zone, run in runs])
    if mode == "word":
        ordered = sorted(rules, key=lambda rule: (-len(rule[1]), rule[0]))
        return _first_true([(text.rlike(rf"(?U)(?<!\w){re.escape(k)}(?!\w)"), z) for _, k, z in ordered])
    raise ValueError(f"unknown mode {mode!r}")


def zone_or_default(region: ColumnLike, zone: Column) -> Column:
    """A missing or empty region has no zone; one of blanks only has been matched."""
    text = col(region)
    return F.when(text.isNull() | (text == ""), F.lit(UNSPECIFIED)).otherwise(zone)


def zone_of(region: ColumnLike, mode: str = "compat", rules: Rules = ZONE_RULES) -> Column:
    """Zone of a free-text region."""
    return zone_or_default(region, let(place_of(region), lambda place: zone_of_place(place, mode, rules)))


def zone_position(zone: ColumnLike) -> Column:
    """0-based display position; unknown zones come after all known ones."""
    found = F.array_position(F.array(*[F.lit(name) for name, _, _ in ZONES]), col(zone)).cast("int")
    return F.when(found > 0, found - 1).otherwise(F.lit(len(ZONES)))


def zone_coordinate(zone: ColumnLike, axis: str) -> Column:
    """``lat`` or ``lng`` of a zone from the fixed list, 0 for an unknown one. Eight constants need no join."""
    pairs = [F.lit(x) for name, lat, lng in ZONES for x in (name, lat if axis == "lat" else lng)]
    return F.coalesce(F.create_map(*pairs)[col(zone)], F.lit(0.0))

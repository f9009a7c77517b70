"""Readable labels for codes and column names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, units and acronyms -----------------------------------
CODE_LABELS = {
    "cbd": "CBD",
    "ring": "Ring",
    "control": "Control",
    "treated": "Treated",
    "ring_adjacent": "Ring, adjacent",
    "ring_across": "Ring, across water",
    "control_near": "Control, near",
    "control_far": "Control, far",
    "all": "All",
    "overnight": "Overnight",
    "midday": "Midday",
    "evening": "Evening",
    "raw": "Raw",
    "dropoff_after_pickup": "Drop-off after pickup",
    "all rules": "All rules",
    "driver_pay": "Driver pay ($)",
    "trip_miles": "Trip distance (mi)",
    "trip_minutes": "Trip time (min)",
    "trips": "Trips",
    "year": "Year",
    "month": "Month",
}
UNITS = {
    "pct": "%",
    "ft": "ft",
    "mm": "mm",
    "mph": "mph",
    "min": "min",
    "gb": "GB",
    "mb": "MB",
}
ACRONYMS = {"cbd": "CBD", "id": "ID", "nyc": "NYC"}
# End of fixed values --------------------------------------------------------


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(text) for pair in mapping.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def heading(name: Column) -> Column:
    """A column name as a heading, with a trailing unit in brackets."""
    words = F.split(name, "_")
    unit = F.when(F.size(words) > 1, _lookup(UNITS, F.lower(F.element_at(words, -1))))
    body = F.when(unit.isNotNull(), F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    spelled = F.transform(body, lambda word: F.coalesce(_lookup(ACRONYMS, F.lower(word)), word))
    text = F.array_join(spelled, " ")
    text = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))
    plain = F.when(unit.isNotNull(), F.concat(text, F.lit(" ("), unit, F.lit(")"))).otherwise(text)
    return F.coalesce(_lookup(CODE_LABELS, name), plain)


def value_label(value: Column) -> Column:
    """A label for code values; other text stays as it is."""
    is_code = value.rlike("^[a-z0-9]+(_[a-z0-9]+)+$") | _lookup(CODE_LABELS, value).isNotNull()
    return F.when(is_code, heading(value)).otherwise(value)


def split_term(term: Column) -> tuple[Column, Column]:
    """Group and term of a coefficient name.

    ``treated_after`` is (treated, all), ``time_band::midday:ring_after`` is
    (ring, midday) and ``treated:trend`` is (treated, trend).
    """
    after = r"^(?:time_band::(\w+):)?(\w+)_after$"
    is_after = term.rlike(after)
    band = F.regexp_extract(term, after, 1)
    group = F.when(is_after, F.regexp_extract(term, after, 2)).otherwise(F.split(term, ":")[0])
    name = (
        F.when(is_after & (band == ""), "all")
        .when(is_after, band)
        .otherwise(F.try_element_at(F.split(term, ":"), F.lit(2)))
    )
    return group, name

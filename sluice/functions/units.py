"""Which unit a text that looks like a point in time is in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.tokens import INTEGER, Trimmed, parse_datetime, trim

UNITS = ("s", "ms", "us", "ns")
_CLOCK = r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
OFFSET_FORM = rf"^([0-9]{{1,4}}-[0-9]{{1,2}}-[0-9]{{1,2}})[ T]({_CLOCK})(\.[0-9]+)?[+-][0-9]{{2}}:?[0-9]{{2}}$"
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def fraction_digits(v: Column) -> Column:
    """Digits after the first point, NULL without."""
    n = F.length(F.regexp_extract(trim(v), r"^[^.]*\.([0-9]*)", 1))
    return F.when(n > 0, n)


def unit_of_precision(n: Column) -> Column:
    return F.when(n >= 9, "ns").when(n >= 6, "us").when(n >= 3, "ms").otherwise("s")


def is_datetime(v: Column) -> Column:
    """Any zone-less form, or one with an offset (up to 23:59) whose clock part is valid."""
    t = trim(v)
    zoned = t.rlike(OFFSET_FORM) | t.rlike(RFC3339)
    local = F.regexp_replace(F.regexp_replace(t, r"([Zz]|[+-][0-9]{2}:?[0-9]{2})$", ""), "t", "T")
    minutes = F.coalesce(F.regexp_extract(t, r"[+-]([0-9]{2}):?([0-9]{2})$", 2).try_cast("int"), F.lit(0))
    hours = F.coalesce(F.regexp_extract(t, r"[+-]([0-9]{2}):?([0-9]{2})$", 1).try_cast("int"), F.lit(0))
    return parse_datetime(Trimmed(t)).isNotNull() | (zoned & parse_datetime(Trimmed(local)).isNotNull() & (minutes < 60) & (hours < 24))


def datetime_unit(v: Column) -> Column:
    return F.when(is_datetime(v), unit_of_precision(F.coalesce(fraction_digits(v), F.lit(3))))


def whole_number(v: Column) -> tuple[Column, Column, Column]:
    """(fits a signed 128-bit number, is below zero, its digits without leading zeros)."""
    t = trim(v)
    digits = F.regexp_replace(t, r"^[+-]?0*", "")
    below = t.startswith("-") & (digits != "")
    top = F.when(below, F.lit("170141183460469231731687303715884105728")).otherwise(F.lit("170141183460469231731687303715884105727"))
    return t.rlike(INTEGER) & ((F.length(digits) < 39) | ((F.length(digits) == 39) & (digits <= top))), below, digits


def beyond(digits: Column, most: int) -> Column:
    """Whether a number's digits make more than `most`."""
    text = str(most)
    return (F.length(digits) > len(text)) | ((F.length(digits) == len(text)) & (digits > text))


def epoch_unit(v: Column) -> Column:
    """By magnitude; of whole numbers."""
    fits, _, digits = whole_number(v)
    return F.when(fits, F.when(F.length(digits) <= 11, "s").when(F.length(digits) <= 14, "ms").when(F.length(digits) <= 17, "us").otherwise("ns"))


def timestamp_unit(v: Column) -> Column:
    return F.coalesce(datetime_unit(v), epoch_unit(v))

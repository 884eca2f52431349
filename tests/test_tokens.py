import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.functions import tokens, units


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


@pytest.mark.parametrize("values, want", [
    (["", " ", "NULL", "NaN", "n/a", "\tNA ", " none ", None], True),
    (["0", "false", "nil", "-", "nul"], False),
])
def test_null_words(spark, values, want):
    assert apply(spark, tokens.is_null_token, values) == [want] * len(values)


def test_bool(spark):
    got = apply(spark, tokens.parse_bool, ["true", "FALSE", "1", "0", "yes", "no", "maybe", " On ", "off", "t", "F", "Y", "n", "", None])
    assert got == [True, False, True, False, True, False, None, True, False, True, False, True, False, None, None]


def test_integers(spark):
    values = ["3.5", "+7", "-1", "18446744073709551615", "18446744073709551616", "9223372036854775808", "-9223372036854775808", "1e3", "-0", "0" * 40 + "5", "", "1 2"]
    assert apply(spark, tokens.parse_int, values) == [None, 7, -1, None, None, None, -(2**63), None, 0, 5, None, None]
    assert apply(spark, tokens.parse_uint, values) == [None, Decimal(7), None, Decimal(2**64 - 1), None, Decimal(2**63), None, None, Decimal(0), Decimal(5), None, None]


def test_floats(spark):
    values = ["1d", "1.5f", "0x1p3", "inf", "-nan", "1e400", ".5", "5.", "+1E2", ".", "1e", " 2 "]
    assert apply(spark, tokens.parse_float, values) == [None, None, None, None, None, None, 0.5, 5.0, 100.0, None, None, 2.0]


def test_dates(spark):
    values = ["1970-01-01", "02/01/1970", "invalid", "01/13/2024", "13/01/2024", "01/02/2024", "1/2/24", "2023-02-29", "2024", "2024-01-01 ", "2024-01-01T00:00:00", "2024-001-01"]
    d = dt.date
    assert apply(spark, tokens.parse_date, values) == [d(1970, 1, 1), d(1970, 1, 2), None, d(2024, 1, 13), d(2024, 1, 13), d(2024, 2, 1), d(24, 2, 1), None, None, d(2024, 1, 1), None, None]


def test_timestamps(spark):
    values = {
        "1970-01-01 00:00:01": 1000, "1000000000": 10**12, "invalid": None, "1970-01-01T00:00:00.9999": 999, "1970-01-01 00:00:00.1": 100,
        "02/01/1970 00:00:00": 86400000, "1970/01/02 00:00:00": 86400000, "02/01/1970 00:00:00.5": None, "1970-01-01T00:00:00Z": None,
        "1970-01-01 24:00:00": None, "1970-01-01 00:00:60": 60000, "1970-01-01 00:00:60.5": 60500, "1970-01-01 00:00:61": None, "1970-01-01": None,
        "999999999": None, "3999999999": 3999999999000, "4000000000": None, "1500000000123": 1500000000123, "1500000000123456": 1500000000123,
        "1500000000123456789": 1500000000123, "-1500000000": None, "0": None, "1969-12-31 23:59:59.5": -500,
    }
    assert apply(spark, tokens.parse_timestamp_ms, list(values)) == list(values.values())


def test_unit_scaling_goes_toward_1970(spark):
    out = spark.range(1).select(tokens.scale_unit(F.lit("1969-12-31 23:59:58.5").cast("timestamp_ntz"), "s").alias("x")).first()[0]
    assert out == dt.datetime(1969, 12, 31, 23, 59, 59)


def test_units(spark):
    day = "2024-01-01"
    values = {
        f"{day} 10:11:12": "ms", f"{day}T10:11:12.5": "s", f"{day}T10:11:12.50": "s", f"{day}T10:11:12.500": "ms", f"{day}T10:11:12.500000": "us", f"{day}T10:11:12.500000000": "ns",
        f"{day}T10:11:12Z": "ms", f"{day} 10:11:12.123456+02:00": "us", f"{day}T10:11:12-0530": "ms", f"{day}T10:11:12+25:00": None, f"{day} 10:61:12": None, "12:34:56": None,
        "-1234567": "s", "-123456789012": "ms", "-123456789012345": "us", "-123456789012345678": "ns", "abc-defgh": None, "01/02/2024 10:00:00": "ms",
    }
    assert apply(spark, units.timestamp_unit, list(values)) == list(values.values())


def test_128_bit_limits(spark):
    top = 2**127 - 1
    got = apply(spark, lambda v: units.whole_number(v)[0], [str(top), str(top + 1), str(-top - 1), str(-top - 2), "00" + str(top)])
    assert got == [True, False, True, False, True]


def test_text_keeps_its_white_space(spark):
    assert apply(spark, lambda v: tokens.cast_to(v, "text"), [" a ", "None", ""]) == [" a ", None, None]
    assert apply(spark, lambda v: tokens.cast_to(v, "binary"), [" é"]) == [bytearray(" é".encode())]

import pytest
from pyspark.sql import functions as F

from sluice.operators.profile import infer_kinds, profile

CASES = {
    "ints": (["1", "4", "7"], "uint64"), "signed": (["-1", "4"], "int64"), "zero_one": (["0", "1", "1"], "boolean"), "letters": (["Y", "N", "T"], "boolean"),
    "floats": (["3.14", "2"], "float64"), "dates": (["2024-01-01", "13/01/2024"], "date32"), "all_null": (["NA", "", "none"], "text"), "infs": (["inf", "infinity"], "float64"),
    "neg8": (["-1234567", "-2345678"], "timestamp[s]"), "neg7": (["-123456", "-234567"], "int64"), "zoned": (["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00"], "timestamp[ms]"),
    "epoch": (["1700000000"], "uint64"), "u64_max": (["18446744073709551615"], "uint64"), "over_u64": (["18446744073709551616"], "float64"), "neg_and_u64": (["-1", "18446744073709551615"], "float64"),
    "micro": (["2024-01-01 00:00:00.123456"] * 2 + ["2024-01-01 00:00:00"], "timestamp[us]"), "tie_ms_s": (["2024-01-01 00:00:00.1", "2024-01-01 00:00:00"], "timestamp[ms]"),
    "tie_s_us": (["2024-01-01 00:00:00.1", "2024-01-01 00:00:00.123456"], "timestamp[s]"), "clock": (["12:34:56"], "text"), "mixed": (["2024-01-01", "2024-01-01 00:00:00"], "text"),
    "decimal": (["0.3183098862"], "float64"), "bad_dates_5": (["2024-01-01"] * 995 + ["x"] * 5, "date32"), "bad_dates_6": (["2024-01-01"] * 994 + ["x"] * 6, "text"),
    "bad_numbers_20": (["7"] * 980 + ["x"] * 20, "uint64"), "bad_numbers_21": (["7"] * 979 + ["x"] * 21, "text"), "nulls_do_not_count": (["NA"] * 50 + ["5"], "uint64"),
}


@pytest.fixture(scope="module")
def kinds(spark):
    names = list(CASES)
    rows = [(n, v) for n in names for v in CASES[n][0]]
    df = spark.createDataFrame(rows, "name string, v string")
    wide = df.select(*[F.when(F.col("name") == n, F.col("v")).alias(n) for n in names])
    return dict(zip(names, infer_kinds(wide), strict=True))


@pytest.mark.parametrize("name", list(CASES))
def test_kind(kinds, name):
    assert kinds[name] == CASES[name][1]


def test_counters(spark):
    df = spark.createDataFrame([("1",), ("-9223372036854775809",), ("1.5",), ("NA",), ("x",)], "a string")
    r = profile(df).first()
    assert (r["n"], r["bool_ok"], r["f64_ok"], r["i128_ok"], r["float_syntax"], r["negative"], r["below_i64"], r["above_i64"]) == (4, 1, 3, 2, True, True, True, False)


def test_profile_shuffles_one_row_per_column_and_task(spark):
    plan = profile(spark.range(10).selectExpr("cast(id as string) a", "'x' b"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan


def test_seventeen_columns(spark):
    """The generated fixture's columns, each a function of the row's number."""
    i = "id"
    cols = {
        "Boolean": ("CASE WHEN id % 2 = 0 THEN 'True' ELSE 'False' END", "boolean"), "Int32": (f"cast({i} as string)", "uint64"), "Int64": ("cast(id * 1000 as string)", "uint64"),
        "UInt32": ("cast(id as string)", "uint64"), "UInt64": ("cast(id * 10000 as string)", "uint64"), "Float16": ("cast(cast(id * 0.5 as decimal(12,1)) as string)", "float64"),
        "Float32": ("cast(cast(id * 0.1 as decimal(12,1)) as string)", "float64"), "Float64": ("cast(cast(id * 0.0001 as decimal(12,4)) as string)", "float64"), "Utf8": ("concat('texte_', id)", "text"),
        "Utf8View": ("concat('vue_', id)", "text"), "LargeUtf8": ("concat('texte_long_', id, 'texte_long_', id)", "text"), "Binary": ("concat('bin_', id)", "text"),
        "Date32": ("cast(date_add(date'2024-01-01', cast(id % 10000 as int)) as string)", "date32"),
        "Timestamp(Millisecond, None)": ("date_format(timestampadd(MILLISECOND, id * 5, timestamp_ntz'2024-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss.SSS\")", "timestamp[ms]"),
        "Timestamp(Nanosecond, None)": ("date_format(timestampadd(SECOND, id % 86400, timestamp_ntz'2024-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss\")", "timestamp[ms]"),
        "Decimal32": ("cast(cast(id / 10 as decimal(12,2)) as string)", "float64"), "Decimal128(38, 10)": ("cast(cast(id / 3.1415926535 as decimal(38,10)) as string)", "float64"),
    }
    df = spark.range(1000).select(*[F.expr(e).alias(n) for n, (e, _) in cols.items()])
    assert infer_kinds(df) == [k for _, k in cols.values()]

"""Column profile and type decision.

The profile is one aggregate over all columns: mergeable counters, so partial aggregation runs before the only
shuffle, of one row per task. The decision takes the counters of a column, on the driver or as an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import tokens, units

COUNTERS = ("n", "bool_ok", "date_ok", "ts_s", "ts_ms", "ts_us", "ts_ns", "f64_ok", "i128_ok")
FLAGS = ("float_syntax", "negative", "below_i64", "above_i64", "above_u64")
#: The least shares of values that must parse.
STRICT, NUMERIC = 0.995, 0.98
_I64 = 2**63 - 1


def observe(values: DataFrame) -> DataFrame:
    """position and, for each counter and flag, whether a trimmed value t (no NULL word) adds to it.

    In layers, so that each pattern is matched once per value.
    """
    t = tokens.Trimmed(F.col("t"))
    c = t.column
    one = values.select("position", "t", c.rlike(tokens.INTEGER).alias("is_int"), c.rlike(tokens.FLOAT).alias("is_float"), ((F.octet_length(c) >= 8) & c.rlike("[-:T]")).alias("like_time"), (F.octet_length(c) <= 10).alias("short"))
    fits, below, digits = units.whole_number(t)
    unit = F.when(F.col("like_time"), units.timestamp_unit(t))
    two = one.select("*", unit.alias("unit"), F.when(F.col("is_int"), digits).alias("digits"), (F.col("is_int") & fits).alias("i128_ok"), (F.col("is_int") & below).alias("below"))
    d = F.col("digits")
    up, down = F.col("i128_ok") & ~F.col("below"), F.col("i128_ok") & F.col("below")
    flags = {
        "n": F.lit(True), "bool_ok": tokens.parse_bool(t).isNotNull(), "date_ok": F.col("short") & tokens.parse_date(t).isNotNull(),
        **{f"ts_{u}": F.col("unit") == u for u in units.UNITS},
        "f64_ok": F.col("is_float"), "i128_ok": F.col("i128_ok"), "float_syntax": F.col("is_float") & c.rlike("[.eE]"),
        "negative": down, "below_i64": down & units.beyond(d, _I64 + 1), "above_i64": up & units.beyond(d, _I64), "above_u64": up & units.beyond(d, 2**64 - 1),
    }
    return two.select("position", *[F.coalesce(x, F.lit(False)).alias(k) for k, x in flags.items()])


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: position, column_name, counters and flags.

    Values are taken by (column, value), so the generated code doesn't grow with the number of columns; each task
    hands on one row per column.
    """
    columns = df.columns if columns is None else columns
    if not columns:
        raise ValueError("no columns to profile")
    each = F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)])
    values = df.select(F.explode(each).alias("x")).select("x.position", tokens.trim(F.col("x.v")).alias("t"))
    values = values.filter(~tokens.is_null_token(tokens.Trimmed(F.col("t"))))
    got = observe(values).groupBy("position").agg(*[F.count_if(k).alias(k) for k in COUNTERS], *[F.bool_or(k).alias(k) for k in FLAGS])
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("position", "column_name"))
    zero = [F.coalesce(F.col(k), F.lit(0)).alias(k) for k in COUNTERS] + [F.coalesce(F.col(k), F.lit(False)).alias(k) for k in FLAGS]
    return names.join(got, "position", "left").select("position", "column_name", *zero)


def kind_of(ratio=None) -> Column:
    """The decision as an expression over a profile's columns."""
    c = F.col
    share = lambda x: F.when(c("n") == 0, 0.0).otherwise(x / c("n"))
    stamps = c("ts_s") + c("ts_ms") + c("ts_us") + c("ts_ns")
    # more than milliseconds have is asked of the others, in this order
    unit = F.when((c("ts_s") > c("ts_ms")) & (c("ts_s") >= F.greatest("ts_us", "ts_ns")), "s").when((c("ts_us") > F.greatest("ts_ms", "ts_s")) & (c("ts_us") >= c("ts_ns")), "us").when(c("ts_ns") > F.greatest("ts_ms", "ts_s", "ts_us"), "ns").otherwise("ms")
    whole = F.when(c("below_i64") | c("above_u64"), "float64").when(~c("negative"), "uint64").when(~c("above_i64"), "int64").otherwise("float64")
    return (
        F.when(c("n") == 0, "text")
        .when(share(stamps) >= STRICT, F.concat(F.lit("timestamp["), unit, F.lit("]")))
        .when(share(c("date_ok")) >= STRICT, "date32")
        .when(share(c("bool_ok")) >= STRICT, "boolean")
        .when((share(c("f64_ok")) >= NUMERIC) & (c("float_syntax") | (share(c("i128_ok")) < NUMERIC)), "float64")
        .when(share(c("f64_ok")) >= NUMERIC, whole)
        .otherwise("text")
    )


def infer(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """position, column_name, kind."""
    return profile(df, columns).select("position", "column_name", kind_of().alias("kind"))


def infer_kinds(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """The kinds, on the driver: one row per column."""
    return [r["kind"] for r in sorted(infer(df, columns).collect(), key=lambda r: r["position"])]


def head(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The first rows in scan order, as a small local table."""
    return df.sparkSession.createDataFrame(df.take(rows), df.schema)

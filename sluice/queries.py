"""Queries over the driver tables and their SQL.

The tables are clean, so dirty text is made from the keys, by one expression that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import tokens, units
from sluice.operators import profile as prof
from sluice.operators.typed import parse_lines, split_lines, typed_projection
from sluice.plans.convert import convert
from sluice.plans.convert import ragged_rows as shown_ragged
from sluice.shared import scratch_path
from sluice.sources.dialect import delimiter_of
from sluice.sources.scan import line_count, read_delimited
from sluice.types import ColumnSpec


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: str, values: list[str], other: str) -> str:
    return f"CASE {key} % {len(values) + 1} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {other} END"


def _q(*values: str) -> list[str]:
    return [f"'{v}'" for v in values]


_TRIM = r"regexp_replace(v, '^\s+|\s+$', '', 'g')"
_INT = "regexp_full_match(t, '[+-]?[0-9]+')"
_FLOAT = r"regexp_full_match(t, '(?i)[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)')"
_NULL = "(t = '' OR lower(t) IN ('null', 'none', 'nan', 'n/a', 'na'))"
_BOOL = "CASE WHEN lower(t) IN ('true', '1', 't', 'y', 'yes', 'on') THEN true WHEN lower(t) IN ('false', '0', 'f', 'n', 'no', 'off') THEN false END"
_DATE = r"CASE WHEN regexp_full_match(t, '[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}') THEN CAST(try_strptime(t, '%Y-%m-%d') AS DATE) WHEN regexp_full_match(t, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{1,4}') THEN CAST(try_strptime(t, ['%d/%m/%Y', '%m/%d/%Y']) AS DATE) END"
_U64 = "CAST('18446744073709551615' AS HUGEINT)"
_STAMP_FORM = r"([0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}[ T]|[0-9]{1,2}/[0-9]{1,2}/[0-9]{1,4} |[0-9]{1,4}/[0-9]{1,2}/[0-9]{1,2} )[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
_STAMP = rf"""CASE WHEN regexp_full_match(t, '{_STAMP_FORM}(\.[0-9]+)?') AND NOT (t LIKE '%/%' AND t LIKE '%.%')
  THEN epoch_ms(try_strptime(split_part(t, '.', 1), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%d/%m/%Y %H:%M:%S', '%Y/%m/%d %H:%M:%S']))
    + CAST(rpad(substr(regexp_extract(t, '\.([0-9]+)$', 1), 1, 3), 3, '0') AS BIGINT) END"""
_EPOCH = f"""CASE WHEN {_INT} THEN CASE WHEN TRY_CAST(t AS HUGEINT) BETWEEN 1000000000 AND 3999999999 THEN CAST(t AS BIGINT) * 1000
  WHEN TRY_CAST(t AS HUGEINT) BETWEEN 1000000000000 AND 3999999999999 THEN CAST(t AS BIGINT)
  WHEN TRY_CAST(t AS HUGEINT) BETWEEN 1000000000000000 AND 3999999999999999 THEN CAST(t AS BIGINT) // 1000
  WHEN TRY_CAST(t AS HUGEINT) >= 1000000000000000000 THEN CAST(CAST(t AS HUGEINT) // 1000000 AS BIGINT) END END"""

# --- scalar parsers -------------------------------------------------------------------------------------------

_NULLS = _case("o_orderkey", _q(" NA ", "None", "n/a", "nan", "", "  ", "NULL", "nil", "0", " x "), "o_orderpriority")


def null_tokens(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_NULLS} AS v")
    return d.select("o_orderkey", tokens.is_null_token(F.col("v")).alias("is_null"), tokens.parse_text(F.col("v")).alias("text_value"))


_BOOLS = _case("(l_orderkey * 7 + l_linenumber)", _q("yes", " OFF ", "on", "T", "maybe", "0", "1", "False", "n", "2", ""), "l_returnflag")


def parse_bool(spark, sf_dir):
    d = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_BOOLS} AS v")
    return d.select("l_orderkey", "l_linenumber", tokens.parse_bool(F.col("v")).alias("flag"))


_INTS = _case("o_orderkey", _q("3.5", "+7", "-1", "18446744073709551615", "18446744073709551616", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "-9223372036854775809", "1e3", " 42 ", "0x10", "1_000", "-0", "000000000000000000000000012"), "CAST(o_custkey AS STRING)")


def parse_int(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_INTS} AS v")
    return d.select("o_orderkey", tokens.parse_int(F.col("v")).alias("as_int64"), tokens.parse_uint(F.col("v")).alias("as_uint64"))


_FLOATS = _case("o_orderkey", _q("1d", "inf", "-Infinity", "1e400", ".5", "5.", "1.5f", "0x1p3", "nan", "-nan", " 2.50 ", "1e-3", "+1E2", "."), "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)")


def parse_float(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_FLOATS} AS v")
    return d.select("o_orderkey", tokens.parse_float(F.col("v")).alias("as_float64"))


_ISO = "CAST(CAST({c} AS DATE) AS STRING)"


def _slash(c: str, month_first: bool = False) -> str:
    i = _ISO.format(c=c)
    a, b = (f"substr({i}, 6, 2)", f"substr({i}, 9, 2)")
    return f"{a} || '/' || {b} || '/' || substr({i}, 1, 4)" if month_first else f"{b} || '/' || {a} || '/' || substr({i}, 1, 4)"


_DATES = _case("(l_orderkey + l_linenumber)", [_ISO.format(c="l_shipdate"), _slash("l_shipdate"), _slash("l_shipdate", True), "'2023-02-29'", "'31/02/2024'", "' 1/2/24 '", "'2024-1-5'", "'20240105'"], "l_returnflag")


def parse_date(spark, sf_dir):
    d = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_DATES} AS v")
    return d.select("l_orderkey", "l_linenumber", tokens.parse_date(F.col("v")).alias("as_date"))


_DAY = _ISO.format(c="o_orderdate")
_STAMPS = _case("o_orderkey", [f"{_DAY} || ' 10:11:12'", f"{_DAY} || 'T10:11:12.345678'", f"{_slash('o_orderdate')} || ' 01:02:03'", f"{_DAY} || 'T23:59:59.9'", f"replace({_DAY}, '-', '/') || ' 4:5:6'", f"{_DAY} || 'T10:11:12Z'", f"{_DAY} || ' 24:00:00'", f"{_DAY} || ' 12:60:00'", _DAY, f"{_slash('o_orderdate')} || ' 01:02:03.5'", "'1000000000'", "'4000000000'", "'1500000000123'", "'1500000000123456'", "'1500000000123456789'", "'0'", "'-1500000000'"], "'999999999'")


def parse_timestamp(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_STAMPS} AS v")
    return d.select("o_orderkey", tokens.parse_timestamp_ms(F.col("v")).alias("ts_ms"))


_EVENT = "CAST(DATE '2024-01-01' + CAST(event_id % 300 AS INT) AS STRING)"
_UNITS = _case("event_id", [f"{_EVENT} || ' 10:11:12'", f"{_EVENT} || 'T10:11:12.5'", f"{_EVENT} || 'T10:11:12.500'", f"{_EVENT} || 'T10:11:12.500000'", f"{_EVENT} || 'T10:11:12.500000000'", f"{_EVENT} || 'T10:11:12Z'", f"{_EVENT} || 'T10:11:12.123+02:00'", f"{_EVENT} || ' 10:11:12-0530'", "'-123456'", "'-1234567'", "'-123456789012'", "'-123456789012345'", "'-123456789012345678'", "'12:34:56'", f"{_EVENT} || ' 10:61:12'"], "event_type")


def timestamp_unit(spark, sf_dir):
    d = _table(spark, sf_dir, "events").selectExpr("event_id", f"{_UNITS} AS v")
    return d.select("event_id", units.timestamp_unit(F.col("v")).alias("unit"))


_MILLIS = "(o_orderkey * 7919 - 40000) * 997"


def unit_scaling(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"timestampadd(MILLISECOND, {_MILLIS}, TIMESTAMP_NTZ'1970-01-01 00:00:00') AS ts")
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    ms = lambda c: F.timestamp_diff("MILLISECOND", zero, c)
    return d.select("o_orderkey", ms(tokens.scale_unit(F.col("ts"), "s")).alias("s_ms"), *[ms(tokens.scale_unit(F.col("ts"), u)).alias(f"{u}_ms") for u in ("ms", "us", "ns")])


_LINES = _case("n_nationkey", ["n_name || ',' || n_name || ',x'", "n_name || ';' || n_name", "n_name || '|a|b'", "n_name || ':a:b'", "'a,b;c'", "'abc'", "'\"a,b\",c;d;e'"], "n_name || ' a b'")


def delimiter_detect(spark, sf_dir):
    d = _table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"{_LINES} AS v")
    return d.select("n_nationkey", delimiter_of(F.col("v")).alias("delimiter"))


# --- profile and inference ------------------------------------------------------------------------------------

_SHOWN = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) AS c_acctbal", "c_mktsegment", f"{_case('c_custkey', _q('yes', 'no', 'NA', 'on'), repr('off'))} AS c_flag", f"{_case('c_custkey', _q('-12345678', '-2345678'), repr('-34567890'))} AS c_negative"],
    "labels": ["doc_id", "quality", "toxic"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", f"{_DAY} AS o_day", f"{_DAY} || ' 10:11:12' AS o_stamp", f"{_DAY} || 'T10:11:12.123456' AS o_micro", f"{_DAY} || 'T10:11:12Z' AS o_zoned", "o_orderpriority", f"{_INTS} AS o_mixed"],
}


def _names(table: str) -> list[str]:
    return [x.rsplit(" ", 1)[-1] for x in _SHOWN[table]]


def _stringed(spark, sf_dir, table: str) -> DataFrame:
    d = _table(spark, sf_dir, table).selectExpr(*_SHOWN[table])
    return d.select(*[F.col(c).cast("string") for c in d.columns])


def column_profile(spark, sf_dir):
    out = None
    for t in _SHOWN:
        p = prof.profile(_stringed(spark, sf_dir, t)).withColumn("table_name", F.lit(t))
        out = p if out is None else out.union(p)
    return out.select("table_name", "column_name", *prof.COUNTERS, *prof.FLAGS)


def infer_types(spark, sf_dir):
    out = None
    for t in _SHOWN:
        p = prof.infer(_stringed(spark, sf_dir, t)).withColumn("table_name", F.lit(t))
        out = p if out is None else out.union(p)
    return out.select("table_name", "column_name", "kind")


def infer_sample_vs_full(spark, sf_dir):
    """The first 1000 rows by key hold whole numbers; 3.5 comes later."""
    v = "CASE WHEN o_orderkey > 4500 AND o_orderkey % 3 = 0 THEN '3.5' ELSE CAST(o_custkey AS STRING) END AS v"
    d = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", v)
    sample = d.orderBy("o_orderkey").limit(1000)
    a = prof.infer(sample, ["v"]).select(F.lit("sample").alias("rows"), "kind")
    return a.union(prof.infer(d, ["v"]).select(F.lit("full").alias("rows"), "kind"))


def _observed_sql(table: str, where: str = "") -> str:
    """The counters of each column of a table, as SQL."""
    dt = rf"regexp_full_match(t, '{_STAMP_FORM}(\.[0-9]+)?([+-][0-9]{{2}}:?[0-9]{{2}})?') OR regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\.[0-9]+)?([Zz]|[+-][0-9]{{2}}:[0-9]{{2}})')"
    plain = "try_strptime(split_part(regexp_replace(t, '([Zz]|[+-][0-9]{2}:?[0-9]{2})$', ''), '.', 1), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%d/%m/%Y %H:%M:%S', '%Y/%m/%d %H:%M:%S']) IS NOT NULL"
    digits = r"length(regexp_extract(t, '^[^.]*\.([0-9]*)', 1))"
    unit = f"""CASE WHEN ({dt}) AND {plain} THEN CASE WHEN {digits} = 0 THEN 'ms' WHEN {digits} >= 9 THEN 'ns' WHEN {digits} >= 6 THEN 'us' WHEN {digits} >= 3 THEN 'ms' ELSE 's' END
      WHEN {_INT} THEN CASE WHEN abs(CAST(t AS HUGEINT)) < 100000000000 THEN 's' WHEN abs(CAST(t AS HUGEINT)) < 100000000000000 THEN 'ms' WHEN abs(CAST(t AS HUGEINT)) < 100000000000000000 THEN 'us' ELSE 'ns' END END"""
    per = []
    for e, name in zip(_SHOWN[table], _names(table), strict=True):
        value = e.rsplit(" AS ", 1)[0]
        per.append(f"SELECT '{name}' AS column_name, CAST({value} AS VARCHAR) AS v FROM {table} {where}")
    n = f"CASE WHEN {_INT} THEN TRY_CAST(t AS HUGEINT) END"
    return f"""SELECT '{table}' AS table_name, column_name, count_if(ok) AS n, count_if(ok AND ({_BOOL}) IS NOT NULL) AS bool_ok, count_if(ok AND ({_DATE}) IS NOT NULL) AS date_ok,
      {', '.join(f"count_if(ok AND coalesce(u = '{u}', false)) AS ts_{u}" for u in units.UNITS)},
      count_if(ok AND {_FLOAT}) AS f64_ok, count_if(ok AND i IS NOT NULL) AS i128_ok,
      coalesce(bool_or(ok AND {_FLOAT} AND regexp_matches(t, '[.eE]')), false) AS float_syntax, coalesce(bool_or(ok AND i < 0), false) AS negative,
      coalesce(bool_or(ok AND i < -9223372036854775808), false) AS below_i64, coalesce(bool_or(ok AND i > 9223372036854775807), false) AS above_i64, coalesce(bool_or(ok AND i > {_U64}), false) AS above_u64
    FROM (SELECT column_name, t, NOT {_NULL} AS ok, {n} AS i, CASE WHEN strlen(t) >= 8 AND regexp_matches(t, '[-:T]') THEN {unit} END AS u
          FROM (SELECT column_name, coalesce({_TRIM}, '') AS t FROM ({' UNION ALL '.join(per)}))) GROUP BY column_name"""


_KIND = """CASE WHEN n = 0 THEN 'text'
  WHEN (ts_s + ts_ms + ts_us + ts_ns) / n >= 0.995 THEN 'timestamp[' || CASE WHEN ts_ns > greatest(ts_s, ts_ms, ts_us) THEN 'ns' WHEN ts_us > greatest(ts_s, ts_ms) THEN 'us' WHEN ts_s > ts_ms THEN 's' ELSE 'ms' END || ']'
  WHEN date_ok / n >= 0.995 THEN 'date32' WHEN bool_ok / n >= 0.995 THEN 'boolean'
  WHEN f64_ok / n >= 0.98 THEN CASE WHEN float_syntax OR i128_ok / n < 0.98 OR below_i64 OR above_u64 THEN 'float64' WHEN NOT negative THEN 'uint64' WHEN NOT above_i64 THEN 'int64' ELSE 'float64' END
  ELSE 'text' END"""
_PROFILES = " UNION ALL ".join(f"({_observed_sql(t)})" for t in _SHOWN)

# --- rows -----------------------------------------------------------------------------------------------------

_FIELDS = [ColumnSpec("a", "uint64"), ColumnSpec("b", "text"), ColumnSpec("c", "float64")]
_RAW = "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS STRING) || '|' || o_orderstatus WHEN 1 THEN CAST(o_orderkey AS STRING) || '|' || o_orderpriority || '|1.5|more' WHEN 2 THEN '-1|\"x|y\"|oops' ELSE CAST(o_orderkey AS STRING) || '|NA|2.25' END"


def ragged_rows(spark, sf_dir):
    lines = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_RAW} AS value")
    rows = split_lines(lines, 3, "|")
    out = typed_projection(rows, _FIELDS, ["_c0", "_c1", "_c2"])
    return out.select(F.col("a").cast("bigint").alias("a"), "b", "c").groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def error_report(spark, sf_dir):
    lines = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_RAW} AS value")
    rows = split_lines(lines, 3, "|")
    lost = [F.count_if(~tokens.is_null_token(F.col(f"_c{i}")) & tokens.cast_to(F.col(f"_c{i}"), s.kind).isNull()).alias(f"lost_{s.name}") for i, s in enumerate(_FIELDS)]
    return rows.agg(F.count("*").alias("n_rows"), F.count_if("_ragged").alias("n_ragged"), *lost)


_TYPED = [("o_orderkey", "uint64"), ("o_flag", "boolean"), ("o_total", "float64"), ("o_day", "date32"), ("o_at", "timestamp[ms]"), ("o_note", "text"), ("o_raw", "binary")]
_TYPED_TEXT = ["CAST(o_orderkey AS STRING) AS o_orderkey", f"{_case('o_orderkey', _q('yes', 'NO', 'perhaps'), repr('NA'))} AS o_flag", "CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS o_total", f"{_case('o_orderkey', [_DAY, _slash('o_orderdate')], repr('soon'))} AS o_day", f"{_DAY} || 'T01:02:03.4567' AS o_at", "CASE WHEN o_orderkey % 7 = 0 THEN ' none ' ELSE ' ' || o_orderpriority END AS o_note", "o_orderstatus AS o_raw"]


def typed(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").selectExpr(*_TYPED_TEXT)
    out = typed_projection(d, [ColumnSpec(n, k) for n, k in _TYPED])
    return out.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


def csv_roundtrip_lineitem(spark, sf_dir):
    """lineitem rendered as text, then delimiter, types and rows found again, written as Parquet and read back."""
    text, out = scratch_path(spark, "lineitem-csv"), scratch_path(spark, "lineitem-parquet")
    _table(spark, sf_dir, "lineitem").write.option("header", "true").csv(text)
    convert(spark, text, out)
    d = spark.read.parquet(out)
    return d.select(*[F.col(c).cast("bigint").alias(c) if k == "decimal(20,0)" else F.col(c) for c, k in d.dtypes])


def csv_roundtrip_multiline(spark, sf_dir):
    """documents, whose texts hold line breaks and quotes, as text and back."""
    text, out = scratch_path(spark, "documents-csv"), scratch_path(spark, "documents-parquet")
    d = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"(?U)^\s+|\s+$", "").alias("text"), "lang", "source")
    d.write.options(header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(text)
    convert(spark, text, out, full_inference=True)
    return spark.read.parquet(out).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source")


_PARSED = "CAST(o_orderkey AS STRING) || ',' || CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'off' ELSE 'perhaps' END || ',' || CAST(CAST(o_orderdate AS DATE) AS STRING) || CASE WHEN o_orderkey % 5 = 0 THEN ',over' ELSE '' END"


def parse_lines_with_schema(spark, sf_dir):
    """Lines without a header, typed by a given schema."""
    lines = _table(spark, sf_dir, "orders").selectExpr(f"{_PARSED} AS value")
    return parse_lines(lines, [ColumnSpec("a", "int64"), ColumnSpec("b", "boolean"), ColumnSpec("c", "date32")], ",")


def file_report(spark, sf_dir):
    """A file of several parts: its data lines, the ragged lines shown (ten at most), and the rows that equal the header."""
    text, out = scratch_path(spark, "report-csv"), scratch_path(spark, "report-parquet")
    d = _table(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderkey % 100 = 7 THEN 'key,status' WHEN o_orderkey % 50 = 3 THEN 'k,s,over' ELSE CAST(o_orderkey AS STRING) || ',' || o_orderstatus END AS value")
    d.coalesce(1).write.text(f"{text}/part=0")
    spark.createDataFrame([("key,status",)], "value string").coalesce(1).write.text(f"{text}/part=1")
    head = spark.read.text(f"{text}/part=1").union(spark.read.text(f"{text}/part=0"))
    head.coalesce(1).write.text(f"{text}/all")
    raw = read_delimited(spark, f"{text}/all", ",")
    report = convert(spark, f"{text}/all", out, delimiter=",")
    alike = spark.read.parquet(out).filter("key = 'key' AND status = 'status'").count()
    got = (line_count(spark, f"{text}/all"), len(shown_ragged(raw)), report.rows, report.ragged, alike)
    return spark.createDataFrame([got], "n_lines long, n_shown long, n_rows long, n_ragged long, n_like_header long")


QUERIES = {
    "parse_lines": parse_lines_with_schema, "file_report": file_report,
    "null_tokens": null_tokens, "parse_bool": parse_bool, "parse_int": parse_int, "parse_float": parse_float, "parse_date": parse_date,
    "parse_timestamp": parse_timestamp, "timestamp_unit": timestamp_unit, "unit_scaling": unit_scaling, "delimiter_detect": delimiter_detect,
    "column_profile": column_profile, "infer_types": infer_types, "infer_sample_vs_full": infer_sample_vs_full, "ragged_rows": ragged_rows,
    "error_report": error_report, "typed_projection": typed, "csv_roundtrip_lineitem": csv_roundtrip_lineitem, "csv_roundtrip_multiline": csv_roundtrip_multiline,
}


def _over(table: str, keys: str, text: str, out: str) -> str:
    return f"SELECT {keys}, {out} FROM (SELECT *, {_TRIM} AS t FROM (SELECT *, {text} AS v FROM {table}))"


_U = f"CASE WHEN {_INT} AND TRY_CAST(t AS HUGEINT) BETWEEN 0 AND {_U64} THEN CAST(TRY_CAST(t AS HUGEINT) AS DECIMAL(20,0)) END"
_F64 = f"CASE WHEN {_FLOAT} AND isfinite(TRY_CAST(t AS DOUBLE)) THEN TRY_CAST(t AS DOUBLE) END"


def _unit() -> str:
    """The unit rule within the profile's SQL."""
    s = _observed_sql("labels")
    a = s.index("regexp_matches(t, '[-:T]') THEN ") + len("regexp_matches(t, '[-:T]') THEN ")
    return s[a : s.index(" END AS u", a)]


ORACLE_SQL = {
    "parse_lines": "SELECT CAST(o_orderkey AS BIGINT) AS a, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b, CAST(o_orderdate AS DATE) AS c FROM orders",
    "file_report": "SELECT count(*) AS n_lines, least(10, count_if(o_orderkey % 100 <> 7 AND o_orderkey % 50 = 3)) AS n_shown, count(*) AS n_rows, count_if(o_orderkey % 100 <> 7 AND o_orderkey % 50 = 3) AS n_ragged, count_if(o_orderkey % 100 = 7) AS n_like_header FROM orders",
    "null_tokens": _over("orders", "o_orderkey", _NULLS, f"{_NULL} AS is_null, CASE WHEN NOT {_NULL} THEN v END AS text_value"),
    "parse_bool": _over("lineitem", "l_orderkey, l_linenumber", _BOOLS, f"{_BOOL} AS flag"),
    "parse_int": _over("orders", "o_orderkey", _INTS, f"CASE WHEN {_INT} THEN TRY_CAST(t AS BIGINT) END AS as_int64, {_U} AS as_uint64"),
    "parse_float": _over("orders", "o_orderkey", _FLOATS, f"{_F64} AS as_float64"),
    "parse_date": _over("lineitem", "l_orderkey, l_linenumber", _DATES, f"{_DATE} AS as_date"),
    "parse_timestamp": _over("orders", "o_orderkey", _STAMPS, f"coalesce({_STAMP}, {_EPOCH}) AS ts_ms"),
    "timestamp_unit": _over("events", "event_id", _UNITS, f"{_unit()} AS unit"),
    "unit_scaling": f"SELECT o_orderkey, CAST(trunc({_MILLIS} / 1000) * 1000 AS BIGINT) AS s_ms, CAST({_MILLIS} AS BIGINT) AS ms_ms, CAST({_MILLIS} AS BIGINT) AS us_ms, CAST({_MILLIS} AS BIGINT) AS ns_ms FROM orders",
    "delimiter_detect": "SELECT n_nationkey, (SELECT d FROM (VALUES (1, ','), (2, ';'), (3, chr(9)), (4, '|'), (5, ':'), (6, ' ')) c(i, d) ORDER BY length(v) - length(replace(v, d, '')) DESC, i DESC LIMIT 1) AS delimiter FROM (SELECT *, " + _LINES + " AS v FROM nation)",
    "column_profile": _PROFILES,
    "infer_types": f"SELECT table_name, column_name, {_KIND} AS kind FROM ({_PROFILES})",
    "infer_sample_vs_full": "SELECT 'sample' AS rows, CASE WHEN bool_or(o_orderkey > 4500 AND o_orderkey % 3 = 0) THEN 'float64' ELSE 'uint64' END AS kind FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000) UNION ALL SELECT 'full', CASE WHEN bool_or(o_orderkey > 4500 AND o_orderkey % 3 = 0) THEN 'float64' ELSE 'uint64' END FROM orders",
    "ragged_rows": "SELECT a, b, c, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 2 THEN NULL ELSE CAST(o_orderkey AS BIGINT) END AS a, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderpriority WHEN 2 THEN 'x|y' END AS b, CASE o_orderkey % 4 WHEN 1 THEN CAST(1.5 AS DOUBLE) WHEN 3 THEN CAST(2.25 AS DOUBLE) END AS c FROM orders) GROUP BY a, b, c",
    "error_report": "SELECT count(*) AS n_rows, count_if(o_orderkey % 4 < 2) AS n_ragged, count_if(o_orderkey % 4 = 2) AS lost_a, CAST(0 AS BIGINT) AS lost_b, count_if(o_orderkey % 4 = 2) AS lost_c FROM orders",
    "typed_projection": f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS o_flag, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS o_total,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) END AS o_day, CAST({_DAY} || ' 01:02:03.456' AS TIMESTAMP) AS o_at,
        CASE WHEN o_orderkey % 7 <> 0 THEN ' ' || o_orderpriority END AS o_note, CASE WHEN TRUE THEN encode(o_orderstatus) END AS o_raw FROM orders""",
    "csv_roundtrip_lineitem": "SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS TIMESTAMP) AS l_shipdate FROM lineitem",
    "csv_roundtrip_multiline": r"SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text, lang, source FROM documents",
}

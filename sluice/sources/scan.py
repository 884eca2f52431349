"""Delimited text as rows of text, with a ragged-row flag.

A file whose records are single lines is read as lines, split by Spark anywhere; one with quoted line
breaks is read by the CSV reader in multi-line mode, one task per file. One narrow pass with a partial
aggregate tells which. Ragged rows are kept; undecodable lines are dropped and counted. A quote that is never closed
makes the rest of its file one record, as the format has it; that is reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.typed import split_lines
from sluice.sources import dialect

_LOCAL_ROW = (1 << 33) - 1


@dataclass
class RawTable:
    rows: DataFrame  # _c0 .., _ragged, _line
    names: list[str]  # unique
    headers: list[str]  # as in the file
    delimiter: str
    multi_line: bool
    undecodable: int | None = None  # lines dropped, where that was counted
    unclosed: bool = False  # whether the file has an odd number of quotes, where that was counted

    @property
    def columns(self) -> list[str]:
        return [f"_c{i}" for i in range(len(self.names))]


def shape(spark: SparkSession, path: str) -> tuple[bool, int, int, bool]:
    """(whether a record spans lines, undecodable lines, lines, whether the number of quotes is odd)."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    r = lines.agg(F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)), F.count_if(~F.is_valid_utf8("value")), F.count("*"), F.coalesce(F.sum(quotes), F.lit(0)) % 2 == 1).first()
    return bool(r[0]), int(r[1]), int(r[2]), bool(r[3])


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool | None = None) -> RawTable:
    delimiter = delimiter or dialect.detect_delimiter(spark, path)
    undecodable, unclosed = None, False
    if multi_line is None:
        multi_line, undecodable, _, unclosed = shape(spark, path)
    start = dialect.first_lines(spark, path, 100)
    header = next((x for x in start if x.removeprefix("﻿")), None)
    if header is None:
        raise ValueError(f"{path} has no header")
    if "�" in header:
        raise ValueError(f"{path}: the header is not UTF-8")
    if multi_line:
        return _multi_line(spark, path, delimiter, undecodable, unclosed)
    headers = dialect.header_names(header, delimiter)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_ROW)).alias("_row"))
    valid = lines.filter(F.is_valid_utf8("value"))
    if _many(lines):
        kept = _without_headers(lines, valid, header)
    else:
        kept = valid.filter((F.col("_block") != 0) | (F.col("_row") != start.index(header)))
    rows = split_lines(kept, len(headers), delimiter)
    return RawTable(rows, dialect.unique_names(headers), headers, delimiter, False, undecodable, unclosed)


def _without_headers(lines: DataFrame, valid: DataFrame, header: str) -> DataFrame:
    """The lines of several files without each file's first line that equals the header.

    Files share tasks, so a line's number doesn't tell that it is a file's first. Mostly only headers equal the
    header. Where a file has the line again, such lines but each file's first come back, after the others.
    """
    alike = (F.col("_block") == 0) & (F.col("value") == header)
    heads = lines.filter(alike).select("value", "_file", F.monotonically_increasing_id().alias("_at"))
    first = heads.groupBy("_file").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    kept = valid.filter(~alike)
    if first.isEmpty():
        return kept
    again = heads.join(first, "_file").filter("_at > _first")
    return kept.unionByName(again.select("value", "_file"), allowMissingColumns=True)


def _many(df: DataFrame) -> bool:
    return len(df.inputFiles()) > 1


def _multi_line(spark: SparkSession, path: str, delimiter: str, undecodable: int | None, unclosed: bool) -> RawTable:
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    first = spark.read.options(**options, header="false", inferSchema="false").csv(path).first()
    headers = [(x or "").removeprefix("﻿") for x in first]
    schema = ", ".join(f"_c{i} STRING" for i in range(len(headers))) + ", _bad STRING"
    # columns are not pruned: a pruned scan forgets which rows are ragged
    rows = spark.read.options(**options, header="true", enforceSchema="true", columnNameOfCorruptRecord="_bad", columnPruning="false").schema(schema).csv(path)
    field = lambda c: F.replace(c, F.lit("\r\n"), F.lit("\n")).alias(c)
    rows = rows.select(*[field(f"_c{i}") for i in range(len(headers))], F.col("_bad").isNotNull().alias("_ragged"), F.col("_bad").alias("_line"))
    return RawTable(rows, dialect.unique_names(headers), headers, delimiter, True, undecodable, unclosed)


def line_count(spark: SparkSession, path: str) -> int:
    """Physical lines without the header."""
    return max(0, spark.read.text(path).count() - 1)

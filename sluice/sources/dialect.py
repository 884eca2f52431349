"""Delimiter and header of a delimited text."""

from __future__ import annotations

import csv

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The candidates; of equally frequent ones the last wins, so a line without any is split at spaces.
DELIMITERS = (",", ";", "\t", "|", ":", " ")


def delimiter_of(line: Column) -> Column:
    """The most frequent candidate in a line, quotes notwithstanding."""
    counts = F.array(*[F.struct((F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))).alias("n"), F.lit(i).alias("at"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    return F.array_max(counts)["d"]


def first_lines(spark: SparkSession, path: str, n: int = 1) -> list[str]:
    return [r[0] for r in spark.read.text(path).select("value").take(n)]


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """From the first line of a file."""
    line = first_lines(spark, path)
    if not line:
        raise ValueError(f"{path} is empty")
    return spark.createDataFrame([(line[0],)], "value string").select(delimiter_of(F.col("value"))).first()[0]


def header_names(line: str, delimiter: str) -> list[str]:
    """The fields of a header line, as they stand (a byte-order mark dropped)."""
    return next(csv.reader([line.removeprefix("﻿")], delimiter=delimiter), [])


def unique_names(names: list[str]) -> list[str]:
    """Names that Parquet can hold side by side: empty ones become _c<position>, repeated ones (in any case) get a number."""
    out, seen = [], set()
    for i, name in enumerate(names):
        base = name or f"_c{i}"
        new, k = base, 1
        while new.lower() in seen:
            k += 1
            new = f"{base}_{k}"
        seen.add(new.lower())
        out.append(new)
    return out

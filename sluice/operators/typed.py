"""Rows of text to typed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.tokens import cast_to, trim
from sluice.types import ColumnSpec


def typed_projection(df: DataFrame, specs: Sequence[ColumnSpec], sources: Sequence[str] | None = None) -> DataFrame:
    """One expression per column; what doesn't parse is NULL. sources: the text columns, in the specs' order."""
    sources = df.columns if sources is None else sources
    pairs = list(enumerate(zip(sources, specs, strict=True)))
    # each value is trimmed once, in a projection of its own
    once = df.select(*[x for i, (c, _) in pairs for x in (F.col(f"`{c}`").alias(f"v{i}"), trim(F.col(f"`{c}`")).alias(f"t{i}"))])
    return once.select(*[cast_to(F.col(f"v{i}"), s.kind, F.col(f"t{i}")).alias(s.name, metadata=s.metadata) for i, (_, s) in pairs])


def split_lines(lines: DataFrame, n: int, delimiter: str, line: str = "value") -> DataFrame:
    """Fields _c0 .. of each line that isn't empty, and _ragged: whether it has another number of fields.

    Short lines are filled with NULL, long ones cut; no line is dropped.
    """
    schema = ", ".join(f"_c{i} STRING" for i in range(n)) + ", _bad STRING"
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    row = lines.filter(F.length(line) > 0).select(F.col(line).alias("_line"), F.from_csv(F.col(line), F.lit(schema), options).alias("x"))
    return row.select(*[F.col(f"x._c{i}").alias(f"_c{i}") for i in range(n)], F.col("x._bad").isNotNull().alias("_ragged"), "_line")


def parse_lines(lines: DataFrame, specs: Sequence[ColumnSpec], delimiter: str, line: str = "value") -> DataFrame:
    """Lines without a header to typed rows by a given schema."""
    n = len(specs)
    return typed_projection(split_lines(lines, n, delimiter, line), specs, [f"_c{i}" for i in range(n)])

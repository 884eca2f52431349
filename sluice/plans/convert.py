"""One delimited text to typed Parquet: delimiter, profile, types, typed projection, write.

Jobs: the first line, one pass over the lines that looks for quoted breaks, the profile (of the first rows, or of all of them), and
one narrow scan-project-write that also counts rows, ragged rows and values lost. None shuffles data.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluice.functions.tokens import cast_to, is_null_token
from sluice.operators.profile import head, infer_kinds
from sluice.operators.typed import typed_projection
from sluice.sinks.parquet import output_path, write_parquet
from sluice.sources.scan import RawTable, read_delimited
from sluice.types import ColumnSpec

log = logging.getLogger(__name__)
SAMPLE_ROWS = 1000
SHOWN = 10


@dataclass
class Report:
    output: str
    delimiter: str
    specs: list[ColumnSpec]
    rows: int = 0
    ragged: int = 0
    undecodable: int | None = None
    unclosed_quote: bool = False  # the rest of the file is one record
    nulled: dict[str, int] = field(default_factory=dict)  # values that did not parse, by column
    seconds: float = 0.0

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds else 0.0

    @property
    def micros_per_row(self) -> float:
        return self.seconds * 1e6 / self.rows if self.rows else 0.0


def infer_specs(raw: RawTable, full: bool = False, sample: int = SAMPLE_ROWS) -> list[ColumnSpec]:
    """The columns' types from the first rows, or from all."""
    rows = raw.rows.select(*raw.columns)
    kinds = infer_kinds(rows if full else head(rows, sample))
    return [ColumnSpec(n, k, h) for n, k, h in zip(raw.names, kinds, raw.headers, strict=True)]


def typed(raw: RawTable, specs: list[ColumnSpec]) -> DataFrame:
    return typed_projection(raw.rows.select(*raw.columns), specs)


def ragged_rows(raw: RawTable, limit: int = SHOWN) -> list[str]:
    """The first ragged lines."""
    return [r[0] for r in raw.rows.filter("_ragged").select("_line", *raw.columns[:1]).take(limit)]  # the multi-line reader refuses to give the bad line alone


def convert(spark: SparkSession, path: str, output: str | None = None, *, full_inference: bool = False, delimiter: str | None = None, single_file: bool = False, count_nulled: bool = False) -> Report:
    began = time.time()
    output = output or output_path(path)
    try:
        raw = read_delimited(spark, path, delimiter)
        specs = infer_specs(raw, full_inference)
        report = Report(output, raw.delimiter, specs, undecodable=raw.undecodable, unclosed_quote=raw.unclosed)
        seen = Observation()
        counts = [F.count("*").alias("rows"), F.count_if("_ragged").alias("ragged")]
        rows = raw.rows
        if count_nulled:
            counts += [F.count_if(~is_null_token(F.col(c)) & x.isNull()).alias(f"lost{i}") for i, (c, x) in enumerate(zip(raw.columns, _casts(raw, specs), strict=True))]
        out = typed_projection(rows.observe(seen, *counts), specs, raw.columns)
        write_parquet(out, output, single_file=single_file)
        got = seen.get
        report.rows, report.ragged = got["rows"], got["ragged"]
        if count_nulled:
            report.nulled = {s.name: got[f"lost{i}"] for i, s in enumerate(specs)}
    except Exception as e:
        raise RuntimeError(f"converting {path} to {output} failed: {e}") from e
    report.seconds = time.time() - began
    if report.unclosed_quote:
        log.warning("%s has a quote that is never closed: the rest of its file is one record", path)
    if report.ragged:
        for line in ragged_rows(raw):
            log.warning("ragged row: %s", line)
        if report.ragged > SHOWN:
            log.warning("%d more ragged rows are not shown", report.ragged - SHOWN)
    return report


def _casts(raw: RawTable, specs: list[ColumnSpec]):
    return [cast_to(F.col(c), s.kind) for c, s in zip(raw.columns, specs, strict=True)]

"""Files that keep arriving in a folder, typed by a fixed schema and appended to Parquet (an extension).

Stateless: each micro-batch is the batch plan of parse_lines; header lines are told by their text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.typed import parse_lines
from sluice.types import ColumnSpec


def ingest_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, specs: Sequence[ColumnSpec], delimiter: str, header: str | None = None, available_now: bool = True) -> StreamingQuery:
    lines = spark.readStream.text(folder).filter(F.is_valid_utf8("value"))
    if header is not None:
        lines = lines.filter(F.col("value") != header)
    writer = parse_lines(lines, specs, delimiter).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).option("compression", "zstd").outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()

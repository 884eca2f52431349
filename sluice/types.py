"""The flat, nullable column types of the engine and how Spark stores them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Name of each kind -> Spark type. Unsigned 64-bit numbers need a decimal; timestamps carry no zone.
KINDS: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "uint64": T.DecimalType(20, 0),
    "int64": T.LongType(),
    "float64": T.DoubleType(),
    "date32": T.DateType(),
    "timestamp[s]": T.TimestampNTZType(),
    "timestamp[ms]": T.TimestampNTZType(),
    "timestamp[us]": T.TimestampNTZType(),
    "timestamp[ns]": T.TimestampNTZType(),
    "text": T.StringType(),
    "binary": T.BinaryType(),
}


@dataclass(frozen=True)
class ColumnSpec:
    """A column to be: its name in the output, its kind, and its name in the header if that had to change."""

    name: str
    kind: str
    header: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unsupported target type {self.kind!r} of column {self.name!r}; known: {', '.join(KINDS)}")

    @property
    def metadata(self) -> dict:
        out = {} if self.header is None or self.header == self.name else {"header": self.header}
        return out | ({"unit": self.kind[10:-1]} if self.kind.startswith("timestamp") else {})

    def field(self) -> T.StructField:
        return T.StructField(self.name, KINDS[self.kind], True, self.metadata)

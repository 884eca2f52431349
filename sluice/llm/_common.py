"""Shared plumbing of the training-data operators: table access and scratch tables.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` (the folder that the cluster shares)
and reading it back, so a lost executor costs a re-read and never a recomputation of earlier rounds.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import time
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.shared import scratch_path

#: The six ASCII white-space characters that separate words (space, \\t, \\n, \\v, \\f, \\r).
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Bits of a bitmap (8 MB), and of a row of it.
BITMAP, BITMAP_ROW = 1 << 26, 1 << 15


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python of 8 MB and 2000 rows at most, where the session has Spark's own bounds: whole texts are long rows."""
    for key, usual, ours in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864", "8388608")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key).rstrip("b") == usual:
            spark.conf.set(key, ours)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(col: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of consecutive slices of a text column: at most `rows` rows, and `size` bytes unless one row has more."""
    lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(lengths):
        if i > at and (i - at >= rows or held + n > size):
            yield at, i - at
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield at, len(lengths) - at


def give_back() -> None:
    """Free memory that Arrow and malloc hold goes back to the system: Python workers share an executor's memory with the JVM, idle ones too."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def frugal(f: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """The function of an arrow_udf, after each batch of which free memory goes back."""

    @functools.wraps(f)
    def run(*cols: pa.Array) -> pa.Array:
        try:
            return f(*cols)
        finally:
            give_back()

    return run


def frugal_batches(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a mapInArrow, after each batch of which free memory goes back."""

    def run(batches):
        def each():
            for batch in batches:
                yield batch
                give_back()

        yield from f(each())
        give_back()

    return run


class Scratch:
    """Tables written by one operator run under the shared folder; ``drop`` frees each when it is done with.

    Spark deletes a shuffle's files only when the driver's garbage collector has met its plan, which many short rounds
    may not bring about for long. So ``drop`` has the driver collect its garbage, if that was EVERY seconds ago or more.
    """

    EVERY = 10.0
    collected = 0.0

    def __init__(self, spark: SparkSession, tag: str):
        bounded_batches(spark)
        self.spark, self.root, self.n = spark, scratch_path(spark, tag), 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
        if time.monotonic() - Scratch.collected >= Scratch.EVERY:
            gc.collect()
            give_back()
            jvm.System.gc()
            Scratch.collected = time.monotonic()


def bitmap(keys: DataFrame) -> DataFrame:
    """The hashed values of a column as rows of a bitmap: 8 MB at most, however many values, so it may be sent to all executors."""
    at = F.pmod(F.xxhash64(keys.columns[0]), F.lit(BITMAP))
    return keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / BITMAP_ROW).alias("__row")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP_ROW).alias("__bits"))


def by_bitmap(df: DataFrame, col: str, bits: DataFrame, *, inside: bool = True) -> DataFrame:
    """Rows whose value may be among the bitmap's (all that are, and a few others), or, not inside, rows whose value surely isn't."""
    at = F.pmod(F.xxhash64(col), F.lit(BITMAP))
    place = at % BITMAP_ROW
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (place % 8).cast("int")), F.lit(0)) == 1
    return df.join(F.broadcast(bits), F.floor(at / BITMAP_ROW) == F.col("__row"), "inner" if inside else "left").filter(there if inside else ~there).select(*df.columns)


def crc_mod(id_col, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(n))


def crc_mod_py(value: int, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n

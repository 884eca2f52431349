"""Connected components of an edge table by alternating large and small stars.

Each partition first shrinks its edges to a forest. A round then is two grouped minima and two joins over
rows of two ids; what a round leaves is written to the shared folder, so lineage stays short. A node's
edges need not be together: minima are pre-aggregated and the joins are equi-joins that Spark may split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import Scratch, frugal_batches


def _forest(batches, most: int = 200_000):
    """Edges of a partition as (node, root), root smaller, for each run of at most `most` edges."""
    parent: dict[int, int] = {}

    def root(x):
        r = x
        while (p := parent.get(r, r)) != r:
            r = p
        while (p := parent.get(x, x)) != r:
            parent[x] = r
            x = p
        return r

    def out():
        nodes = [(n, root(n)) for n in parent]
        nodes = [x for x in nodes if x[0] != x[1]]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in nodes], pa.int64()), pa.array([x[1] for x in nodes], pa.int64())], ["u", "v"])

    held = 0
    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(a), root(c)
            if a != c:
                parent[max(a, c)] = min(a, c)
                parent.setdefault(min(a, c), min(a, c))
        held += b.num_rows
        if held >= most:
            yield out()
            parent.clear()
            held = 0
    if parent:
        yield out()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for each node that an edge (two bigint columns) joins to another; component is the smallest node."""
    a, b = edges.columns
    scratch = Scratch(spark, "components")
    e = scratch.write(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").mapInArrow(frugal_batches(_forest), "u bigint, v bigint").distinct())
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if before is not None and tuple(state) == tuple(before):
            break
        before = state
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(least, F.col("u") == F.col("x")).select("u", "v", "m")
        nxt = scratch.write(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(e)
        e = nxt
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

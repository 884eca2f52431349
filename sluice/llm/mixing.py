"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is exponential, -ln(u) / q: u from the md5 of its seeded id, q its quality weight. A source
whose target is e sizes and a rest takes every document e times (complete epochs first); the rest goes to
the documents in the order of their keys, until the prefix sum of their sizes reaches it (a document is in
when at least half of it fits).

No source is sorted as a whole. Keys fall into ``buckets`` slices of the key's distribution; sizes are
summed per (source, slice), a prefix sum over those few rows finds the slice in which the budget ends, and
only that slice's documents are put in order. What returns to the documents is one cut per source, so
nothing is shuffled by document and a source may hold any share of the rows.

Edge cases: null sources are one source, last in order; null and empty texts have size 0 and take nothing
(in ``expand`` they stay once per whole epoch); an empty table gives no rows; with a total size of 0 all
targets are 0; rows with equal ids get equal keys and the same decision, ties in the key go by id; other
columns are kept by ``expand``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm._common import SPACE_CLASS, Scratch, read_table

WEIGHTS = (3, 1, 2)
SYMBOLS = "#*$%&|<>"


def word_count(text):
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")).cast("long")


def keyed(docs: DataFrame, *, id_col: str, source_col: str, text_col: str, quality_col: str | None, seed: str, buckets: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, x (the exponential key) and its slice; columns to keep come first."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(
        *keep,
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(t).alias("size"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("double").alias("n_symbols"),
        (F.col(quality_col).cast("double") if quality_col else F.lit(None).cast("double")).alias("given"),
    )
    q = F.coalesce(F.when(F.col("given").isNotNull(), F.greatest(F.col("given"), F.lit(1e-3))), F.when(F.col("size") > 0, F.col("size") / (F.col("size") + F.col("n_symbols")))).cast("double")
    q = F.coalesce(q, F.lit(1.0))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    two = one.select(*keep, "doc_id", "source", "size", (-F.log((h + 0.5) / float(1 << 52)) / q).alias("x"))
    return two.select("*", F.least(F.floor((1 - F.exp(-F.col("x"))) * buckets), F.lit(buckets - 1)).cast("int").alias("slice"))


def targets(sizes: DataFrame, *, total: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> weight and target; water-filling: shares by weight, capped, the excess reshared.

    One row per source comes in; the windows without a partition see those rows only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(0))
    s = s.select("*", F.sum("cap").over(order).alias("caps"), F.sum("weight").over(order).alias("upto"), F.sum("weight").over(every).alias("all_w"), (F.sum("source_size").over(every) * float(total)).alias("pool"))
    level = (F.col("pool") - (F.col("caps") - F.col("cap"))) / (F.col("all_w") - F.col("upto") + F.col("weight"))
    s = s.select("source", "source_size", "weight", "cap", level.alias("level"))
    # at the first source in this order that its level doesn't overfill, the level is right for all that follow
    s = s.select("*", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every).alias("water"))
    return s.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce("water", F.lit(0.0)) * F.col("weight")).alias("target"))


def cuts(keys: DataFrame, goal: DataFrame) -> DataFrame:
    """For each source: target, whole epochs and the cut (slice, key, id) up to which documents are taken once more."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.select("source", "source_size", "target", epochs.alias("epochs")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    per_slice = keys.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    run = per_slice.select("source", "slice", "n", F.sum("n").over(Window.partitionBy("source").orderBy("slice")).alias("upto"))
    g, r = goal.alias("g"), run.alias("r")
    edge = r.join(g, F.col("r.source").eqNullSafe(F.col("g.source"))).filter(F.col("r.upto") > F.col("g.rest")).groupBy("g.source").agg(F.min(F.struct("r.slice", F.col("r.upto") - F.col("r.n"), "g.rest")).alias("e"))
    edge = edge.select("source", F.col("e.slice").alias("edge"), F.col("e.col2").alias("before"), F.col("e.rest").alias("left")).alias("b")
    k = keys.alias("k")
    inside = k.join(edge, F.col("k.source").eqNullSafe(F.col("b.source")) & (F.col("k.slice") == F.col("b.edge"))).select("k.source", "k.doc_id", "k.x", "k.size", "b.before", "b.left")
    pre = F.sum("size").over(Window.partitionBy("source").orderBy("x", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.select("source", "x", "doc_id", (F.col("before") + pre - F.col("size") / 2.0 <= F.col("left")).alias("fits")).filter("fits").groupBy("source").agg(F.max(F.struct("x", "doc_id")).alias("cut")).alias("l")
    out = goal.alias("g").join(edge, F.col("g.source").eqNullSafe(F.col("b.source")), "left").join(last, F.col("g.source").eqNullSafe(F.col("l.source")), "left")
    return out.select(F.col("g.source").alias("g_source"), "g.source_size", "g.target", "g.epochs", F.coalesce("b.edge", F.lit(-1)).alias("edge"), F.col("l.cut").alias("cut"))


def plan(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", quality_col: str | None = None, seed: str = "mix", buckets: int = 4096, total: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(a row per document: doc_id, source, size, source_size, target, copies; the cuts per source)."""
    spark = docs.sparkSession
    keys = Scratch(spark, "mix").write(keyed(docs, id_col=id_col, source_col=source_col, text_col=text_col, quality_col=quality_col, seed=seed, buckets=buckets))
    goal = targets(keys.groupBy("source").agg(F.sum("size").alias("source_size")), total=total, most=most, weights=weights)
    cut = Scratch(spark, "mix-cuts").write(cuts(keys, goal))
    return _decide(keys, cut), cut


def _copies():
    once_more = (F.col("slice") < F.col("edge")) | ((F.col("slice") == F.col("edge")) & F.coalesce(F.struct("x", "doc_id") <= F.col("cut"), F.lit(False)))
    return (F.col("epochs") + once_more.cast("long")).alias("copies")


def _decide(keys: DataFrame, cut: DataFrame) -> DataFrame:
    return keys.join(cut, keys["source"].eqNullSafe(cut["g_source"])).select("doc_id", "source", "size", "source_size", "target", _copies())


def expand(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix", buckets: int = 4096) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns."""
    names = docs.columns
    _, cut = plan(docs, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed, buckets=buckets)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("src"), F.col(text_col).alias("txt"))
    k = keyed(rows, id_col="id", source_col="src", text_col="txt", quality_col=None, seed=seed, buckets=buckets, keep=("row",))
    j = k.join(cut, k["source"].eqNullSafe(cut["g_source"]))
    j = j.select("row", _copies().cast("int").alias("copies")).filter("copies > 0")
    return j.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided, _ = plan(read_table(spark, sf_dir, "documents"))
    return decided.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::DOUBLE AS n_symbols FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
        / (CASE WHEN size > 0 THEN size / (size + n_symbols) ELSE 1.0::DOUBLE END) AS x FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM k GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, (CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight FROM s),
-- shares by weight; each round caps what is above and reshares
f(round, source, weight, cap, capped, left_over, open_weight) AS (
  SELECT 0, source, weight, cap, false, (sum(source_size) OVER () * 1.5)::DOUBLE, sum(weight) OVER () FROM w
  UNION ALL
  SELECT round + 1, source, weight, cap, now, (pool - coalesce(sum(CASE WHEN now AND NOT capped THEN cap END) OVER (), 0))::DOUBLE, coalesce(sum(CASE WHEN NOT now THEN weight END) OVER (), 0)
  FROM (SELECT *, left_over AS pool, capped OR left_over * weight > cap * open_weight AS now FROM f WHERE round < (SELECT count(*) FROM w))),
t AS (SELECT w.source, w.source_size, CASE WHEN f.capped THEN w.cap ELSE f.left_over / f.open_weight * w.weight END AS target
      FROM w JOIN f ON w.source IS NOT DISTINCT FROM f.source WHERE f.round = (SELECT count(*) FROM w)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY k.x, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size / 2.0::DOUBLE <= e.target - e.epochs * e.source_size AS once_more
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + once_more::BIGINT))::BIGINT AS taken FROM p
"""

"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with a cosine of c or more are within a squared distance of 2 - 2c. After a fixed random
rotation their coordinates are cut into blocks of ``block`` dimensions; a pair that is within the whole budget is
within a block's proportional share of it in one block at least. In each block a range join finds the pairs
within its share: the coordinates' signs are the home cell of a vector, and it also visits the cells whose
borders its share of the budget reaches. The union of the blocks' candidates is verified exactly, by cosine in double precision
of the vectors as given.

Equal vectors of a label are one from the start. A cell with many rows is dealt out as chunk against chunk, so no
task holds more than two chunks of a cell at a time.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do those with a null
label; only vectors of equal length are compared; equal rows are linked; ids are taken to be unique; a null
id forms no links; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import Scratch, read_table
from sluice.llm.components import components

BLOCK = 8
CHUNK = 1024
_rotations: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    if d not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
        _rotations[d] = q * np.sign(np.diag(r))
    return _rotations[d]


def usable(v) -> np.ndarray | None:
    """The vector in double precision, or None if it can't be compared."""
    if v is None or not len(v) or any(x is None for x in v):
        return None
    x = np.array(v, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    return x


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; scaled first, so that no square overflows or vanishes."""
    a = a / np.abs(a).max(1, keepdims=True)
    b = b / np.abs(b).max(1, keepdims=True)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def visits(x: np.ndarray, threshold: float, block: int):
    """For unit vectors of one length: arrays (row, block, cell, home, coordinates) of all cells that they visit, block by block."""
    d = x.shape[1]
    y = x @ rotation(d)
    for b, at in enumerate(range(0, d, block)):
        z = y[:, at : at + block]
        share = budget(threshold, z.shape[1], d)
        n = z.shape[1]
        masks = np.arange(1 << n)
        bits = ((masks[:, None] >> np.arange(n)) & 1).astype(np.float64)
        row, mask = np.nonzero((z * z) @ bits.T <= share)
        home = ((z >= 0) << np.arange(n)).sum(1)
        coords = np.zeros((len(z), block), np.float32)
        coords[:, :n] = z
        yield b, row, home[row] ^ masks[mask], mask == 0, coords


def budget(threshold: float, dims: int, d: int) -> float:
    return (2 - 2 * threshold) * dims / d * (1 + 1e-5) + 1e-6  # coordinates travel in single precision


def _near(h: np.ndarray, p: np.ndarray, share: np.ndarray) -> np.ndarray:
    return (h * h).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * h @ p.T <= share


def near_vectors(df: DataFrame, *, threshold: float = 0.98, block: int = BLOCK, chunk: int = CHUNK, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id for each row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")

    def same(col: pa.Array) -> pa.Array:
        out = []
        for v in col:
            x = usable(v.as_py())
            out.append(None if x is None else xxhash.xxh3_128_digest((x + 0.0).tobytes()))
        return pa.array(out, pa.binary())

    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.select("vec_id", "label", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.arrow_udf(same, "binary")("v")).alias("same"), "v")
    base = scratch.write(rows)
    groups = scratch.write(base.filter("same IS NOT NULL").groupBy("label", "same").agg(F.min("vec_id").alias("first"), F.count("*").alias("w")))
    member = scratch.write(base.select("vec_id", "label", "same").join(groups, ["label", "same"], "left").select("vec_id", F.coalesce("first", "vec_id").alias("first"), F.coalesce("w", F.lit(1)).alias("w")))
    firsts = groups.select(F.col("first").alias("vec_id"))
    vec = scratch.write(base.join(firsts, "vec_id", "left_semi").select("vec_id", "label", "v"))

    def cells(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                ids = b.column("vec_id").to_numpy(zero_copy_only=False)
                xs = [np.array(v.as_py(), np.float64) for v in b.column("v")]
                for d in sorted({len(x) for x in xs}):
                    at = np.array([k for k, x in enumerate(xs) if len(x) == d])
                    x = np.stack([xs[k] for k in at])
                    x /= np.abs(x).max(1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for k, row, cell, home, coords in visits(x, threshold, block):
                        yield pa.RecordBatch.from_arrays(
                            [b.column("label").take(pa.array(at[row])), pa.array(np.full(len(row), d, np.int32)), pa.array(np.full(len(row), k, np.int32)), pa.array(cell.astype(np.int32)), pa.array(home), pa.array(ids[at[row]]), pa.FixedSizeListArray.from_arrays(pa.array(coords[row].ravel()), block).cast(pa.list_(pa.float32()))],
                            ["label", "d", "block", "cell", "home", "vec_id", "x"],
                        )

    kind = dict(base.dtypes)["label"]
    visited = vec.mapInArrow(cells, f"label {kind}, d int, block int, cell int, home boolean, vec_id bigint, x array<float>")
    key = ["label", "d", "block", "cell"]
    hot = visited.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > chunk).select(*key, F.ceil(F.col("n") / chunk).cast("int").alias("k"))
    dealt = visited.join(hot, key, "left")
    own = F.pmod(F.xxhash64("vec_id"), F.col("k")).cast("int")
    each = F.sequence(F.lit(0), F.col("k") - 1)
    pair = lambda a, b, role: F.struct(a.cast("int").alias("i"), b.cast("int").alias("j"), F.lit(role).alias("role"))
    as_home, as_visit = F.transform(each, lambda c: pair(own, c, 1)), F.transform(each, lambda c: pair(c, own, 2))
    once = F.when(F.col("home"), F.array(pair(F.lit(0), F.lit(0), 3))).otherwise(F.array(pair(F.lit(0), F.lit(0), 2)))
    to = F.when(F.col("k").isNull(), once).when(F.col("home"), F.concat(as_home, as_visit)).otherwise(as_visit)
    dealt = dealt.select(F.xxhash64(*key).alias("c"), "d", "block", F.explode(to).alias("t"), "vec_id", "x").select("c", "d", "block", "t.i", "t.j", "t.role", "vec_id", "x")
    dealt = dealt.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")

    def join(batches):
        """Runs of equal (c, i, j) follow each other; homes against visits, the smaller id visiting."""
        held: list[tuple] = []
        last = None

        def pairs():
            d, at = int(held[0][1][0]), int(held[0][2][0])
            role, ids, x = (np.concatenate([h[k] for h in held]) for k in (3, 4, 5))
            hs, ps = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
            dims = min(block, d - at * block)
            share = budget(threshold, dims, d)
            out = []
            for s in range(0, len(hs), 512):
                h = hs[s : s + 512]
                i, j = np.nonzero(_near(x[h], x[ps], share) & (ids[ps][None, :] < ids[h][:, None]))
                out.append((ids[ps[j]], ids[h[i]]))
            return out

        def emit(found):
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c, d, k, i, j, role, ids = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("c", "d", "block", "i", "j", "role", "vec_id"))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, block).astype(np.float64)
            cut = np.flatnonzero((c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for s, e in zip(np.r_[0, cut], np.r_[cut, len(c)], strict=True):
                here = (c[s], i[s], j[s])
                if here != last and held:
                    yield from emit(pairs())
                    held = []
                last = here
                held.append((None, d[s:e], k[s:e], role[s:e], ids[s:e], x[s:e]))
        if held:
            yield from emit(pairs())

    candidates = dealt.mapInArrow(join, "a bigint, b bigint").distinct()

    def verified(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a), bool)
        la, lb = (x.value_lengths().to_numpy(zero_copy_only=False) for x in (a, b))
        for d in np.unique(la):
            at = np.flatnonzero((la == d) & (lb == d))
            for s in range(0, len(at), 4096):
                t = pa.array(at[s : s + 4096])
                x, y = (v.take(t).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) for v in (a, b))
                out[at[s : s + 4096]] = cosine(x, y) >= threshold
        return pa.array(out)

    va, vb = vec.select(F.col("vec_id").alias("a"), F.col("v").alias("va")), vec.select(F.col("vec_id").alias("b"), F.col("v").alias("vb"))
    links = scratch.write(candidates.join(va, "a").join(vb, "b").filter(F.arrow_udf(verified, "boolean")("va", "vb")).select("a", "b"))
    scratch.drop(base, vec, groups)
    comp = components(spark, links).select(F.col("node").alias("first"), "component")
    weight = member.groupBy("first").agg(F.max("w").alias("w"))
    both = links.union(links.select("b", "a"))
    others = both.join(weight, both["b"] == weight["first"]).groupBy("a").agg(F.sum("w").alias("others")).withColumnRenamed("a", "first")
    out = member.join(others, "first", "left").join(comp, "first", "left")
    return out.select("vec_id", (F.coalesce("others", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links"), F.coalesce("component", "first").alias("component_id"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: All pairs of a label, and reachability over their links.
ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id < b.vec_id
      WHERE list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)) >= 0.98::DOUBLE),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, m) AS component_id, vec_id = least(vec_id, m) AS kept
FROM embeddings LEFT JOIN k ON vec_id = k.a LEFT JOIN c ON vec_id = c.a
"""

"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star edges.

A document's set is its distinct shingles of five words (A-Z lower-cased); two are linked from a Jaccard
similarity of 0.75. One 64-bit hash of each shingle fills BINS bins; an empty bin copies the filled bin that
comes first in the bin's own fixed random order. BANDS bands of BINS / BANDS bins are bucket keys: a pair at
0.75 shares no bucket with a chance of 3e-8.

Documents with equal sets are one from the start. In each bucket only a star of candidate edges is made, to
its smallest document, in three rounds with components found in between: first one edge per document (to
the smallest centre it meets in any bucket), then the stars' edges between different components, then, for the
documents that a star's centre failed to link, the other components of their buckets, tile by tile, each tile
handing on a forest of links. Before that what can't be a link is ruled out: by size; by BITS one-bit minima, of which a pair at 0.75
differs in more than MOST with a chance of 1.6e-8; and by the number of a document's shingles that any
other document near it has, which bounds every intersection. Every candidate is confirmed on full sets.

Texts, sketches and bucket keys are long or many, and most meet nothing. Which may is marked in bitmaps of hashed
values; only what a bitmap lets through is shuffled to the exact joins, which drop what it let through by chance.

Edge cases: null and empty texts, and texts without words, have an empty set and link with nothing; texts
of one to four words are one shingle; equal rows are linked; ids are taken to be unique; a null id forms no
links; other columns are ignored. Texts are processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import Scratch, bitmap, by_bitmap, frugal, frugal_batches, read_table
from sluice.llm.components import components

WORDS = 5
BINS = 320
BANDS = 64
BITS = 256
MOST = 64
CHUNK = 512
_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_word_hash = _WordHashes()
_order: np.ndarray | None = None


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, n)
    k = min(n, WORDS)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : n - k + 1 + i]) * _M
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(32))) * _N
    h ^= h >> np.uint64(27)
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """BINS values of a non-empty sorted set; the top bits choose the bin, so each bin's minimum comes first in it."""
    global _order
    if _order is None:
        _order = np.random.default_rng(41).permuted(np.tile(np.arange(BINS, dtype=np.uint16), (BINS, 1)), axis=1)
    bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.r_[True, bins[1:] != bins[:-1]]
    filled = bins[first]
    out = np.zeros(BINS, np.uint64)
    out[filled] = s[first]
    if len(filled) < BINS:
        empty = np.ones(BINS, bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[filled[_order[empty[:, None], filled[None, :]].argmin(1)]]
    return out


def one_bit(sig: np.ndarray) -> np.ndarray:
    """A bit of each of the first BITS minima, mixed with the bin, as 64-bit words."""
    mixed = (sig[:BITS] ^ (np.arange(1, BITS + 1, dtype=np.uint64) * _M)) * _N
    mixed ^= mixed >> np.uint64(29)
    return np.packbits(((mixed * _M) >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def bands(sig: np.ndarray) -> np.ndarray:
    sig = sig.reshape(BANDS, -1)
    h = np.arange(BANDS, dtype=np.uint64) * _N
    for i in range(sig.shape[1]):
        h = (h ^ sig[:, i]) * _M
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _sketch(col: pa.Array) -> pa.Array:
    n, same, keys, bits = [], [], [], []
    for v in col:
        s = shingles(v.as_py())
        sig = signature(s) if len(s) else None
        n.append(len(s))
        same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
        keys.append(bands(sig) if len(s) else None)
        bits.append(one_bit(sig) if len(s) else None)
    many = pa.list_(pa.int64())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, many), pa.array(bits, many)], ["n", "same", "bands", "bits"])


def _shingle_sets(batches):
    """(doc_id, sorted shingle hashes), in slices, so that no more than a slice's sets are held beside a batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            sets = pa.array([shingles(v.as_py()).view(np.int64) for v in part.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sets], ["doc_id", "s"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for each document. The bands and MOST are made for a similarity of 75 percent and up."""
    if percent < 75:
        raise ValueError("percent must be 75 or more: below, the bands and one-bit minima would lose links")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    scratch = Scratch(spark, "minhash")
    base = scratch.write(docs.select("doc_id", F.arrow_udf(frugal(_sketch), "struct<n:bigint,same:binary,bands:array<bigint>,bits:array<bigint>>")("text").alias("s")).select("doc_id", "s.n", "s.same", "s.bands", "s.bits"))
    # written first, here and below, so that the join has a shuffle of its own, of which Spark can split the large partitions
    groups = scratch.write(base.filter("same IS NOT NULL AND doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("first")))
    alike = scratch.write(base.select("doc_id", "n", "same").join(groups, "same", "left").select("doc_id", "n", F.coalesce("first", "doc_id").alias("first")))
    firsts = groups.select(F.col("first").alias("doc_id"))
    copies = scratch.write(bitmap(alike.filter("doc_id <> first").select("doc_id")))
    sketched = base.filter("same IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n", "bands")
    # of the sketches only those are shuffled that may be copies; here and below an inner join, as Spark would put a semi join before the bitmap's
    alone = by_bitmap(sketched, "doc_id", copies, inside=False).unionByName(by_bitmap(sketched, "doc_id", copies).join(firsts.distinct().hint("merge"), "doc_id"))
    # a key has its band mixed in, so it names a bucket by itself
    rows = alone.select("doc_id", "n", F.explode("bands").alias("bucket"))
    # nearly all buckets have one document: all keys are shuffled once, without their documents, which follow for the others
    shared_keys = scratch.write(bitmap(rows.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1").select("bucket")))
    some = scratch.write(by_bitmap(rows, "bucket", shared_keys).select("bucket", "doc_id", "n"))
    small = scratch.write(some.groupBy("bucket").agg(F.count("*").alias("k"), F.min("doc_id").alias("centre"), F.min_by("n", "doc_id").alias("cn")).filter("k > 1").select("bucket", "centre", "cn"))
    # buckets with two documents or more, each row with its bucket's centre
    met = scratch.write(some.join(small, "bucket").select("bucket", "doc_id", "n", "centre", "cn"))
    scratch.drop(groups, copies, shared_keys, some, small)
    ids = met.select("doc_id").distinct().hint("merge")  # grows with the documents: not for broadcast at any size
    chosen = scratch.write(bitmap(met.select("doc_id")))
    sets = scratch.write(by_bitmap(docs, "doc_id", chosen).join(ids, "doc_id").select("doc_id", "text").mapInArrow(frugal_batches(_shingle_sets), "doc_id bigint, s array<bigint>"))
    scratch.drop(chosen)

    def linked(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those with sets alike enough."""
        a, b = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        j = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
        return j.filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b")

    def close(n, m):
        return (n * 100 >= m * percent) & (m * 100 >= n * percent)

    # 1: each document with the smallest centre that it meets
    stars = scratch.write(met.filter((F.col("doc_id") != F.col("centre")) & close(F.col("n"), F.col("cn"))).select("centre", "doc_id").distinct())
    one = scratch.write(linked(stars.groupBy("doc_id").agg(F.min("centre").alias("a")).select("a", F.col("doc_id").alias("b"))))
    comp = scratch.write(components(spark, one))
    # 2: the other edges of the stars, between different components
    def of(df, node, name):
        c = comp.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
        return df.join(c, F.col(node) == F.col("__n"), "left").select(*df.columns, F.coalesce("__c", F.col(node)).alias(name))

    apart = of(of(stars, "centre", "ca"), "doc_id", "cb").filter("ca <> cb").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
    two = scratch.write(linked(apart))
    comp = scratch.write(components(spark, one.union(two)))
    # 3: what a centre did not link, with the other components of its bucket
    placed = scratch.write(of(met, "doc_id", "comp").join(comp.select(F.col("node").alias("centre"), F.col("component").alias("cc")), "centre", "left").select("bucket", "doc_id", "n", "comp", (F.col("doc_id") == F.col("centre")).alias("is_centre"), (F.col("comp") != F.coalesce("cc", "centre")).alias("failed")))
    scratch.drop(met)
    open_ = placed.join(placed.filter("failed").select("bucket").distinct(), "bucket", "left_semi")
    open_ = scratch.write(open_.join(base.select("doc_id", "bits"), "doc_id"))
    scratch.drop(placed, base)
    u = open_.filter("failed").select("bucket", F.col("doc_id").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("cb"), F.col("bits").alias("bb"))
    v = open_.filter("NOT is_centre").select("bucket", F.col("doc_id").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ca"), F.col("bits").alias("ba"), "failed")
    differ = sum((F.bit_count(F.col("ba")[i].bitwiseXOR(F.col("bb")[i])) for i in range(BITS // 64)), F.lit(0))
    may = (F.col("ca") != F.col("cb")) & close(F.col("an"), F.col("bn")) & (differ <= MOST)
    doubtful = scratch.write(u.join(v, (u["bucket"] == v["bucket"]) & may, "left_semi").select("b").distinct())
    # of a doubtful document's shingles, how many another document of its buckets has
    around = open_.join(u.join(doubtful, "b", "left_semi").select("bucket").distinct(), "bucket", "left_semi").select("doc_id").distinct()
    common = sets.join(around, "doc_id", "left_semi").select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("k")).filter("k > 1").select("x")
    own = sets.join(doubtful.withColumnRenamed("b", "doc_id"), "doc_id", "left_semi").select("doc_id", F.explode("s").alias("x"))
    shared = scratch.write(own.join(common, "x").groupBy(F.col("doc_id").alias("b")).agg(F.count("*").alias("shared")))
    u = u.join(shared, "b").select("bucket", "b", "bn", "cb", "bb", "shared")
    # |A n B| <= shared, and 100 |A n B| >= percent (|A| + |B| - |A n B|)
    may = may & (F.col("shared") * (100 + percent) >= (F.col("an") + F.col("bn")) * percent)
    left = scratch.write(u.join(v, (u["bucket"] == v["bucket"]) & may, "left_semi").select("bucket", F.col("b").alias("doc_id")))
    three = scratch.write(_compare(open_.filter("NOT is_centre").select("bucket", "doc_id", "comp"), left, sets, percent))
    comp = scratch.write(components(spark, one.union(two).union(three)))
    scratch.drop(sets, stars, open_, doubtful, shared, left, one, two, three)
    c = comp.select(F.col("node").alias("first"), "component")
    return alike.join(c, "first", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id"))


def _compare(members: DataFrame, doubtful: DataFrame, sets: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that join the doubtful documents of each bucket to other components of it.

    The full sets meet in tiles, a chunk of a bucket's doubtful documents against a chunk of its members, however
    large it is. A tile keeps its pairs to itself and hands on a forest of links, no more than it has documents.
    """
    sizes = doubtful.groupBy("bucket").agg(F.ceil(F.count("*") / chunk).cast("int").alias("ku"))
    rows = members.join(sizes, "bucket").join(doubtful.withColumn("u", F.lit(True)), ["bucket", "doc_id"], "left")
    many = members.join(sizes.select("bucket"), "bucket", "left_semi").groupBy("bucket").agg(F.ceil(F.count("*") / chunk).cast("int").alias("kv"))
    rows = rows.join(many, "bucket").join(sets, "doc_id")
    own = lambda k: F.pmod(F.xxhash64("doc_id"), F.col(k)).cast("int")
    tile = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("ku") - 1), lambda i: tile(i, own("kv"), 2))
    as_doubtful = F.transform(F.sequence(F.lit(0), F.col("kv") - 1), lambda j: tile(own("ku"), j, 1))
    to = F.when(F.col("u").isNotNull(), F.concat(as_doubtful, as_member)).otherwise(as_member)
    dealt = rows.select("bucket", "doc_id", "comp", "s", F.explode(to).alias("t")).select("bucket", "t.i", "t.j", "t.role", "doc_id", "comp", "s")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches):
        held: list[tuple] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, i, j, role, ids, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j", "role", "doc_id", "comp"))
            s = batch.column("s")
            cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(bucket)].tolist(), strict=True):
                here = (bucket[a], i[a], j[a])
                if here != last and held:
                    yield from _tile(held, percent)
                    held = []
                last = here
                part = s.slice(a, b - a)
                held.append((role[a:b], ids[a:b], comp[a:b], part.value_lengths().to_numpy(zero_copy_only=False), part.flatten().to_numpy(zero_copy_only=False)))
        if held:
            yield from _tile(held, percent)

    return dealt.mapInArrow(frugal_batches(run), "a bigint, b bigint")


def _tile(held: list[tuple], percent: int):
    role, ids, comp, size, values = (np.concatenate([h[k] for h in held]) for k in range(5))
    _, code, seen = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(ids)), size)
    shared = np.flatnonzero(seen > 1)  # shingles of one document only can't be in an intersection
    column = np.full(len(seen), -1)
    column[shared] = np.arange(len(shared))
    col = column[code]
    owner, col = owner[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    us, vs = np.flatnonzero(role == 1), np.flatnonzero(role == 2)
    place = np.zeros(len(ids), np.int64)
    place[us], place[vs] = np.arange(len(us)), np.arange(len(vs))
    both = np.zeros((len(us), len(vs)), np.float32)
    width = 2048
    for at in range(0, len(shared), width):
        x, y = np.searchsorted(col, [at, at + width])
        o, c = owner[x:y], col[x:y] - at
        m = np.zeros((len(us), width), np.float32)
        n = np.zeros((len(vs), width), np.float32)
        is_u = role[o] == 1
        m[place[o[is_u]], c[is_u]] = 1
        n[place[o[~is_u]], c[~is_u]] = 1
        both += m @ n.T
    union = size[us][:, None] + size[vs][None, :] - both
    i, j = np.nonzero((both * 100 >= union * percent) & (comp[us][:, None] != comp[vs][None, :]))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = []
    for a, b in zip(us[i].tolist(), vs[j].tolist(), strict=True):
        p, q = root(int(comp[a])), root(int(comp[b]))
        if p != q:
            parent[p] = q
            out.append((int(ids[a]), int(ids[b])))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group stays; columns as given."""
    gone = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").hint("merge")  # grows with the documents
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


#: All pairs that share a shingle, and reachability over their links.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], chr(10)) AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, c.m) AS component_id, w.doc_id = least(w.doc_id, c.m) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.a
"""

"""Quality classifier: supervised subword embeddings with a softmax output.

Every word has a vector: the mean of the learned vectors of its hashed buckets (the word itself and its
character 1- to 4-grams; a marker bucket joins in where a word repeats the one before). A document is the
mean of its words' vectors; softmax over the two labels follows. Embeddings and output weights are
trained by numpy stochastic gradient descent on at most ``sample_per_label`` rows of each label (a
documented bound, the lowest seeded hashes). Since the output is linear in the mean, scoring needs one
learned number for each distinct word, kept in a bounded cache by each Python worker.

Edge cases: null and empty texts, and texts without words, have the zero vector and so the score of the
output bias; with no labelled row all scores are 0.5; labels other than 0 and 1 and null ids teach nothing;
repeated rows get equal scores; a labelled document whose id occurs more than once, in either table, teaches once for
each pair of its rows, within the sample's bound; an empty table gives no rows; other columns are ignored. Whole
texts are read, in slices of bounded bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import crc_mod, frugal, frugal_batches, read_table, slices

BITS = 16
ORDERS = 4
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
REPEAT = b"\x00repeat"


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of the words' features, concatenated, and where each word's begin (one more at the end)."""
    chars = [w.decode("utf-8", "replace") for w in words]
    size = np.array([len(c) for c in chars], np.int64)
    codes = np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.r_[0, np.cumsum(size)]
    owner = np.repeat(np.arange(len(words)), size)
    left = start[1:][owner] - np.arange(len(codes))  # characters from here to the word's end
    h = np.zeros(len(codes), np.uint64)
    whole = np.zeros(len(words), np.uint64)
    for k in range(int(size.max(initial=0))):  # the word's own hash, one character after another
        live = size > k
        whole[live] = (whole[live] ^ codes[start[:-1][live] + k]) * _P
        whole[live] ^= whole[live] >> np.uint64(31)
    owners, buckets = [np.arange(len(words))], [((whole + np.uint64(7)) * _Q) >> np.uint64(64 - BITS)]
    for k in range(ORDERS):
        n = len(codes) - k
        if n <= 0:
            break
        h = (h[:n] ^ codes[k:]) * _P
        h ^= h >> np.uint64(29)
        inside = left[:n] > k
        owners.append(owner[:n][inside])
        buckets.append(((h[inside] + np.uint64(k)) * _Q) >> np.uint64(64 - BITS))
    who, what = np.concatenate(owners), np.concatenate(buckets).astype(np.int32)
    order = np.argsort(who, kind="stable")
    return what[order], np.r_[0, np.cumsum(np.bincount(who, minlength=len(words)))]


def words_of(text: str | None) -> list[bytes]:
    """The text's words [^\\x20\\x09-\\x0D]+, a marker after each that repeats the one before."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    out = []
    last = None
    for w in words:
        out.append(w)
        if w == last:
            out.append(REPEAT)
        last = w
    return out


def doc_vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse bucket weights of a document: each word's mean, averaged."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    from collections import Counter

    seen = Counter(words)
    what, starts = word_features(list(seen))
    share = np.array(list(seen.values())) / len(words) / np.diff(starts)
    total = np.bincount(what, np.repeat(share, np.diff(starts)), minlength=1 << BITS)
    idx = np.flatnonzero(total)
    return idx.astype(np.int32), total[idx].astype(np.float32)


@dataclass
class QualityModel:
    value: np.ndarray  # of each bucket: its embedding times the difference of the output weights
    bias: float

    def __post_init__(self):
        self.cache: dict[bytes, float] = {}

    def __getstate__(self):
        return {"value": self.value, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.cache = {}

    def learn_words(self, words: list[bytes], part: int = 20_000, most: int = 200_000) -> None:
        if len(self.cache) + len(words) > most:
            self.cache.clear()
        for i in range(0, len(words), part):
            what, starts = word_features(words[i : i + part])
            sums = np.add.reduceat(self.value[what].astype(np.float64), starts[:-1])
            self.cache.update(zip(words[i : i + part], (sums / np.diff(starts)).tolist(), strict=True))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        cache = self.cache
        new = set().union(*docs).difference(cache) if docs else set()
        if new:
            if len(cache) + len(new) > 200_000:
                cache.clear()
                new = set().union(*docs)
            self.learn_words(sorted(new), most=1 << 62)
        z = np.array([sum(map(cache.__getitem__, d)) / len(d) if d else 0.0 for d in docs]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sample_hash(id_col):
    return F.pmod(F.xxhash64(F.lit(23), id_col.cast("string")), F.lit(1 << 30)) / float(1 << 30)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, sample_per_label: int = 1500, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Documents with their label, of each label those whose ids have the lowest hashes.

    The ids are picked from the labels alone, at most sample_per_label of each label, so what meets the documents is
    two small lists and no text moves. A label without a document takes a place and teaches nothing.
    """
    rows = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), _sample_hash(F.col(id_col)).alias("__u"))
    picked = [rows.filter(F.col("__label") == y).orderBy("__u", "__id").limit(sample_per_label) for y in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]).select("__id", "__label"))  # 2 * sample_per_label rows at most
    names = [c for c in docs.columns if c != label_col]
    return docs.join(ids, F.col(id_col) == F.col("__id")).select(*[F.col(f"`{c}`") for c in names], F.col("__label").alias(label_col))


def fit(labelled: DataFrame, *, sample_per_label: int = 1500, dim: int = 8, epochs: int = 12, rate: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learn from the rows given (label 0 or 1). Features are made on the executors; at most sample_per_label
    sparse rows of a label reach the driver."""
    n = {r[0]: r[1] for r in labelled.filter(F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}
    if not n:
        return QualityModel(np.zeros(1 << BITS, np.float32), 0.0)
    share = F.create_map(*[x for k, v in sorted(n.items()) for x in (F.lit(k), F.lit(min(1.0, sample_per_label / v)))])
    u = _sample_hash(F.col(id_col))
    picked = labelled.filter(F.col(label_col).isin(0, 1)).filter(u < share[F.col(label_col)]).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y"), u.alias("u"))

    def count(batches):
        for b in batches:
            got = [doc_vector(v.as_py()) for v in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), b.column("u"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))], ["id", "y", "u", "idx", "x"])

    rows = picked.mapInArrow(frugal_batches(count), "id string, y int, u double, idx array<int>, x array<float>").toArrow().sort_by([("u", "ascending"), ("id", "ascending")])
    data, seen = [], [0, 0]
    for i, y in enumerate(rows["y"].to_pylist()):
        seen[y] += 1
        if seen[y] <= sample_per_label:
            data.append((y, rows["idx"][i].values.to_numpy(), rows["x"][i].values.to_numpy()))
    rng = np.random.default_rng(11)
    emb = rng.normal(0, 0.1, (1 << BITS, dim))
    out, bias = rng.normal(0, 0.5, (dim, 2)), np.zeros(2)
    count_y = np.array([max(1, min(s, sample_per_label)) for s in seen], float)
    weight = count_y.sum() / 2 / count_y  # labels count alike
    for e in range(epochs):
        lr = rate * (1 - e / epochs)
        for i in rng.permutation(len(data)):
            y, idx, x = data[i]
            rows_ = emb[idx]
            v = x @ rows_
            s = v @ out + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            p *= weight[y] * lr
            back = out @ p
            out -= np.outer(v, p) * 4
            bias -= p * 0.1
            emb[idx] = rows_ - 4 * np.outer(x / max(float((x * x).sum()) ** 0.5, 1e-9), back)  # steps alike for short and long texts
    return QualityModel((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score(spark: SparkSession, model: QualityModel, text):
    """A double column, higher where label 1 is likelier."""
    shared = spark.sparkContext.broadcast(model)  # one number a bucket, whatever the corpus

    @F.arrow_udf("double")
    @frugal
    def scored(col: pa.Array) -> pa.Array:
        parts = [shared.value.scores(col.slice(i, n).to_pylist()) for i, n in slices(col, 512, 1 << 21)]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return scored(text)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(F.col("quality").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1)).select("doc_id", "quality")
    model = fit(labelled_sample(docs, labels))
    s = docs.select("doc_id", score(spark, model, F.col("text")).alias("score"))
    return s.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

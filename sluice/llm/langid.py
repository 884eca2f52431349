"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty, on at most
``sample_per_lang`` labelled documents of each language (a documented bound; the documents with the
lowest seeded hashes, so reruns agree). Document frequencies are counted over all labelled documents. A
fifth of the sample is kept back from the weights and used for temperature calibration.

Edge cases: a null text, an empty one and one without letters get ``und`` with score 1.0; with no
labelled row to learn from every document is ``und`` with score 0.0; repeated rows and ties give equal
rows (the first language by code point wins a tie); null ids are passed on and teach nothing in the query; an empty
table gives no rows. Of a dirty label column the ``max_langs`` most frequent values are languages, as a model has 256 kB for
each; ties go by code point. Other columns are kept by ``keep_identified`` and ignored by the query. Texts are
processed whole: the features of a long text are summed in parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import bounded_batches, crc_mod, frugal, frugal_batches, give_back, read_table, slices

BITS = 16
ORDERS = 3
UNDETERMINED = "und"
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else a space."""
    global _letters
    if _letters is None:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _letters = t
    return _letters


def gram_buckets(codes: np.ndarray) -> list[np.ndarray]:
    """Hashed bucket of the 1-, 2- and 3-gram that starts at each code (the last two codes only pad)."""
    x = codes.astype(np.uint64)
    n, out = len(x) - (ORDERS - 1), []
    h = np.zeros(n, np.uint64)
    for k in range(ORDERS):
        h = (h ^ x[k : k + n]) * _MUL[k]
        h ^= h >> np.uint64(29)
        out.append(((h * _MUL[0]) >> np.uint64(64 - BITS)).astype(np.int32))
    return out


def _codes(text: str) -> np.ndarray:
    """A text's letters, each run of other characters as one space, with a space before and two after."""
    t = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(t):
        keep = (t != 32) | np.r_[True, t[:-1] != 32]
        t = t[keep]
        if t[0] == 32:
            t = t[1:]
        if len(t) and t[-1] == 32:
            t = t[:-1]
    return np.concatenate((np.array([32], np.uint32), t, np.array([32, 32], np.uint32)))


def text_counts(text: str, part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted buckets and their counts over a whole text; None without letters."""
    codes = _codes(text)
    if len(codes) <= 3:
        return None
    total = np.zeros(1 << BITS, np.int64)
    for i in range(0, len(codes) - 2, part):
        for b in gram_buckets(codes[i : i + part + 2]):
            total += np.bincount(b, minlength=1 << BITS)
    idx = np.flatnonzero(total)
    return idx.astype(np.int32), total[idx]


@dataclass
class LangModel:
    langs: list[str]
    weights: np.ndarray  # (buckets, languages), IDF included
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str], part: int = 1 << 18) -> tuple[list[str], np.ndarray]:
        k = len(self.langs)
        langs, probs = [UNDETERMINED] * len(texts), np.ones(len(texts))
        if not k:
            return langs, np.zeros(len(texts))
        logits, sizes = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)

        def flush(rows: list[int], group: list[np.ndarray]) -> None:
            starts = np.cumsum([0] + [len(c) for c in group])
            # grams start anywhere but in the two padding codes, so none crosses into the next text
            cut = np.ravel(np.column_stack((starts[:-1], starts[1:] - 2)))
            codes = np.concatenate([*group, np.array([32, 32], np.uint32)])
            add = np.zeros((len(group), k))
            for b in gram_buckets(codes):
                g = self.weights[b]
                add += np.add.reduceat(np.concatenate((g, np.zeros((1, k), g.dtype))), np.minimum(cut, len(g)), axis=0, dtype=np.float64)[::2]
            logits[rows] += add
            sizes[rows] += ORDERS * (starts[1:] - starts[:-1] - 2)

        rows: list[int] = []
        group: list[np.ndarray] = []
        held = 0
        for i, text in enumerate(texts):
            codes = _codes(text)
            if len(codes) <= 3:
                continue
            for at in range(0, len(codes) - 2, part):
                piece = codes[at : at + part + 2]
                if held + len(piece) > part and group:
                    flush(rows, group)
                    rows, group, held = [], [], 0
                if rows and rows[-1] == i:
                    flush(rows, group)
                    rows, group, held = [], [], 0
                rows.append(i)
                group.append(piece)
                held += len(piece)
        if group:
            flush(rows, group)
        has = sizes > 0
        z = (logits[has] / sizes[has, None] + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        probs[has] = p[np.arange(len(best)), best]
        for i, b in zip(np.flatnonzero(has), best, strict=True):
            langs[i] = self.langs[b]
        return langs, np.clip(probs, 0.0, 1.0)


def sample(docs: DataFrame, sample_per_lang: int, id_col: str, text_col: str, lang_col: str, max_langs: int = 1000) -> DataFrame:
    """About sample_per_lang labelled rows of each of the max_langs most frequent languages, by seeded hash; only the ids and labels are read for the counts."""
    n = {r[0]: r[1] for r in docs.groupBy(lang_col).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), lang_col).limit(max_langs).collect()}
    if not n:
        return docs.limit(0)
    share = F.create_map(*[x for k, v in sorted(n.items()) for x in (F.lit(k), F.lit(min(1.0, sample_per_lang / v)))])
    u = F.pmod(F.xxhash64(F.lit(17), F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    return docs.filter(u < share[F.col(lang_col)]).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), u.alias("u"))


def document_frequencies(labelled: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """How many rows have letters, and in how many of them each bucket occurs: counted by task, summed on the executors."""

    def count(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for v in b.column("text"):
                c = text_counts(v.as_py() or "")
                if c is not None:
                    df[c[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, df[at]])], ["bucket", "k"])

    got = labelled.select(F.col(text_col).alias("text")).mapInArrow(frugal_batches(count), "bucket int, k bigint").groupBy("bucket").agg(F.sum("k").alias("k")).toArrow()
    total = np.zeros((1 << BITS) + 1, np.int64)  # the last one, at -1, is the number of rows
    total[got["bucket"].to_numpy()] = got["k"].to_numpy()
    return int(total[-1]), total[:-1]


def fit(labelled: DataFrame, *, sample_per_lang: int = 500, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, max_langs: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Learn from the rows given, which must all carry a language. Features are counted on the executors; at most
    sample_per_lang sparse rows of a language reach the driver."""
    picked = sample(labelled, sample_per_lang, id_col, text_col, lang_col, max_langs)

    def count(batches):
        for b in batches:
            idx, cnt = [], []
            for v in b.column("text"):
                c = text_counts(v.as_py() or "")
                idx.append(None if c is None else c[0])
                cnt.append(None if c is None else c[1].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), b.column("u"), pa.array(idx, pa.list_(pa.int32())), pa.array(cnt, pa.list_(pa.int32()))], ["id", "lang", "u", "idx", "cnt"])

    rows = picked.mapInArrow(frugal_batches(count), "id string, lang string, u double, idx array<int>, cnt array<int>").toArrow()
    rows = rows.filter(pa.compute.is_valid(rows["idx"])).sort_by([("u", "ascending"), ("id", "ascending")])
    all_langs, seen, data = rows["lang"].to_pylist(), {}, []
    for i, lang in enumerate(all_langs):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= sample_per_lang:
            data.append((lang, rows["idx"][i].values.to_numpy(), rows["cnt"][i].values.to_numpy().astype(np.float64)))
    langs = sorted({d[0] for d in data})
    k, d = len(langs), 1 << BITS
    if not k:
        return LangModel([], np.zeros((d, 0), np.float32), np.zeros(0), 1.0)
    n, df = document_frequencies(labelled, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    scale = 100.0  # relative frequencies are small numbers
    data = [(langs.index(lang), idx, cnt / cnt.sum() * idf[idx] * scale) for lang, idx, cnt in data]
    order = np.random.default_rng(5).permutation(len(data))
    back = [data[i] for i in order[::5]] if len(data) >= 5 * k else data
    kept = [data[i] for j, i in enumerate(order) if j % 5] if len(data) >= 5 * k else data
    z, n = np.zeros((d, k)), np.zeros((d, k))
    bias, bias_n = np.zeros(k), np.zeros(k)

    def weights(idx):
        zi = z[idx]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[idx])) / alpha + l2))

    for _ in range(epochs):
        for y, idx, x in kept:
            w = weights(idx)
            s = x @ w + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            g2 = g * g
            ni = n[idx]
            z[idx] += g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[idx] = ni + g2
            bias_n += p * p
            bias -= 0.1 * p / (1 + np.sqrt(bias_n))
    w = weights(np.arange(d))
    held = np.array([x @ w[idx] + bias for _, idx, x in back])
    ys = np.array([y for y, _, _ in back])

    def loss(t: float) -> float:
        s = held / t
        m = s.max(1)
        return float(np.mean(m + np.log(np.exp(s - m[:, None]).sum(1)) - s[np.arange(len(ys)), ys]))

    temperature = min(np.geomspace(0.5, 20, 121), key=loss)
    return LangModel(langs, (w * idf[:, None] * scale).astype(np.float32), bias, float(temperature))


def prediction(spark: SparkSession, model: LangModel, text):
    """A struct column (lang_pred, score) of the text column."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets x languages floats, whatever the corpus

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    @frugal
    def predict(col: pa.Array) -> pa.Array:
        langs, probs = [], []
        for i, n in slices(col, 256, 1 << 20):
            a, b = shared.value.scores([v or "" for v in col.slice(i, n).to_pylist()])
            langs += a
            probs.append(b)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(probs) if probs else [], pa.float64())], ["lang_pred", "score"])

    return predict(text)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn from: a language is given and crc32(doc_id) mod 4 is not 2."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(learnable(docs.select("doc_id", "text", "lang")))
    give_back()  # the sample's counts are gone
    p = docs.select("doc_id", prediction(spark, model, F.col("text")).alias("p"))
    return p.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("p.lang_pred").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(spark: SparkSession, docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents whose language is determined with a calibrated score of min_score or more; columns as given."""
    model = fit(learnable(docs.select("doc_id", "text", "lang")))
    give_back()  # the sample's counts are gone
    names = docs.columns
    p = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), prediction(spark, model, F.col("text")).alias("p"))
    return p.filter((F.col("p.lang_pred") != UNDETERMINED) & (F.col("p.score") >= min_score)).select("row.*")

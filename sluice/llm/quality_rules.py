"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source.

DataFrame functions only. Each document is reduced to counts; four of their ratios (in thousandths), and their
denominators, go into quantile sketches, which are histograms with 128 buckets for each power of two: exact below
256, within 1/128 above, of bounded size, and mergeable by adding counts (so partial aggregation is the merge, and
the sketch of a language or of everything is the sum of its parts). A group's fences are Tukey's,
Q3 + reach * IQR and Q1 - reach * IQR. Where a ratio hardly varies in a group (most documents have no symbol at all) its
quartiles say nothing; there the width is that of some occurrences in the group's median document, by the sketch of the
denominator: ALLOWED / median. So every fence comes from the group's sketches.
Groups of fewer than ``least`` documents use their language's sketch, languages as small the sketch of all.

Edge cases: null and empty texts have zero counts and are base_failed, and stay out of the sketches; null
languages and sources are groups of their own; repeated rows count each; an empty table gives no rows;
other columns are ignored. Texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm._common import SPACE_CLASS, Scratch, read_table

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: Ratio, in thousandths: numerator, denominator, occurrences that a median document may have beyond the quartiles, and whether
#: there is a lower fence.
RATIOS = {
    "word_length": ("word_chars", "n_words", 150, True),
    "symbol_ratio": ("n_symbols", "n_words", 20, False),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 3, False),
    "repeat_ratio": ("n_repeat_words", "n_words", 60, False),
}
SIZES = ("n_words", "n_lines")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_counts(docs: DataFrame, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """The kept columns and the counts of each row's whole text."""
    one = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    two = one.select(
        *keep,
        F.filter(F.split("__t", SPACE_CLASS + "+"), lambda w: w != "").alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("__l"),
        F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("__w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("p")))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    three = two.select(*keep, n.cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), F.array_sort(windows).alias("__g"))
    twins = F.filter("__g", lambda x, i: (F.get("__g", i - 1)["h"] == x["h"]) | (F.get("__g", i + 1)["h"] == x["h"]))
    four = three.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.transform(twins, lambda x: x["p"]).alias("__p"))
    covered = F.size(F.array_distinct(F.concat("__p", F.transform("__p", lambda p: p + 1), F.transform("__p", lambda p: p + 2))))
    return four.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def bucket(v):
    """Sketch bucket of a whole number: itself below 256, else 128 buckets for each power of two."""
    shift = F.length(F.bin(v)) - 8
    return F.when(v < 256, v).otherwise(shift * 128 + F.call_function("shiftright", v, shift)).cast("long")


def bucket_floor(b):
    """The least number of a bucket."""
    shift = F.when(b < 256, F.lit(0)).otherwise(F.floor(b / 128) - 1).cast("int")
    return F.when(b < 256, b).otherwise(F.call_function("shiftleft", b - shift * 128, shift)).cast("long")


def quantiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """n and the three quartiles of each group and ratio from bucket counts; groups merge by adding."""
    merged = sketch.groupBy(*group, "ratio", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group, "ratio")
    cum = merged.select(*group, "ratio", "bucket", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket")))
    q = cum.groupBy(*group, "ratio").agg(F.max("total").alias("n"), *[at(k).alias(f"q{k}") for k in (1, 2, 3)])
    return q.select(*group, "ratio", "n", *[bucket_floor(F.col(f"q{k}")).alias(f"q{k}") for k in (1, 2, 3)])


def fences(ratios: DataFrame, group: tuple[str, str], *, reach: int, least: int) -> DataFrame:
    """One row per group: lo and hi of each ratio, from the smallest grouping with enough documents."""
    lang, source = group
    counted = ratios.select(lang, source, F.explode(F.create_map(*[x for r in (*RATIOS, *SIZES) for x in (F.lit(r), F.col(r))])).alias("ratio", "v"))
    sketch = counted.groupBy(lang, source, "ratio", bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))
    own, by_lang, whole = quantiles(sketch, [lang, source]).alias("a"), quantiles(sketch, [lang]).alias("b"), quantiles(sketch, []).alias("c")
    j = own.join(by_lang, F.col(f"a.{lang}").eqNullSafe(F.col(f"b.{lang}")) & (F.col("a.ratio") == F.col("b.ratio"))).join(F.broadcast(whole), F.col("a.ratio") == F.col("c.ratio"))  # whole: a row for each of four ratios and two sizes
    pick = lambda c: F.when(F.col("a.n") >= least, F.col(f"a.{c}")).when(F.col("b.n") >= least, F.col(f"b.{c}")).otherwise(F.col(f"c.{c}"))
    q = j.select(F.col(f"a.{lang}").alias("g_lang"), F.col(f"a.{source}").alias("g_source"), F.col("a.ratio").alias("ratio"), *[pick(f"q{k}").alias(f"q{k}") for k in (1, 2, 3)])
    at = lambda r, c: F.max(F.when(F.col("ratio") == r, F.col(c)))
    q = q.groupBy("g_lang", "g_source").agg(*[at(r, f"q{k}").alias(f"{r}_{k}") for r in RATIOS for k in (1, 3)], *[at(r, "q2").alias(f"{r}_2") for r in SIZES])
    span = lambda r, den, some: F.greatest((F.col(f"{r}_3") - F.col(f"{r}_1")) * reach, F.expr(f"{some * 1000} div greatest({den}_2, 1)"))
    return q.select("g_lang", "g_source", *[x for r, (_, den, some, _) in RATIOS.items() for x in ((F.col(f"{r}_1") - span(r, den, some)).alias(f"lo_{r}"), (F.col(f"{r}_3") + span(r, den, some)).alias(f"hi_{r}"))])


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: int = 6, least: int = 50) -> DataFrame:
    """One row per document: counts, base_failed, kept and the first ratio that broke its group's fences."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source"), F.col(text_col).alias("__text"))
    counts = Scratch(spark, "quality").write(text_counts(keyed, "__text", ["doc_id", "__lang", "__source"]))
    rows = counts.select("*", *[F.when(F.col(b) > 0, F.expr(f"({a} * 1000) div {b}")).otherwise(F.lit(0)).cast("long").alias(r) for r, (a, b, _, _) in RATIOS.items()])
    limit = fences(rows.filter("n_words > 0"), ("__lang", "__source"), reach=reach, least=least)
    j = rows.join(limit, rows["__lang"].eqNullSafe(limit["g_lang"]) & rows["__source"].eqNullSafe(limit["g_source"]), "left")
    broken = F.coalesce(*[F.when((F.col(r) > F.col(f"hi_{r}")) | ((F.col(r) < F.col(f"lo_{r}")) if low else F.lit(False)), F.lit(r)) for r, (_, _, _, low) in RATIOS.items()])
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return j.select("doc_id", *COUNTS, base.alias("base_failed"), (~base & broken.isNull()).alias("kept"), broken.alias("broken_rule"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).drop("broken_rule")


def _sketch_sql(group: str) -> str:
    by = f"{group}, " if group else ""
    on = f"PARTITION BY {by}ratio"
    return f"""(SELECT {by}ratio, max(total) AS n,
        {', '.join(f"min(CASE WHEN upto * 4 >= total * {k} THEN bucket END) AS b{k}" for k in (1, 2, 3))}
        FROM (SELECT {by}ratio, bucket, sum(n) OVER ({on} ORDER BY bucket) AS upto, sum(n) OVER ({on}) AS total
              FROM (SELECT {by}ratio, bucket, sum(n) AS n FROM sketch GROUP BY {by}ratio, bucket)) GROUP BY {by}ratio)"""


_FLOOR = "CASE WHEN {b} < 256 THEN {b} ELSE ({b} - (({b} // 128) - 1) * 128) << (({b} // 128) - 1)::INT END"
_PICK = ", ".join(f"CASE WHEN a.n >= 50 THEN a.b{k} WHEN b.n >= 50 THEN b.b{k} ELSE c.b{k} END AS b{k}" for k in (1, 2, 3))
_SOME = "CASE ratio " + " ".join(f"WHEN '{r}' THEN {v[2]}" for r, v in RATIOS.items()) + " END"
_DEN = "CASE ratio " + " ".join(f"WHEN '{r}' THEN '{v[1]}'" for r, v in RATIOS.items()) + " END"
ORACLE = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
c AS (SELECT d.doc_id, d.lang, d.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
m AS (SELECT *, {', '.join(f"CASE WHEN {b} > 0 THEN ({a} * 1000) // {b} ELSE 0 END AS {r}" for r, (a, b, _, _) in RATIOS.items())} FROM c),
x AS ({' UNION ALL '.join(f"SELECT lang, source, '{r}' AS ratio, {r} AS v FROM m WHERE n_words > 0" for r in (*RATIOS, *SIZES))}),
sketch AS (SELECT lang, source, ratio, CASE WHEN v < 256 THEN v ELSE (length(bin(v)) - 8) * 128 + (v >> (length(bin(v)) - 8)::INT) END AS bucket, count(*) AS n FROM x GROUP BY ALL),
q AS (SELECT a.lang, a.source, a.ratio, {_PICK}
      FROM {_sketch_sql('lang, source')} a JOIN {_sketch_sql('lang')} b ON a.lang IS NOT DISTINCT FROM b.lang AND a.ratio = b.ratio JOIN {_sketch_sql('')} c ON a.ratio = c.ratio),
v AS (SELECT lang, source, ratio, {', '.join(f"{_FLOOR.format(b=f'b{k}')} AS q{k}" for k in (1, 2, 3))}, {_SOME} AS some, {_DEN} AS den FROM q),
f AS (SELECT lang, source, ratio, q1 - span AS lo, q3 + span AS hi
      FROM (SELECT v.*, greatest((v.q3 - v.q1) * 6, v.some * 1000 // greatest(d.q2, 1)) AS span FROM v JOIN v d ON v.lang IS NOT DISTINCT FROM d.lang AND v.source IS NOT DISTINCT FROM d.source AND d.ratio = v.den)),
bad AS (SELECT DISTINCT m.doc_id FROM m JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
        WHERE {' OR '.join(f"(f.ratio = '{r}' AND (m.{r} > f.hi" + (f" OR m.{r} < f.lo" if low else "") + "))" for r, (_, _, _, low) in RATIOS.items())})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad)) AS kept
FROM m
"""

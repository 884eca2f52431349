"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

A document is the sequence of its lines with a word. Positions whose line occurs once can't be in a repeated
run and drop out. The others are ranked by their first line, then by 2, 4, ... lines: in each round a
position's rank is joined with the one 2^j lines on, the distinct pairs that occur twice or more are sorted
over range partitions and numbered in that order, and positions whose pair is unique drop out, until no pair
occurs twice. (From the first, positions whose stretch of repeated lines has too few words for any run drop out too.) So after round j the ranks put the repeated suffixes in the order of their first 2^j lines, and
the suffixes of one rank are an interval of the suffix array whose longest common prefix is 2^j or more.

Longest common prefixes of any length then follow from the rounds, last round first. A position whose
interval at 2^j lines has an earlier first position begins with m = 2^j lines; the intervals of m lines are
split by the rank, 2^k lines long, that follows those m lines, for k = j-1, ..., 0, and wherever the first position
of the part is an earlier one, m grows by 2^k. A part's first position is that of one of its members that stand
at m, or that of the whole interval, since any other has an earlier copy of its own. What is left is, for every
position, the longest run from it on that has an earlier copy, by (doc_id, text hash, line).

A run counts from ``min_words`` words (a parameter of the result: a repeated footer of 12 words stays at 50), measured on
the maximal run. Of every maximal run of which an earlier copy exists all lines go; the first copy stays.

Edge cases: null texts stay null and empty ones empty; lines without words are in no run and stay, unless
all lines with words go: then the text is empty; a copy of a run within one document counts (the
first stays); rows with equal ids and other texts are documents of their own; rows equal in id and text are one
document met again, and get equal results; rows with a null id stay as they are and are no copies; an empty table
gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm._common import Scratch, frugal, read_table, slices

MIN_WORDS = 50


def lines_of(text: str | None, min_words: int) -> tuple[list[int], list[int], np.ndarray]:
    """Of each line with a word: its 64-bit id, its words, and the least number of lines from it on that have min_words words (0: fewer are left)."""
    ids, words = [], []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        w = len(line.split())
        if w:
            ids.append(xxhash.xxh3_64_intdigest(line.strip()) - (1 << 63))
            words.append(w)
    upto = np.r_[0, np.cumsum(np.array(words, np.int64))]
    need = np.searchsorted(upto, upto[:-1] + min_words, "left") - np.arange(len(words))
    need[upto[:-1] + min_words > upto[-1]] = 0
    return ids, words, need


def _lines(min_words: int):
    def run(col: pa.Array) -> pa.Array:
        got = [lines_of(v.as_py(), min_words) for v in col]
        lists = [pa.array([g[k] for g in got], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
        return pa.StructArray.from_arrays(lists, ["ids", "words", "need"])

    return F.arrow_udf(frugal(run), "struct<ids:array<bigint>,words:array<int>,need:array<int>>")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, at, m): from line `at` (counting lines with a word from 0) a maximal run of m lines that occurred before; h: xxhash64 of the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    place, key = F.struct("doc_id", "h", "at"), ["doc_id", "h", "at"]
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), _lines(min_words)(F.col(text_col)).alias("l"))
    rows = scratch.write(rows.select("doc_id", "h", F.posexplode(F.arrays_zip("l.ids", "l.words", "l.need")).alias("at", "x")).select(*key, F.col("x.words").alias("words"), F.col("x.ids").alias("r"), F.col("x.need").alias("need")))
    # written first, here and below, so that the join has a shuffle of its own, of which Spark can split the large partitions
    twice = scratch.write(rows.groupBy("r").agg(F.min(place).alias("f"), F.max(place).alias("z")).filter("f < z").select("r", "f"))
    first = scratch.write(rows.join(twice, "r").select(*key, "words", "need", "r", "f").distinct())
    scratch.drop(rows, twice)
    # a run that counts lies within neighbouring repeated lines of min_words words or more
    island = Window.partitionBy("doc_id", "h")
    islands = first.withColumn("i", F.col("at") - F.row_number().over(island.orderBy("at"))).withColumn("sum", F.sum("words").over(Window.partitionBy("doc_id", "h", "i")))
    ranks = [scratch.write(islands.filter(F.col("sum") >= min_words).select(*key, "need", "r", "f"))]  # a line's id is its rank by one line
    scratch.drop(first)
    while True:
        size = 1 << (len(ranks) - 1)
        step = Window.partitionBy("doc_id", "h").orderBy("at").rangeBetween(size, size)
        both = ranks[-1].select(*key, "need", F.col("r").alias("a"), F.first("r").over(step).alias("b")).filter("b IS NOT NULL")
        again = both.groupBy("a", "b").agg(F.min(place).alias("f"), F.max(place).alias("z")).filter("f < z").select("a", "b", "f")
        # the number of a row among range partitions, sorted: ascends as the pairs do (written once, so it holds)
        order = scratch.write(again.repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("a", "b", "f", F.monotonically_increasing_id().alias("r")))
        if order.isEmpty():
            scratch.drop(order)
            break
        ranks.append(scratch.write(both.join(order, ["a", "b"]).select(*key, "need", "r", "f")))
        scratch.drop(order)
    state = None
    for k in range(len(ranks) - 1, -1, -1):
        size, later = 1 << k, ranks[k].filter(F.col("f") < place)
        top = later.select(*key, "need", "f", F.lit(size).alias("m"))
        if state is not None:
            top = top.join(ranks[k + 1].filter(F.col("f") < place).select(*key), key, "left_anti")
            first = state.select("f", "m").distinct().select("f.doc_id", "f.h", "f.at", F.lit(None).cast("int").alias("need"), "f", "m")
            follow = ranks[k].select("doc_id", "h", F.col("at").alias("end"), "r")
            asked = state.union(first).withColumn("end", (F.col("at") + F.col("m")).cast("int")).join(follow, ["doc_id", "h", "end"], "left")
            asked = scratch.write(asked.select(*key, "need", "f", "m", "r"))
            part = scratch.write(asked.filter("r IS NOT NULL").groupBy("f", "m", "r").agg(F.min(place).alias("g"), F.count("*").alias("n")).filter("n > 1").drop("n"))
            grows = F.coalesce(F.col("g") < place, F.lit(False))
            longer = asked.filter("need IS NOT NULL").join(part, ["f", "m", "r"], "left").select(*key, "need", F.when(grows, F.col("g")).otherwise(F.col("f")).alias("f"), (F.col("m") + F.when(grows, size).otherwise(0)).cast("int").alias("m"))
            top = longer.union(top)
        old, state = state, scratch.write(top)
        if old is not None:
            scratch.drop(old, asked, part, ranks[k + 1])
    # a run within the one that begins a line before is no maximal one
    before = Window.partitionBy("doc_id", "h").orderBy("at").rangeBetween(-1, -1)
    runs = state.filter("need > 0 AND m >= need").select(*key, "m", F.first("m").over(before).alias("p"))
    out = scratch.write(runs.filter("p IS NULL OR p <= m").select(*key, "m"))
    scratch.drop(state, ranks[0])
    return out


def strip_lines(text: str | None, runs: list[tuple[int, int]]) -> tuple[str | None, list[int]]:
    """The text without the runs' lines, and the numbers (from 0, of all lines) of those that went."""
    if text is None or not runs:
        return text, []
    gone, end = set(), 0
    for at, m in sorted(runs):
        gone.update(range(max(at, end), at + m))
        end = max(end, at + m)
    kept, went, k, left = [], [], -1, 0
    for i, line in enumerate(text.split("\n")):
        if line.encode("utf-8", "surrogatepass").split():
            k += 1
            if k in gone:
                went.append(i)
                continue
            left += 1
        kept.append(line)
    return ("\n".join(kept) if left else ""), went


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", lines_col: str | None = None) -> DataFrame:
    """The documents, columns as given, their texts without later copies of repeated runs; lines_col gets the numbers of the lines that went."""
    names = docs.columns
    runs = repeated_runs(docs, min_words, id_col, text_col)
    per_doc = runs.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_list(F.struct("at", "m")).alias("__w"))
    per_doc = per_doc.hint("merge")  # as many rows as documents with repeats: not for broadcast at any size
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("__row") if len(names) > 1 else F.lit(None).alias("__row"), F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))

    def run(text: pa.Array, windows: pa.Array) -> pa.Array:
        parts = []
        for i, n in slices(text, 256, 1 << 21):
            got = [strip_lines(t, [(w["at"], w["m"]) for w in ws or []]) for t, ws in zip(text.slice(i, n).to_pylist(), windows.slice(i, n).to_pylist(), strict=True)]
            parts.append(pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.int32()))], ["text", "went"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("text", pa.string()), ("went", pa.list_(pa.int32()))]))

    strip = F.arrow_udf(frugal(run), "struct<text:string,went:array<int>>")
    hit = F.col("__w").isNotNull()
    j = rows.join(per_doc, (F.col("__doc") == F.col("__id")) & (F.xxhash64("__text") == F.col("__h")), "left")
    # no text without a run goes to Python
    j = j.select("__row", "__text", hit.alias("__hit"), strip(F.when(hit, F.col("__text")), F.col("__w")).alias("__s"))
    text = F.when(F.col("__hit"), F.col("__s.text")).otherwise(F.col("__text"))
    went = F.when(F.col("__hit"), F.col("__s.went")).otherwise(F.array().cast("array<int>"))
    return j.select(*[text.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in names], *([went.alias(lines_col)] if lines_col else []))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text after line dedup, and which of its lines went (numbers from 0, comma-joined)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, lines_col="went")
    return out.select("doc_id", "text", F.size("went").cast("long").alias("n_deleted"), F.array_join(F.col("went").cast("array<string>"), ",").alias("deleted_lines"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents after line dedup; those of which all lines with words went are gone."""
    out = dedup_lines(docs, lines_col="__went")
    return out.filter((F.size("__went") == 0) | (F.col("text") != "")).drop("__went")


#: By other means: a line is in a repeated run of 50 words exactly if the least window of 50 words from some line on, or
#: up to some line, that holds it occurred before.
ORACLE = r"""
WITH l AS (SELECT doc_id, i - 1 AS i, list_extract(string_split(text, chr(10)), i) AS line
           FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
s AS (SELECT doc_id, i, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos,
        sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w WHERE n > 0),
win AS (SELECT a.doc_id, a.pos AS x, min(b.pos) AS y FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= 50 GROUP BY ALL
        UNION
        SELECT b.doc_id, max(a.pos), b.pos FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= 50 GROUP BY b.doc_id, b.pos),
c AS (SELECT win.doc_id, x, y, string_agg(line, chr(10) ORDER BY pos) AS body FROM win JOIN s ON win.doc_id = s.doc_id AND s.pos BETWEEN x AND y GROUP BY ALL),
late AS (SELECT doc_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, x) AS k FROM c) WHERE k > 1),
gone AS (SELECT DISTINCT s.doc_id, s.i FROM late JOIN s ON late.doc_id = s.doc_id AND s.pos BETWEEN x AND y),
k AS (SELECT w.doc_id, string_agg(line, chr(10) ORDER BY w.i) FILTER (WHERE gone.i IS NULL) AS kept, count(gone.i) AS n_deleted,
        string_agg(gone.i::VARCHAR, ',' ORDER BY gone.i) AS deleted, bool_or(n > 0 AND gone.i IS NULL) AS any_left
      FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(n_deleted, 0) = 0 THEN text WHEN any_left THEN kept ELSE '' END AS text,
  coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(deleted, '') AS deleted_lines
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""

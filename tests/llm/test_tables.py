"""Operators on whole tables: mixing, language, quality, rules, the pipeline."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import langid, mixing, quality_model, quality_rules, registry
from sluice.llm._common import crc_mod_py

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, size string, row int"
ROWS = [(1, "a b c", "en", "s1", 5, "x", 1), (2, None, None, None, None, None, None), (3, "", "en", "s1", 0, "x", 1), (4, "a b c", "en", "s1", 5, "x", 1), (5, "123 !!", "fr", "s2", 6, "x", 2), (5, "123 !!", "fr", "s2", 6, "x", 2), (6, "mot " * 500, "fr", "s2", 2000, "x", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, ODD)


def sql(query, docs=None):
    con = duckdb.connect()
    if docs is None:
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    else:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT, size VARCHAR, row INT)")
        if docs:
            con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?, ?, ?)", docs)
    cur = con.execute(query)
    return [d[0] for d in cur.description], sorted(cur.fetchall(), key=str)


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    names, want = sql(registry.ORACLE_SQL[name])
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == want


def test_mix_of_odd_rows(spark, odd):
    decided, _ = mixing.plan(odd)
    got = sorted(((r.doc_id, r["size"], r.source_size, r.target, r["size"] * r.copies) for r in decided.collect()), key=str)
    assert got == sql(mixing.ORACLE, ROWS)[1]
    assert mixing.expand(odd).columns == odd.columns and mixing.expand(odd.limit(0)).count() == 0
    copies = {}
    for r in mixing.expand(odd).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert {d: c for d, c in copies.items() if d in (1, 4, 6)} == {r.doc_id: r.copies for r in decided.collect() if r.copies and r.doc_id in (1, 4, 6)}


def test_mix_meets_its_targets(spark):
    rows = mixing.op4_mix_sources(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op4_mix_sources(spark, SF).collect()))
    assert all(r.taken <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        t = by.setdefault(r.target, [0, 0])
        t[0] += r.taken
        t[1] = max(t[1], r["size"])
    assert len(by) > 1 and abs(sum(r["size"] for r in rows) * 1.5 - sum({(r.source_size, r.target): r.target for r in rows}.values())) < 1e-6 * 1e6


def test_rules_of_odd_rows(spark, odd):
    got = quality_rules.judge(odd).drop("broken_rule")
    names, want = sql(quality_rules.ORACLE, ROWS[:4] + ROWS[4:5] + ROWS[6:])
    have = sorted((tuple(r[n] for n in names) for r in quality_rules.judge(odd.dropDuplicates()).collect()), key=str)
    assert have == want and got.count() == len(ROWS) and quality_rules.judge(odd.limit(0)).count() == 0


def test_rules_use_no_python(spark):
    plan = quality_rules.op10_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sketch_buckets(spark):
    v = [0, 1, 31, 32, 33, 34, 63, 64, 1000, 123456789]
    r = spark.createDataFrame([(x,) for x in v], "v long").select("v", quality_rules.bucket(F.col("v")).alias("b")).select("v", "b", quality_rules.bucket_floor(F.col("b")).alias("f")).collect()
    assert all(x.f <= x.v <= x.f * 17 / 16 + 1 for x in r) and [x.b for x in r] == sorted(x.b for x in r)


def test_language_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op5_language_id(spark, SF).collect()
    assert all(r.held_out == (crc_mod_py(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_of_odd_rows(spark, odd):
    model = langid.fit(odd.filter("lang is not null and text is not null"))
    rows = odd.select("doc_id", langid.prediction(spark, model, F.col("text")).alias("p")).select("doc_id", "p.*").collect()
    assert {r.doc_id: r.lang_pred for r in rows} == {1: "en", 2: "und", 3: "und", 4: "en", 5: "und", 6: "fr"}
    assert langid.keep_identified(spark, odd).columns == odd.columns
    assert [r.lang_pred for r in odd.select(langid.prediction(spark, langid.fit(odd.limit(0)), F.col("text")).alias("p")).select("p.*").collect()] == ["und"] * len(ROWS)


def test_language_of_a_long_text_does_not_depend_on_its_parts(spark, odd):
    model = langid.fit(odd.filter("lang is not null and text is not null"))
    text = "abc mot " * 3000
    assert model.scores([text], part=500)[1][0] == pytest.approx(model.scores(["x", text, "mot"])[1][1], abs=1e-9)


def test_quality_on_held_out_documents(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality_model.op6_quality_classifier(spark, SF).collect()
    assert all(r.held_out == (crc_mod_py(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(label[r.doc_id] == r.predicted for r in held) >= 0.95 * len(held)


def test_quality_of_odd_rows(spark, odd):
    model = quality_model.fit(odd.withColumn("quality", F.when(F.col("doc_id") == 6, 0).otherwise(1)))
    got = {r.doc_id: r.s for r in odd.select("doc_id", quality_model.score(spark, model, F.col("text")).alias("s")).collect()}
    assert got[2] == got[3] and got[1] == got[4] and got[6] < 0.5 < got[1]
    empty = quality_model.fit(odd.limit(0).withColumn("quality", F.lit(1)))
    assert empty.scores(["a", None]).tolist() == [0.5, 0.5]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        out = stage(spark, docs, SF).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == names
        if name == "mix_sources":
            sizes = mixing.word_count(F.col("text"))
            assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2 and out.agg(F.sum(sizes)).first()[0] > 0
        elif name != "sentencepiece":
            assert 0.8 * before <= out.count() <= before
        else:
            assert out.count() == before and out.filter("NOT round_trip").count() == 0
        docs = out


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_language_document_frequencies_come_from_all_rows(spark):
    rows = [(i, f"w{i % 7} {'the house' if i % 2 else 'la maison'} {chr(97 + i % 26) * 3}", "en" if i % 2 else "fr") for i in range(80)] + [(80, "12", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    n, freq = langid.document_frequencies(df)
    want = np.zeros(1 << langid.BITS, np.int64)
    for _, t, _ in rows[:-1]:
        want[langid.text_counts(t)[0]] += 1
    assert n == 80 and (freq == want).all()
    picked = {int(r.id) for r in langid.sample(df, 5, "doc_id", "text", "lang").collect()}
    other = df.withColumn("text", F.when(F.col("doc_id").isin(picked), F.col("text")).otherwise(F.lit("the maison")))
    assert not np.array_equal(langid.fit(df, sample_per_lang=5).weights, langid.fit(other, sample_per_lang=5).weights)


def test_language_scores_against_plain_sums(spark, odd):
    """Features and scores by plain loops over every 1- to 3-gram."""
    model = langid.fit(odd.filter("lang is not null and text is not null"))
    mask = (1 << 64) - 1
    mul = [int(x) for x in langid._MUL]

    def plain(text):
        t = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
        total, n = np.zeros(len(model.langs)), 0
        padded = t + " "
        for i in range(len(t) - 1):
            h = 0
            for k in range(3):
                h = ((h ^ ord(padded[i + k])) * mul[k]) & mask
                h ^= h >> 29
                total += model.weights[((h * mul[0]) & mask) >> (64 - langid.BITS)]
                n += 1
        z = (total / n + model.bias) / model.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    for text in ["the a mot", "Mot, mot!  b c", "x", "été là"]:
        p = plain(text)
        langs, probs = model.scores([text])
        assert langs == [model.langs[p.argmax()]] and probs[0] == pytest.approx(p.max(), abs=1e-4)


def test_quality_scores_against_plain_means():
    """A word's value is the mean over its features, a document's the mean over its words, by plain loops."""
    rng = np.random.default_rng(3)
    model = quality_model.QualityModel(rng.normal(size=1 << quality_model.BITS).astype(np.float32), 0.25)
    mask, p, q = (1 << 64) - 1, int(quality_model._P), int(quality_model._Q)

    def buckets(word):
        chars = [ord(c) for c in word]
        whole = 0
        for c in chars:
            whole = ((whole ^ c) * p) & mask
            whole ^= whole >> 31
        out = [(((whole + 7) * q) & mask) >> (64 - quality_model.BITS)]
        for i in range(len(chars)):
            h = 0
            for k in range(min(quality_model.ORDERS, len(chars) - i)):
                h = ((h ^ chars[i + k]) * p) & mask
                h ^= h >> 29
                out.append((((h + k) * q) & mask) >> (64 - quality_model.BITS))
        return out

    for text in ["one two two", "été", "a b a b", "longer words are here here here"]:
        words = [w.decode() for w in quality_model.words_of(text)]
        z = np.mean([np.mean([model.value[b] for b in buckets(w)]) for w in words]) + model.bias
        assert model.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_labelled_sample_takes_ids_from_the_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(3, "again"), (None, "x")], "doc_id long, text string").withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None), (8, 5)], "doc_id long, quality int")
    rows = quality_model.labelled_sample(docs, labels, sample_per_label=10).collect()
    assert all(r.quality == r.doc_id % 2 for r in rows) and len({r.doc_id for r in rows}) <= 20
    every = quality_model.labelled_sample(docs, labels).collect()
    assert len(every) == 51 and {r.doc_id for r in rows} <= {r.doc_id for r in every}


def test_dirty_languages_are_bounded(spark):
    df = spark.createDataFrame([(i, "the house", "en" if i % 3 else f"dirt{i}") for i in range(30)], "doc_id long, text string, lang string")
    assert langid.fit(df, max_langs=1).langs == ["en"] and len(langid.fit(df).langs) == 11


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    """Nulls, empty texts, repeated rows and an empty table go through every stage; columns stay."""
    for k, docs in enumerate((odd, odd.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "sentencepiece":
                assert out.columns == odd.columns
            out.write.parquet(path := f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(path)
        assert docs.count() == 0 if k else docs.filter("NOT round_trip").count() == 0

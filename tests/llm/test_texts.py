"""Operators on single texts: personal data, pieces, token counts, line dedup."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import line_dedup, pieces, pii, token_counts

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    return {
        "email": [m.span() for m in EMAIL.finditer(t)], "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))], "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15],
    }


def test_plain_detectors_against_patterns():
    rng = random.Random(1)
    for _ in range(8000):
        t = "".join(rng.choice(["a", "b", ".", "@", "-", "+", "%", " ", "0", "19", "(", "4111111111111111", "é", "255."]) for _ in range(rng.randint(0, 40)))
        assert pii.detect(t) == plain(t), t


@pytest.mark.parametrize("text, kind, found", [
    ("mail bob [at] ex-ample (dot) com now", "email", "bob [at] ex-ample (dot) com"),
    ("bob at example dot com", "email", "bob at example dot com"),
    ("аdmin@еxample.cоm", "email", "аdmin@еxample.cоm"),
    ("card 4 1 1 1 one one one one 1111 1111", "card", "4 1 1 1 one one one one 1111 1111"),
    ("+1 seven four three five five five three eight two four", "phone", "+1 seven four three five five five three eight two four"),
    ("ip 192.168.1.１ here", "ip", "192.168.1.１"),
    ("a@b​.com", "email", "a@b​.com"),
])
def test_disguises_map_back_to_the_source(text, kind, found):
    base, every = pii.find(text)
    assert [text[a:b] for a, b in every[kind]] == [found]
    assert all(any(x[0] <= a and b <= x[1] for x in every[k]) for k in pii.KINDS for a, b in base[k] if k != kind)


def test_clean_texts_stay_clean():
    for t in ["", None, "meet at noon dot the i", "un deux trois", "one two three", "Привет, мир", "version 1.2.3", "call 555-1234", "a [at] b"]:
        assert not any(pii.find(t)[1].values()), t
    assert pii.redact("write a@b.co now") == "write [email] now" and pii.redact(None) is None


def test_pii_is_linear_in_long_texts():
    for t in ["1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "one " * 50_000]:
        pii.find(t)


def test_pii_query_columns(spark):
    df = spark.createDataFrame([(1, "x a@b.co 1.2.3.4"), (2, None), (3, "")], "doc_id long, text string")
    rows = df.select("doc_id", pii.spans(F.col("text")).alias("p")).select("doc_id", "p.*").collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.spans) for r in rows} == {1: (1, 1, "email:2:8,ip:9:16"), 2: (0, 0, ""), 3: (0, 0, "")}


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load(pieces.MODEL_FILE)


def test_pieces_equal_the_librarys(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    rng = random.Random(3)
    alphabet = [*"abcdeiontrs  \n", "the", "ing", " of", "é", "ß", "😀", "中", "国", "\t", "   ", "ö", "1", "."]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["x" * 50 + " " * 60 + "abc", "   ", "", "hello   world", "a" * 3000, "▁▁a", "\u0000x", "中" * 700]
    got = model.encode(texts)
    for t, g in zip(texts, got, strict=True):
        assert g.tolist() == sp.encode(t), t
        assert model.decode(g) == sp.decode(g.tolist())
    assert model.encode([None]) == [None] and model.decode(None) is None


def test_pieces_in_spark_round_trip(spark):
    df = spark.createDataFrame([(1, "The  cat\nsat 😀"), (2, None), (3, ""), (4, "é" * 9000)], "doc_id long, text string").withColumn("ids", F.lit(1))
    rows = {r.doc_id: r for r in pieces.encoded(spark, df).collect()}
    assert all(r.round_trip for r in rows.values()) and rows[2].ids is None and rows[3].ids == [] and rows[4].n_ids == len(rows[4].ids)


def test_small_model_without_byte_fallback():
    m = pieces.PieceModel.build(["<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a"], ["unknown"] + ["normal"] * 7, [0, -9, -9, -1, -2, -3, -9, -4])
    assert [[m.pieces[i] for i in x] for x in m.encode(["aba", "bab", "xxab", "b"])] == [["▁", "aba"], ["▁", "b", "ab"], ["▁", "<unk>", "ab"], ["▁", "b"]]


def tokens_by_hand(enc, text, cuts, rule):
    out, pos = [0.0] * (len(cuts) - 1), 0
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    for t in enc.encode_ordinary(text):
        n = len(enc.decode_single_token_bytes(t))
        sec = [max(k for k in range(len(cuts) - 1) if cuts[k] <= c) for c in sorted(set(owner[pos : pos + n]))]
        pos += n
        if rule == "share":
            for s in sec:
                out[s] += 1 / len(sec)
        else:
            out[{"start": sec[0], "end": sec[-1], "most": max(sorted(set(sec)), key=lambda s: (sec.count(s), -s))}[rule]] += 1
    return out


def test_token_counts_by_hand():
    with open(token_counts.RANK_FILE, "rb") as f:
        e = token_counts.Encoder(f.read())
    rng = random.Random(1)
    for _ in range(400):
        t = "".join(rng.choice(["a", "the", " ", "\n", "\n\n", "é", "😀", "中", "  ", "x1"]) for _ in range(rng.randint(0, 25)))
        cuts = token_counts.line_sections(t)
        if rng.random() < 0.5 and len(t) > 2:
            cuts = np.unique(np.r_[0, sorted(rng.sample(range(1, len(t)), min(3, len(t) - 1))), len(t)])
        for rule in token_counts.RULES:
            got = token_counts.attribute(*token_counts.token_spans(e, t), cuts, rule)
            assert np.allclose(got, tokens_by_hand(e.get()[0], t, cuts, rule)), (t, cuts, rule)


def test_token_counts_in_spark(spark):
    df = spark.createDataFrame([(1, "one two\nthree"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r.s for r in df.select("doc_id", token_counts.section_tokens(spark, F.col("text")).alias("s")).collect()}
    assert [(s.start, s.end) for s in rows[1]] == [(0, 8), (8, 13)] and rows[2] is None and [(s.start, s.end, s.tokens) for s in rows[3]] == [(0, 0, 0.0)]
    with pytest.raises(ValueError):
        token_counts.section_tokens(spark, F.col("text"), rule="other")


@pytest.mark.parametrize("least", [1, 12, 25])
def test_line_dedup_against_all_runs(spark, least):
    rng = random.Random(4)
    lines = ["w" + str(i) + " b" * rng.randint(0, 6) for i in range(12)] + [" ", "", "\t"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "w1\nw2")]
    rows += [(1004, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit("clash")).withColumn("m", F.lit(2))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df, lines_col="went", min_words=least).collect()}
    want = runs_with_an_earlier_copy(rows, least)
    for d, t in rows:
        words = [i for i, x in enumerate((t or "").split("\n")) if x.encode().split()]
        went = sorted(words[k] for k in want[d])
        assert out[d].went == went
        left = [x for i, x in enumerate((t or "").split("\n")) if i not in went]
        assert out[d].text == (t if not went else "\n".join(left) if len(went) < len(words) else "")
        assert (out[d].at, out[d].m) == ("clash", 2)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_documents_that_are_all_repeats_go(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text), (3, ""), (4, None), (5, "x\n" + text)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(df).collect()} == {1: text, 3: "", 4: None, 5: "x"}


def runs_with_an_earlier_copy(rows, least):
    """Of each document the lines in any run of least words or more that occurred before: all runs against all positions before."""
    gone, seen = {}, set()
    for d, t in sorted(rows, key=lambda x: x[0]):
        s = [(x.encode().strip(), len(x.encode().split())) for x in (t or "").split("\n") if x.encode().split()]
        gone[d] = set()
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if sum(x[1] for x in s[i:j]) >= least:
                    k = tuple(x[0] for x in s[i:j])
                    if k in seen:
                        gone[d].update(range(i, j))
                    seen.add(k)
    return gone


@pytest.mark.parametrize("least", [1, 12, 25])
def test_later_copies_of_maximal_runs_go_whole(spark, least):
    rng = random.Random(6)
    lines = ["w" + str(i) + " b" * rng.choice([0, 0, 1, 3, 9, 30]) for i in range(14)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [(100 + i, "x y\n" + rows[i][1] + "\nz") for i in range(10)] + [(200 + i, rows[i][1]) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.went for r in line_dedup.dedup_lines(df, lines_col="went", min_words=least).collect()}
    want = runs_with_an_earlier_copy(rows, least)
    assert out == {d: sorted(want[d]) if t else [] for d, t in rows}


def test_line_dedup_query_takes_short_last_lines(spark, tmp_path):
    shapes = [(93, 2), (20, 49, 18, 2), (49, 1), (2, 93), (60, 1, 1, 1)]
    texts = ["\n".join(" ".join(f"s{k}l{j}w{i}" for i in range(n)) for j, n in enumerate(s)) for k, s in enumerate(shapes)]
    rows = [(c * 10 + k, t) for c in range(3) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.text, [int(i) for i in r.deleted_lines.split(",") if i]) for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert out == {d: (t, []) if d < 10 else ("", list(range(len(shapes[d % 10])))) for d, t in rows}


@pytest.mark.parametrize("text, kind, found", [
    ("x bob [at] mail7 dot example dot com y", "email", "bob [at] mail7 dot example dot com"),
    ("bob@mail7 dot example dot com", "email", "bob@mail7 dot example dot com"),
    ("bob at mail7 [dot] example [dot] com", "email", "bob at mail7 [dot] example [dot] com"),
    ("bob at example dot xyz", "email", "bob at example dot xyz"),
    ("bob@example dot photography", "email", "bob@example dot photography"),
    ("bob dot lee at example dot com", "email", "bob dot lee at example dot com"),
    ("bob at mail dot example.com, or", "email", "bob at mail dot example.com"),
    ("bob at example dot com dot Thanks", "email", "bob at example dot com"),
    ("from 192 dot 168 dot 1 dot 1 on", "ip", "192 dot 168 dot 1 dot 1"),
    ("192.168 dot 1 (dot) 1", "ip", "192.168 dot 1 (dot) 1"),
    ("mail joe at example.com now", "email", "joe at example.com"),
    ("joe @ example . com, please", "email", "joe @ example . com"),
    ("(joe_at_example_dot_com)", "email", "joe_at_example_dot_com"),
    ("bob.lee at mail.example.co.uk!", "email", "bob.lee at mail.example.co.uk"),
    ("call +1 (five five five) one two three four five six seven", "phone", "+1 (five five five) one two three four five six seven"),
])
def test_mixed_disguises(text, kind, found):
    every = pii.find(text)[1]
    assert [text[a:b] for a, b in every[kind]] == [found] and pii.redact(text) == text.replace(found, f"[{kind}]")


def test_mixed_disguises_leave_prose():
    for t in ["look at example.com dot", "he sat at noon dot the end", "999 dot 1 dot 1 dot 1", "1 dot 2 dot 3", "bob at the dot [dot] ", "[dot] at a.b", "look at example.com", "see us at example.com now", "he sat at noon.The end", "dinner @ home . the"]:
        assert not any(pii.find(t)[1].values()), t
    for t in ["a dot " * 40_000, "a at b dot " * 20_000, "[dot]" + "1 dot " * 40_000, "[dot]" + "a@a." * 50_000]:
        pii.find(t)


@pytest.mark.parametrize("text, wide, base", [
    ("to jоhn@mail7.example.com.", "jоhn@mail7.example.com", "hn@mail7.example.com"),
    ("to john@mail7.example.cоm.", "john@mail7.example.cоm", "john@mail7.example.c"),
    ("to jo​hn@mail7.example.com.", "jo​hn@mail7.example.com", "hn@mail7.example.com"),
    ("to bob@mail7.example dot com.", "bob@mail7.example dot com", "bob@mail7.example"),
])
def test_cut_base_spans_are_widened(spark, text, wide, base):
    assert [text[a:b] for a, b in pii.find(text)[0]["email"]] == [base]
    assert {text[a:b] for a, b in pii.find(text)[1]["email"]} == {wide, base}
    assert pii.redact(text) == "to [email]."
    assert spark.createDataFrame([(text,)], "text string").select(pii.spans(F.col("text")).alias("p")).first().p.n_email == 1


def test_no_exact_copy_survives_the_pipelines_dedup(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(8)
    texts = ["\n".join(" ".join(f"d{k}l{j}w{i}" for i in range(n)) for j, n in enumerate([93, *(rng.randint(1, 40) for _ in range(rng.randint(0, 4))), rng.randint(1, 12)])) for k in range(12)]
    new = spark.createDataFrame([(10_000_000 + c * 100 + k, t) for c in range(3) for k, t in enumerate(texts)], "doc_id long, text string")
    one = docs.drop("doc_id", "text").limit(1)
    docs = new.crossJoin(one).select(*docs.columns)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("line_dedup", "minhash_near_dedup"):
        stages[name](spark, docs, "").write.parquet(out := f"{tmp_path}/{name}")
        docs = spark.read.parquet(out)
        assert {r.doc_id: r.text for r in docs.collect()} == {10_000_000 + k: t for k, t in enumerate(texts)}, name


def test_line_dedup_of_odd_rows(spark):
    """Equal ids with other texts, equal rows, null ids, one line many times, clashing names."""
    run = "\n".join(f"line {i} " + "w " * 20 for i in range(5))
    rows = [(1, run, 0), (2, run + "\nunique only line " + "u " * 60, 1), (2, "another text\n" + run, 2), (None, run, 3), (None, None, 4), (7, run, 5), (7, run, 5), (8, "\n".join(["same same"] * 200), 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int").withColumn("r", F.lit("clash"))
    out = line_dedup.dedup_lines(df, lines_col="went").collect()
    got = {r.h: (r.doc_id, r.text, r.went) for r in out}
    assert len(out) == len(rows) and {r.r for r in out} == {"clash"}
    assert got[0][1] == run and got[1][1] == "unique only line " + "u " * 60 and got[2][1] == "another text"
    assert got[3][1:] == (run, []) and got[4][1] is None and [r.text for r in out if r.h == 5] == ["", ""]
    # of 200 equal lines any 25 have 50 words: the runs from line 1 on have an earlier copy, so one line stays
    assert got[6][1] == "same same" and got[6][2] == list(range(1, 200))


def test_maximal_runs_are_found(spark):
    words = [" ".join(f"a{i}w{j}" for j in range(30)) for i in range(9)]
    rows = [(1, "\n".join(words)), (2, "\n".join(["x", *words[2:7], "y"])), (3, "\n".join([*words[4:9], "z"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.at, r.m) for r in line_dedup.repeated_runs(df).collect()} == {(2, 1, 5), (3, 0, 5)}


def test_planted_disguises_are_found():
    """Of each kind and disguise, spans that cover what was planted, in prose."""
    rng = random.Random(9)
    words = "the of and house river over quiet morning near walk stone".split()
    digit = dict(zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True))
    wide = lambda t: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in t)
    email = [lambda a: a, lambda a: a.replace("@", " [at] ").replace(".", " [dot] "), lambda a: a.replace("@", " at ").replace(".", " dot "), lambda a: a.replace("@", " at "), lambda a: a.replace("@", " @ ").replace(".", " . "), lambda a: a.replace("@", "_at_").replace(".", "_dot_"), lambda a: a.replace("a", "а").replace("o", "о"), lambda a: a[0] + "\u200b" + a[1:], lambda a: a.replace("@", "(at)"), lambda a: a.replace(".", " dot ")]
    ip = [lambda a: a, lambda a: a.replace(".", " dot "), lambda a: a.replace(".", "[.]"), wide]
    spell = lambda t: " ".join(digit.get(c, c) for c in t if c != " ")
    ways = {"email": email, "ip": ip, "card": [lambda a: a, spell, wide], "phone": [lambda a: a, wide, lambda a: "+" + spell(a[1:])]}
    for kind, forms in ways.items():
        for k, form in enumerate(forms):
            hits = 0
            for _ in range(40):
                plant = {"email": f"{rng.choice(['anna', 'bob', 'carol'])}{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", "ip": ".".join(str(rng.randint(1, 255)) for _ in range(4)), "card": "4111 1111 1111 1111", "phone": f"+1{rng.randint(200, 999)}{rng.randint(1000000, 9999999)}"}[kind]
                head = " ".join(rng.choice(words) for _ in range(12))
                text = f"{head}: {form(plant)}; {head}."
                a, b = len(head) + 2, len(head) + 2 + len(form(plant))
                hits += any(x <= a and b <= y for x, y in pii.find(text)[1][kind])
            assert hits >= 36, (kind, k, hits)


def test_token_counts_of_very_long_runs(monkeypatch):
    with open(token_counts.RANK_FILE, "rb") as f:
        e = token_counts.Encoder(f.read())
    for c in " \n\ta1.":
        text = "x" + c * 2_000_000 + "y"
        starts, ends = token_counts.token_spans(e, text)
        assert starts[0] == 0 and ends[-1] == len(text) and (starts[1:] == ends[:-1]).all()
    monkeypatch.setattr(token_counts, "LONG", 3)
    monkeypatch.setattr(token_counts, "LONG_SPACE", re.compile(r"\s{3,}"))
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["a", " ", "  ", "\n", " \t", "1", ".", "'s", "é", "     "]) for _ in range(rng.randint(0, 14)))
        assert e.ids(text) == e.get()[0].encode_ordinary(text)


def test_long_cuts_and_a_full_cache_change_nothing(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    m = pieces.PieceModel.load(pieces.MODEL_FILE)
    rng = random.Random(5)
    for _ in range(30):
        text = pieces.MARK + "".join(rng.choice(["a", "b", "the", "ing", "er", "s", "中", "tion"]) for _ in range(200))
        assert m.segment_long(text, window=rng.choice([17, 64, 1000])).tolist() == sp.encode(text[1:])
    monkeypatch.setattr(pieces, "CACHED", 300)
    for _ in range(20):
        texts = [" ".join(rng.choice(["house", "river", "don't", "x1", "é", "end."]) + str(rng.randint(0, 60)) for _ in range(30)) for _ in range(5)]
        assert [x.tolist() for x in m.encode(texts)] == [sp.encode(t) for t in texts]


def test_pieces_of_an_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, None)], "doc_id long, text string")
    rows = pieces.encoded(spark, df).collect()
    assert len(rows) == 3 and [r.ids for r in rows if r.doc_id == 1][0] == [r.ids for r in rows if r.doc_id == 1][1]
    assert pieces.encoded(spark, df.limit(0)).count() == 0
    none = df.limit(0)
    assert none.select(token_counts.section_tokens(spark, F.col("text"))).count() == 0 and none.select(pii.spans(F.col("text"))).count() == 0

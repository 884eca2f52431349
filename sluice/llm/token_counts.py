"""Token counts of document sections by offset-mapped attribution.

A document is encoded once, whole. Its tokens' byte lengths add up to character spans; its sections are
character spans too (by default its lines, each with its line break). An interval join of the two ordered
lists attributes every token, and a token that crosses a border goes by an explicit rule:

- ``start``: to the section that holds its first character (where that character's first byte is in the token
  before it, the character still counts as its own);
- ``end``: to the section that holds its last character;
- ``most``: to the section with most of its characters, the earlier one in a tie (the default);
- ``share``: to each section in proportion to its characters.

Whatever the rule, a document's section counts add up to its token count. Vocabularies are rank files of
byte-level merges; the driver reads the file and sends it to the executors.

Edge cases: a null text has no sections and 0 tokens; an empty one has one empty section with 0 tokens;
special tokens' strings in a text are ordinary text; repeated rows are counted alike, each row giving a row; null
and repeated ids are passed on; an empty table gives no rows; other columns are ignored. Texts are encoded whole,
however long: white space in runs of 65536 characters or more, on which the pattern's engine would give up, is cut out
where the pattern would cut it and merged for itself.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import frugal, read_table

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how such vocabularies split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "most", "share")
#: White space in such runs, or longer, goes round the pattern's engine, which gives up on very long ones.
LONG = 65536
LONG_SPACE = re.compile(rf"\s{{{LONG},}}")


class Encoder:
    """A byte-level encoder and the byte length of each of its tokens; built once in each process."""

    def __init__(self, raw: bytes, pattern: str = PATTERN):
        self.raw, self.pattern, self.made = raw, pattern, None

    def __getstate__(self):
        return {"raw": self.raw, "pattern": self.pattern, "made": None}

    def get(self):
        if self.made is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.raw.splitlines())}
            size = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, rank in ranks.items():
                size[rank] = len(token)
            self.made = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}), size
        return self.made


    def ids(self, text: str) -> list[int]:
        """Token ids of a whole text. The pattern takes a run of white space but for its last character, or all of it at the
        text's end, as one; no other match holds more than one white-space character, its first. So a long run can be cut out."""
        enc, out, at = self.get()[0], [], 0
        if len(text) >= LONG:
            for m in LONG_SPACE.finditer(text):
                end = m.end() if m.end() == len(text) else m.end() - 1
                out += enc.encode_ordinary(text[at : m.start()])
                out += enc._encode_single_piece(text[m.start() : end].encode("utf-8", "replace"))
                at = end
        return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def line_sections(text: str) -> np.ndarray:
    """Borders of a text's lines in characters: 0, ..., its length. A line holds its break."""
    at, cut = -1, [0]
    while (at := text.find("\n", at + 1)) >= 0:
        cut.append(at + 1)
    if cut[-1] != len(text) or len(cut) == 1:
        cut.append(len(text))
    return np.array(cut, np.int64)


def token_spans(encoder: Encoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of each token. A character that several tokens share counts for each."""
    size = encoder.get()[1]
    ids = np.array(encoder.ids(text), np.int64)
    ends = np.cumsum(size[ids]) if len(ids) else np.zeros(0, np.int64)
    starts = ends - size[ids] if len(ids) else ends
    raw = text.encode("utf-8", "replace")
    if len(raw) == len(text):
        return starts, ends
    first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80  # bytes that begin a character
    upto = np.r_[0, np.cumsum(first)]
    return upto[starts + 1] - 1, upto[ends]


def attribute(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; starts, ends and cuts ascend."""
    n = len(cuts) - 1
    if not len(starts):
        return np.zeros(n)
    a = np.searchsorted(cuts, starts, "right") - 1  # section of the first character
    b = np.searchsorted(cuts, ends - 1, "right") - 1  # and of the last
    if rule == "start":
        return np.bincount(a, minlength=n).astype(float)
    if rule == "end":
        return np.bincount(b, minlength=n).astype(float)
    out = np.bincount(a[a == b], minlength=n).astype(float)
    for s, e, i, j in zip(*(x[a != b].tolist() for x in (starts, ends, a, b)), strict=True):
        parts = [min(e, int(cuts[k + 1])) - max(s, int(cuts[k])) for k in range(i, j + 1)]
        if rule == "share":
            for k, x in enumerate(parts):
                out[i + k] += x / (e - s)
        else:
            out[i + parts.index(max(parts))] += 1
    return out


def section_tokens(spark: SparkSession, text, *, rank_file: str = RANK_FILE, rule: str = "most", sections=line_sections):
    """A list column of (start, end, tokens) of a text column."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    with open(rank_file, "rb") as f:
        shared = spark.sparkContext.broadcast(Encoder(f.read()))  # the vocabulary file, whatever the corpus

    @F.arrow_udf("array<struct<start:bigint,end:bigint,tokens:double>>")
    @frugal
    def run(col: pa.Array) -> pa.Array:
        starts, ends, tokens, offsets = [], [], [], [0]
        for v in col:
            text = v.as_py()
            if text is not None:
                cuts = sections(text)
                starts.append(cuts[:-1])
                ends.append(cuts[1:])
                tokens.append(attribute(*token_spans(shared.value, text), cuts, rule))
                offsets.append(offsets[-1] + len(cuts) - 1)
            else:
                offsets.append(offsets[-1])
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (starts, ends, tokens)]
        fields = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(float))], ["start", "end", "tokens"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields, mask=pa.array([not v.is_valid for v in col], pa.bool_()))

    return run(text)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its tokens, and those of each of its lines."""
    s = read_table(spark, sf_dir, "documents").select("doc_id", section_tokens(spark, F.col("text")).alias("s"))
    counts = F.transform(F.col("s"), lambda x: x["tokens"].cast("long"))
    total = F.coalesce(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    n = F.when(F.col("s").isNull(), 0).otherwise(F.size("s")).cast("long")
    return s.select("doc_id", total.alias("n_tokens"), n.alias("n_sections"), F.transform(F.col("s"), lambda x: x["start"]).alias("section_start"), counts.alias("section_tokens"))

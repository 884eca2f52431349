"""Offset-preserving search for personal data, disguised forms included.

Plain detectors find e-mail addresses, IP addresses, card and phone numbers in the text itself (the base).
Where a text shows signs of disguise, transducers rewrite it: homoglyphs and full-width forms to ASCII,
zero-width characters to nothing, spelled digits to digits, "[at]" and "(dot)" and " at " and " dot ", in any
mix, to "@" and ".". Every rewritten character keeps the span of source characters it stands for, so what the
detectors find in the rewritten text maps back to the source. Such a span is added unless it equals a base
span of its kind or cuts through one. Where it holds base spans these stay beside it; counts are of the spans
that no other of their kind holds, and ``redact`` takes the widest.

Offsets are code points, ends exclusive. Edge cases: null and empty texts have no spans; texts are
processed whole, in time linear in their length (runs of digits or of address characters are met once);
repeated rows get equal results; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import frugal, read_table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: As a match can't begin inside a run of digits where it can't at its start, the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Characters that look like an ASCII one (Cyrillic, Greek, dashes, spaces, signs).
LOOKALIKE = (
    "аaеeоoрpсcхxуyіiјjѕsԁdһhԛqԝwѵv"
    "АAВBЕEКKМMНHОOРPСCТTХXУYІIЈJЅS"
    "αaοoρpνvιiκkυuτtχx"
    "ΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX"
    "‐-‑-‒-–-—-−-․.。.﹒.﹫@⁺+"
)
#: Written digits, English, German, French, Spanish.
SPELLED = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_FOLD = {ord(a): b for a, b in zip(LOOKALIKE[::2], LOOKALIKE[1::2], strict=True)}
_FOLD |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
_FOLD |= {c: " " for c in (0xA0, 0x2007, 0x2009, 0x200A, 0x202F, 0x3000)}
_FOLD |= {base + d: str(d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_HIDDEN = re.compile("[­​-‍⁠﻿]")
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_FOLD)) + "­​-‍⁠﻿]")
_NUMBER_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?i)(?<!\w){_NUMBER_WORD}(?:[\s,.()-]{{1,4}}(?:{_NUMBER_WORD}|[0-9])(?!\w)){{3,}}|(?<!\w)[0-9](?:[\s,()-]{{1,4}}{_NUMBER_WORD}(?!\w)){{3,}}")
_SPELLED_ONE = re.compile(rf"(?i)(?<!\w){_NUMBER_WORD}(?!\w)")
_AT = re.compile(r"(?i)\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|<\s*at\s*>|\[\s*@\s*\]|\(\s*@\s*\))\s*")
_DOT = re.compile(r"(?i)\s*(?:\[\s*(?:dot|\.)\s*\]|\(\s*(?:dot|\.)\s*\)|\{\s*(?:dot|\.)\s*\}|<\s*dot\s*>)\s*")
_BRACKETED = re.compile(r"(?i)[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]")
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})"
#: Ends of domain names that a form without "@" and brackets is taken from, as other words are more likely prose: the
#: countries' (but as, am, by, do, is, my, so, to) and the better known of the others.
_ENDS = frozenset(
    """ac ad ae af ag ai al ao aq ar at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw
    cx cy cz de dj dk dm dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in
    io iq ir it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx
    mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn sr ss st su
    sv sx sy sz tc td tf tg th tj tk tl tm tn tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw
    com org net edu gov mil int info biz name pro mobi aero asia cat coop jobs museum post tel travel xxx arpa
    xyz app dev page blog online site website shop store tech cloud digital email media agency academy club live life link world today news space
    studio design solutions services systems software network company center community finance capital consulting group team works zone global
    guru expert education university school health clinic care legal law fund bank money market marketing host hosting icu vip top wiki win work
    berlin hamburg koeln bayern wien london paris nyc tokyo moscow amsterdam brussels africa gmbh ltd llc inc swiss eus gal bzh scot wales""".split()
)
#: Of these, those that an address with " at " and plain dots may end with: not words of the languages at hand.
_FIRM_ENDS = frozenset(e for e in _ENDS if len(e) > 2 and e not in ("cat", "int", "name", "pro", "post", "live", "life", "work", "works", "world", "today", "news", "space", "care", "fund", "law", "top", "win", "icu")) | frozenset("au br ch cn eu fr io jp nl pl ru uk".split())
#: Words before " at example.com" in prose.
_BEFORE_AT = frozenset(
    """a an are as available back be been book bought buy by call check contact directly download email entry find found free get go guide here hosted
    house how in is it join listed live located look looked looking looks mail mailbox me meet more myself now of off on one online only open or order out
    page pages posted published read registered report see seen shop shops site sites sold start staying store them there these this today uk up us
    visit visited visiting was we web website welcome were what where which work working works write you""".split()
)
_LOCALS = r"[A-Za-z0-9._%+-]{1,64}"
_WORDY = re.compile(rf"(?i)(?<![\w.%+-])({_LOCALS})((?:\s++dot\s++{_LOCALS}){{0,3}})(\s++at\s++|_at_|\s++@\s++|@)({_LABEL}(?:(?:\s++dot\s++|_dot_|\s++\.\s?+|\.){_LABEL}){{1,8}})(?!\w)")
_WORDY_SEP = re.compile(r"(?i)\s+dot\s+|_dot_|\s+\.\s?|\.")
_WORDY_IP = re.compile(r"(?i)(?<![0-9])[0-9]++(?:(?:\s++dot\s++|\.)[0-9]++){3}")
_WORDY_DOT = re.compile(r"(?i)\s+dot\s+")
_PLAIN_AT = re.compile(r"(?i)(?:(?<=\s)at\s+|(?<=\s)@\s+|_at_)[a-z0-9][a-z0-9-]*(?:\s*\.|_dot_)\s?[a-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    p = text.find("@")
    while p >= 0:
        s = p
        while s > done and _LOCAL.match(text, s - 1):
            s -= 1
        if s < p and (m := _DOMAIN.match(text, p + 1)):
            out.append((s, m.end()))
            done = m.end()
            p = text.find("@", done)
        else:
            done = max(done, p)
            p = text.find("@", p + 1)
    return out


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """The plain detectors: spans by kind, leftmost first, not overlapping."""
    found = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


class Tape:
    """A text and, for each of its characters, the span of source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (in order, not overlapping); each new character stands for its whole span."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end = start + self.start[at:], end + self.end[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return min(self.start[a:b]), max(self.end[a:b])


_COUNTED = frozenset(SPELLED) | frozenset("0123456789")


def disguised(text: str) -> bool:
    """Whether a transducer could change the text; each costly pattern waits behind a cheap necessary sign of it."""
    if not text.isascii():
        try:
            text.encode("latin-1")
            odd = "\xa0" in text or "\xad" in text
        except UnicodeEncodeError:
            odd = bool(_ODD.search(text))
        if odd:
            return True
    if ("[" in text or "(" in text or "{" in text or "<" in text) and _BRACKETED.search(text):
        return True
    low = text.lower()
    if "dot" in low and _WORDY_DOT.search(text):
        return True
    if (" @" in text or "at" in low) and _PLAIN_AT.search(low):
        return True
    # two of the counted words in a row, though more are asked for: the outer ones may touch brackets
    words = low.replace(",", " ").replace(".", " ").replace("-", " ").replace("(", " ").replace(")", " ").split()
    return b"\1\1" in bytes(map(_COUNTED.__contains__, words)) and bool(_SPELLED.search(text))


def normalise(text: str) -> Tape:
    tape = Tape(text)
    tape.text = text.translate(_FOLD)  # one character for one
    tape.rewrite([(m.start(), m.end(), "") for m in _HIDDEN.finditer(tape.text)])
    edits = []
    for m in _SPELLED.finditer(tape.text):
        edits += [(w.start(), w.end(), str(SPELLED[w[0].lower()])) for w in _SPELLED_ONE.finditer(tape.text, m.start(), m.end())]
    tape.rewrite(edits)
    edits = [(m.start(), m.end(), "@") for m in _AT.finditer(tape.text)]
    edits += [(m.start(), m.end(), ".") for m in _DOT.finditer(tape.text)]
    edits.sort()
    tape.rewrite([e for i, e in enumerate(edits) if not i or edits[i - 1][1] <= e[0]])
    tape.rewrite(_wordy(tape, text))
    tape.rewrite([(d.start(), d.end(), ".") for m in _WORDY_IP.finditer(tape.text) for d in _WORDY_DOT.finditer(tape.text, *m.span())])
    return tape


def _wordy(tape: Tape, source: str) -> list[tuple[int, int, str]]:
    """Edits for addresses with " at " or " dot " in words, "_at_" or " @ ", in any mix with "@", "." and the forms in brackets.

    The domain ends with the last name that _ENDS has; where the "@" or a dot is a sign, and no dot is plain, with any of two
    letters or more. With " at " and plain dots alone the end has to be one of _FIRM_ENDS, and the word before none of
    _BEFORE_AT ("look at example.com" is prose). A dot after white space counts after " @ " alone.
    """
    edits, at, whole = [], 0, tape.text
    while m := _WORDY.search(whole, at):
        at = m.start(3)
        sign = m[3]
        word, loose = "@" not in sign, "@" in sign and sign != "@"
        dots = list(_WORDY_SEP.finditer(whole, *m.span(4)))
        local = [(d.start(), d.end(), ".") for d in _WORDY_DOT.finditer(whole, *m.span(2))]
        for n in range(len(dots), 0, -1):
            end = dots[n].start() if n < len(dots) else m.end(4)
            name = whole[dots[n - 1].end() : end].lower()
            edited = [(d.start(), d.end(), ".") for d in dots[:n] if d[0] != "."]
            spaced = sum("." in d[0] and d[0] != "." for d in dots[:n])
            marked = [d[0] == "." and source[tape.start[d.start()] : tape.end[d.start()]] != "." for d in dots[:n]]
            plain = n - len(edited) - sum(marked)
            if spaced and not loose:
                continue
            if name not in _ENDS and not (len(name) > 1 and name.isalpha() and not plain and not loose and (not word or any(marked))):
                continue
            prose = word and plain == n and not local and sign != "_at_" and (name not in _FIRM_ENDS or m[1].lower() in _BEFORE_AT)
            if loose or (word and not prose) or (not word and (edited or local)):
                edits += [*local, *([(*m.span(3), "@")] if word or loose else []), *edited]
                at = end
                break
    return edits


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, all spans), both by kind and in order."""
    text = text or ""
    base = detect(text)
    if not disguised(text):
        return base, base
    tape = normalise(text)
    every = {}
    for kind, spans in detect(tape.text).items():
        have = sorted(base[kind])
        starts, ends = [x[0] for x in have], [x[1] for x in have]
        added, done = [], 0
        for a, b in sorted(tape.source(*s) for s in spans):
            held = have[bisect_right(ends, a) : bisect_left(starts, b)]  # the base spans it touches
            if a >= done and (not held or (a <= held[0][0] and held[-1][1] <= b and held != [(a, b)])):
                added.append((a, b))
                done = b
        every[kind] = sorted(have + added)
    return base, every


def widest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those that no other holds."""
    out = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def written(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


def spans(text):
    """A struct column of a text column: base and all spans, as lists of (kind, start, end) joined in text form, and counts."""

    @F.arrow_udf("struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base:string,spans:string>")
    @frugal
    def run(col: pa.Array) -> pa.Array:
        counts, base, every = [[] for _ in KINDS], [], []
        for v in col:
            b, e = find(v.as_py())
            for n, k in zip(counts, KINDS, strict=True):
                n.append(len(e[k] if e is b else widest(e[k])))
            base.append(written(b))
            every.append(base[-1] if e is b else written(e))
        return pa.StructArray.from_arrays([*(pa.array(n, pa.int64()) for n in counts), pa.array(base, pa.string()), pa.array(every, pa.string())], [*(f"n_{k}" for k in KINDS), "base", "spans"])

    return run(text)


def redact(text: str | None) -> str | None:
    """The text with every span found replaced by its kind in brackets."""
    if text is None:
        return None
    _, every = find(text)
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k in KINDS for a, b in widest(every[k])):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
            at = -b
    return "".join(out) + text[at:]


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "documents").select("doc_id", spans(F.col("text")).alias("p"))
    return p.select("doc_id", "p.n_email", "p.n_ip", "p.n_card", "p.n_phone", F.sha2("p.base", 256).alias("base_sha256"), "p.spans")

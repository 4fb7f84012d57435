"""Operator 1: personal data, with offset-preserving deobfuscation.

Base spans are matches of four patterns on the text as it is.  For disguised
ones a text goes through transducers, each writing what it reads together with
the source position of every character it writes: homoglyphs and full-width
forms become ASCII and invisible characters go; spelled digits and "plus"
become characters; "at" and "dot" in brackets or between words become "@" and
".", in front of an "at" also between the words of the local part, whose letters
may be spaced ("j a n e @ example.com").  The same detectors run on the result and their spans are mapped back to
source characters.  A span found there counts if a transducer changed something
inside it and it overlaps no base span of its kind, or contains it and is wider.

Detectors are linear in the text: emails are sought from each "@", digit
patterns only at the start of a run of digits.

Bare words are common in prose, so "jane at firma dot dk" counts only if a dot is
disguised too, by the word of the same language, the name is no plain word
("at this point in") and the last label is one of ``TLDS`` or has two letters that are
no word.  Left out: "jane at example.com" (an address of a site in most texts), bare
words before longer endings that are not listed, signs with more than three spaces
around them, numbers between spelled digits that are longer than four digits.

Cases: null and empty texts have no spans; equal rows give equal results;
offsets are code points, ends exclusive; spans are ordered by start, then kind.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadsync.llm.shared import table
from quadsync.llm.text_arrays import buffers, folded, pieces, span_hashes, word_spans
from quadsync.session import ship_package

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

#: fixed values: letters of other scripts that look like ASCII ones
LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁһӏԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινՕօ", "ABEKMHOPCTXaeopcyxijsdhlqwABEZHIKMNOPTYXoivOo", strict=True))
#: fixed values: characters without width
INVISIBLE = "­​‌‍‎‏⁠﻿"
#: fixed values: spelled digits (English, German, French, Spanish)
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: fixed values: words for "@", ".", "+" and "-"
AT = ("at", "arroba", "klammeraffe", "arobase")
DOT = ("dot", "punkt", "point", "punto")
PLUS = ("plus", "más")
DASH = ("dash", "hyphen", "minus")

#: spelled digits in a row from which on they are read as digits
RUN = 3
#: fixed values: last labels that let bare words stand for "@" and "."
TLDS = frozenset("com org net edu gov info biz io co de fr es uk eu us ca ch at it nl be pl ru cn jp in br mx au dev app ai test example".split())

#: fixed values: the word for "." that goes with a bare word for "@"
DOT_OF = {"at": ("dot",), "arroba": ("punto", "dot"), "klammeraffe": ("punkt", "dot"), "arobase": ("point", "dot")}
#: fixed values: words that are no host after a bare "at", and two-letter words that are no last label
PLAIN = frozenset("the this that these those a an any some each every one my your his her its our their which what no all least most first last once such".split())
SHORT_WORDS = frozenset("of on or if an as we he up go by is to so do my am".split())


def _any(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_EDGE, _END = r"(?<![^\W_])", r"(?![^\W_])"
SPELLED_PAIR = re.compile(rf"{_EDGE}(?:{_any(SPELLED)}){_END}[\W_]{{1,3}}(?:{_any(SPELLED)}|{_any(DOT)}|[0-9]){_END}", re.I)
ATOM = rf"(?:{_any(SPELLED)}|{_any(PLUS)}|{_any(DOT)}|{_any(DASH)}){_END}|\+|[0-9]{{1,4}}"
SPELLED_RUN = re.compile(rf"{_EDGE}(?:{ATOM})(?:[\W_]{{0,3}}(?:{ATOM}))+", re.I)
ATOMS = re.compile(rf"{_EDGE}({_any(SPELLED)}|{_any(PLUS)}|{_any(DOT)}|{_any(DASH)}){_END}|\+|[0-9]", re.I)

# white space between signs is bounded, so long runs of it cost no more than their length
_S, _S1 = r"\s{0,3}", r"\s{1,3}"
_AT = rf"(?:{_S}[\[({{<]{_S}(?:{_any(AT)}|@){_S}[\])}}>]{_S}|{_S1}(?:{_any(AT)}){_S1}|{_S}@{_S}|{_S}[_*-](?:{_any(AT)})[_*-]{_S})"
_DOT = rf"(?:{_S}[\[({{<]{_S}(?:{_any(DOT)}|\.){_S}[\])}}>]{_S}|{_S1}(?:{_any(DOT)}){_S1}|\.|{_S1}\.{_S}|{_S}[_*-](?:{_any(DOT)})[_*-]{_S})"
HINT = re.compile(rf"[\[({{<]\s{{0,3}}(?:{_any(AT)}|{_any(DOT)}|@|\.)\s{{0,3}}[\])}}>]|{_EDGE}(?:{_any(DOT)}){_END}|\s@|@\s|[_*-](?:{_any(AT)})[_*-]", re.I)
AT_SIGN = re.compile(_AT, re.I)
DISGUISED_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+", re.I)
DOT_SIGN = re.compile(_DOT, re.I)
_DOT_WORD = rf"(?:{_S}[\[({{<]{_S}(?:{_any(DOT)}|\.){_S}[\])}}>]{_S}|{_S1}(?:{_any(DOT)}){_S1})"
DOTTED_LOCAL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_DOT_WORD}[A-Za-z0-9._%+-]++)+", re.I)
SPACED_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?: [A-Za-z0-9](?![A-Za-z0-9._%+-])){2,}+")
LOCAL_SIGN = re.compile(rf"{_DOT_WORD}| ", re.I)
DOT_NUMBER = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, sought from each "@"."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans of a text."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(ch.isdigit() for ch in m[0]) <= 15]
    return sorted(out)


class Tape:
    """A text with, for each character, the source span it was written for and whether it was changed."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.new = text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the spans (start, end, new text), in order and without overlap."""
        if not edits:
            return
        text, start, end, new, at = [], [], [], bytearray(), 0
        for a, b, put in edits:
            text += [self.text[at:a], put]
            start += self.start[at:a] + [self.start[a]] * len(put)
            end += self.end[at:a] + [self.end[b - 1]] * len(put)
            new += self.new[at:a] + b"\x01" * len(put)
            if not put and new:
                new[-1] = 1
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end, self.new = start + self.start[at:], end + self.end[at:], new + self.new[at:]


@lru_cache(maxsize=1)
def lookalikes() -> tuple[dict[str, str], re.Pattern]:
    """Characters to rewrite (look-alikes, and all whose compatibility form is one ASCII character), and a pattern for them."""
    table_ = dict(LOOKALIKES) | dict.fromkeys(INVISIBLE, "")
    for c in range(0x80, 0x20000):
        ch = chr(c)
        form = unicodedata.normalize("NFKC", ch)
        if form != ch and len(form) == 1 and 0x21 <= ord(form) < 0x7F:
            table_[ch] = form
    return table_, re.compile("[" + "".join(re.escape(ch) for ch in table_) + "]")


def fold_lookalikes(tape: Tape) -> None:
    table_, pattern = lookalikes()
    tape.rewrite([(m.start(), m.end(), table_[m[0]]) for m in pattern.finditer(tape.text)])


def read_spelled(tape: Tape) -> None:
    """Runs of spelled digits as digits; a long run without a sign is a phone number unless it is a card."""
    edits = []
    for m in SPELLED_RUN.finditer(tape.text):
        out, spelled = [], 0
        for a in ATOMS.finditer(m[0]):
            word = (a[1] or a[0]).lower()
            spelled += word in SPELLED
            out.append(SPELLED.get(word) or ("." if word in DOT else "+" if word in PLUS else "-" if word in DASH else a[0]))
        put = "".join(out)
        digits = re.sub(r"\D", "", put)
        if spelled < RUN:
            continue
        end = m.end()
        if "." not in put and "+" not in put and 10 <= len(digits) <= 15 and not (len(digits) >= 14 and luhn(digits)):
            put = "+" + put
        edits.append((m.start(), end, put))
    tape.rewrite(edits)


def read_signs(tape: Tape) -> None:
    """Disguised "@" and "." between a local part and a domain, and "." between numbers."""
    edits, done = [], 0
    local = {m.end(): m for pattern in (DOTTED_LOCAL, SPACED_LOCAL) for m in pattern.finditer(tape.text)}
    for m in AT_SIGN.finditer(tape.text):
        if m.start() < done or m.start() == 0 or tape.text[m.start() - 1] not in LOCAL:
            continue
        d = DISGUISED_DOMAIN.match(tape.text, m.end())
        if not d:
            continue
        dots = list(DOT_SIGN.finditer(tape.text, d.start(), d.end()))
        if m[0] == "@" and all(x[0] == "." for x in dots):
            continue
        if (word := m[0].strip().lower()) in AT:  # bare words are common: the rest must look like an address
            host, last = tape.text[d.start():dots[0].start()].lower(), tape.text[dots[-1].end():d.end()].lower()
            signs = [x[0].strip().lower() for x in dots if x[0].strip() != "."]
            if not signs or host in PLAIN or any(x.isalpha() and x not in DOT_OF[word] for x in signs):
                continue
            if last not in TLDS and not (len(last) == 2 and last.isalpha() and last not in SHORT_WORDS):
                continue
        if (before := local.get(m.start())) and before.start() >= done:
            edits += [(before.start() + x.start(), before.start() + x.end(), "." if x[0] != " " else "") for x in LOCAL_SIGN.finditer(before[0])]
        edits.append((m.start(), m.end(), "@"))
        edits += [(x.start(), x.end(), ".") for x in dots]
        done = d.end()
    for m in DOT_NUMBER.finditer(tape.text):
        edits += [(x.start(), x.end(), ".") for x in DOT_SIGN.finditer(tape.text, m.start(), m.end()) if x[0] != "."]
    edits.sort()
    tape.rewrite([e for i, e in enumerate(edits) if i == 0 or e[0] >= edits[i - 1][1]])


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans) of a text as (start, kind, end)."""
    base = detect(text)
    looks = not text.isascii() and lookalikes()[1].search(text) is not None
    spelled = SPELLED_PAIR.search(text) is not None
    if not looks and not spelled and not HINT.search(text):
        return base, []
    tape = Tape(text)
    if looks:
        fold_lookalikes(tape)
    if spelled or looks:
        read_spelled(tape)
    read_signs(tape)
    added = []
    for s, kind, e in detect(tape.text):
        if any(tape.new[s:e]):
            a, b = min(tape.start[s:e]), max(tape.end[s:e])
            if not any(k == kind and x < b and a < y and not (a <= x and y <= b and b - a > y - x) for x, k, y in base):
                added.append((a, kind, b))
    return base, sorted(set(added))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _marks(words) -> np.ndarray:
    return np.sort(np.concatenate([span_hashes(b := np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(b)])) for w in words]))


WORD_MARKS = {name: _marks(words) for name, words in (("spelled", SPELLED), ("at", AT), ("dot", DOT), ("plus", PLUS))}
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


IS_DIGIT, OPENS, AROUND = _bytes("0123456789"), _bytes("[({<"), _bytes("[](){}<>_*-")


def worth_reading(col: pa.Array) -> np.ndarray:
    """Rows in which anything can be found (a few others too): they hold a digit, "@",
    a character that may be a look-alike, spelled digits side by side, or a sign's word."""
    raw, offsets = buffers(col)
    out = np.zeros(len(col), bool)
    for a, b in pieces(offsets):
        off = offsets[a:b + 1] - offsets[a]
        buf = folded(raw[offsets[a]:offsets[b]])
        if not len(buf):
            continue
        opens = np.flatnonzero(OPENS[buf[:-2]]) if len(buf) > 2 else np.zeros(0, np.int64)
        second, third = buf[opens + 1], buf[opens + 2]
        signs = opens[(second == 46) | (second == 64) | (second == 32) | (third == 46) | (third == 64)]
        hit = [np.flatnonzero(IS_DIGIT[buf] | (buf == 64) | (buf == 0xC2) | (buf >= 0xC4)), signs]
        start, end, row = word_spans(buf, off, LETTERS)
        short = np.flatnonzero(end - start <= 12)
        h = span_hashes(buf, start[short], end[short])
        is_a = {}
        for name, marks in WORD_MARKS.items():
            at = np.minimum(np.searchsorted(marks, h), len(marks) - 1)
            is_a[name] = np.zeros(len(start), bool)
            is_a[name][short[marks[at] == h]] = True
        number = is_a["spelled"] | is_a["dot"] | is_a["plus"]
        pair = np.flatnonzero(is_a["spelled"][:-1] & number[1:] & (row[1:] == row[:-1]))
        hit += [start[pair], start[is_a["dot"]]]
        at = np.flatnonzero(is_a["at"])
        framed = AROUND[buf[np.maximum(start[at] - 1, 0)]] | AROUND[buf[np.minimum(end[at], len(buf) - 1)]] | AROUND[buf[np.maximum(start[at] - 2, 0)]]
        hit.append(start[at[framed]])
        out[a + np.searchsorted(off, np.concatenate(hit), "right") - 1] = True
    return out


NOTHING = hashlib.sha256(b"").hexdigest()


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, digests, spans, more = [[], [], [], []], [], [], []
        for text, worth in zip(b.column(1), worth_reading(b.column(1)).tolist(), strict=True):
            base, added = spans_of(text.as_py()) if worth else ([], [])
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in base))
            digests.append(hashlib.sha256(written(base).encode()).hexdigest() if base else NOTHING)
            spans.append(written(sorted(base + added)))
            more.append(len(added))
        yield pa.record_batch([b.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()),
                               pa.array(more, pa.int64())], names=[x.split()[0] for x in OUT.split(", ")])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> counts of base spans by kind, their digest, all spans, and how many of them were disguised."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, OUT)


def op1_pii(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents"))

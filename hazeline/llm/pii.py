"""Personal data with offset-preserving deobfuscation.

Base detectors run on the text as it is. Then small transducers rewrite it: look-alike letters and digits, spelled digits,
and "(at)" and "dot" disguises. The detectors run again on the rewritten text, and what they find is mapped back to the
source characters it came from. A rewritten text keeps, for every character, the source span that made it.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import NO_ID, batches_of

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A match never starts inside a run of digits, and a run of digits is never given back: both only save time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: what stands before it is the run of local characters that ends there."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _EMAIL.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive; matches that fail a kind's test are dropped, not retried."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


#: Look-alikes of ASCII letters, by letter, and characters that show nothing.
LOOKALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "κ", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ",
    "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "ν", "w": "ԝ", "x": "х", "y": "у", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "Υ", "Z": "Ζ",
    "@": "＠﹫", ".": "．。․﹒", "+": "＋﹢", "-": "－‐‑‒–﹣", "(": "（", ")": "）", "_": "＿", " ": "     　",
}
HIDDEN = "­​‌‍⁠﻿"
_MAP = {ord(c): plain for plain, likes in LOOKALIKES.items() for c in likes}
_MAP |= {base + d: str(d) for base in (0x660, 0x6F0, 0x966, 0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_MAP |= {0xFF21 + k: chr(65 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _MAP))) + HIDDEN + "]")
_HIDDEN = re.compile("[" + HIDDEN + "]+")

#: Spelled digits, in English, French, German and Spanish.
SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "zéro": 0, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_NUMBER = "|".join(sorted(SPELLED, key=len, reverse=True))
#: A run of spelled digits of at least three, with plus before and digits, dots and points between.
_RUN = re.compile(rf"(?<!\w)(?:plus[\s-]+)?(?:{_NUMBER})(?:(?:[\s,-]+|[\s]*\.[\s]*|\s+(?:dot|point|punkt|punto)\s+)(?:{_NUMBER}|[0-9]+(?!\w))){{2,}}(?!\w)", re.I)
_ITEM = re.compile(rf"(?<!\w)({_NUMBER})(?!\w)|(?<!\w)(plus)[\s-]+|\s+(dot|point|punkt|punto)\s+|([0-9]+)|(\s*\.\s*)|([\s,-]+)", re.I)
#: Marks: name (at) host (dot) suffix. Bare words count only where both at and dot are spelled. A pattern that starts with
#: white space never starts inside a run of it, so that a long run is read once.
_AT_IN, _DOT_IN = r"[\[({<]\s*(?:at|@)\s*[\])}>]", r"[\[({<]\s*(?:dot|\.|punkt|point|punto)\s*[\])}>]"
_MARK = re.compile(rf"(?P<framed>(?:(?<!\s)\s+)?{_AT_IN}\s*)|(?P<bare>(?<!\s)\s+at\s+)|(?P<plain>@)", re.I)
_DOT = rf"(?:(?:(?<!\s)\s+)?{_DOT_IN}\s*)"
_SPELLED_DOT = rf"(?:{_DOT}|(?<!\s)\s+dot\s+)"
#: Rightwards from a mark: labels of the host. Leftwards, on the reversed text: parts of the local name.
_HOST = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{_SPELLED_DOT})[A-Za-z0-9-]++)*+", re.I)
_TOD = r"\s*[\])}>]\s*(?:tod|\.|tknup|tniop|otnup)\s*[\[({<](?:\s+(?!\s))?"
_LACOL = re.compile(rf"[A-Za-z0-9_%+-]++(?:(?:\.|{_TOD}|\s+tod\s+(?!\s))[A-Za-z0-9_%+-]++)*+", re.I)
_HOSTDOT = re.compile(_SPELLED_DOT, re.I)
_BRACKETS, _BAREDOT = re.compile(rf"{_AT_IN}|{_DOT_IN}", re.I), re.compile(r"\sdot\s", re.I)
_IPDOT = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{_SPELLED_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
#: Suffixes that make an address of words with a bare "at" and one bare "dot"; country codes are two letters.
SUFFIXES = frozenset("com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel app dev blog shop site online tech store xyz cloud".split())
COUNTRIES = frozenset("ar at au be br ca ch cl cn co cz de dk es eu fi fr gr hu ie il in io it jp kr mx nl no nz pl pt ro ru se sk tr tv ua uk us za".split())
_ENGLISH = frozenset("at be in it no us".split())


class Tape:
    """A text and, for each of its characters, where it starts and ends in the source."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = list(range(len(text))) if start is None else start
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """With text[a:b] replaced, for ascending edits (a, b, new). Characters of new that replace one each keep its place; else each stands for the whole of a:b."""
        if not edits:
            return self
        text, start, end, p = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[p:a], new]
            start += self.start[p:a]
            end += self.end[p:a]
            if len(new) == b - a:
                start += self.start[a:b]
                end += self.end[a:b]
            else:
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            p = b
        text.append(self.text[p:])
        return Tape("".join(text), start + self.start[p:], end + self.end[p:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Each spelled digit becomes a digit and what stands between goes; dots stay."""
    out = []
    for run in _RUN.finditer(text):
        for m in _ITEM.finditer(text, run.start(), run.end()):
            number, plus, dot, digits, point, _ = m.groups()
            new = str(SPELLED[number.lower()]) if number else "+" if plus else "." if dot or point else digits or ""
            if new != m[0]:
                out.append((m.start(), m.end(), new))
    return out


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Spelled at and dot marks of addresses. From each at mark the local name is read leftwards and the host rightwards;
    neither can pass another mark, so every character is read a bounded number of times."""
    edits: dict[tuple[int, int], str] = {}
    back, done = None, 0
    for m in _MARK.finditer(text):
        host = _HOST.match(text, m.end())
        if not host:
            continue
        dots = [d.span() for d in _HOSTDOT.finditer(text, *host.span())]
        if m["framed"]:
            if not dots and "." not in host[0]:
                continue
            end = host.end()
        else:
            if not dots:
                continue
            # up to the label after the last spelled dot
            end = _HOST_LABEL.match(text, dots[-1][1]).end()
            if m["bare"] and not _likely(text, m.end(), end, dots):
                continue
        if back is None:
            back = text[::-1]
        local = _LACOL.match(back, len(text) - m.start(), len(text) - done)
        if not local:
            continue
        if not m["plain"]:
            edits[m.span()] = "@"
        for d in (*dots, *(d.span() for d in _HOSTDOT.finditer(text, len(text) - local.end(), m.start()))):
            edits[d] = "."
        done = end
    for m in _IPDOT.finditer(text):
        for d in _HOSTDOT.finditer(text, *m.span()):
            edits[d.span()] = "."
    out: list[tuple[int, int, str]] = []
    for (a, b), new in sorted(edits.items()):
        if not out or a >= out[-1][1]:
            out.append((a, b, new))
    return out


_HOST_LABEL = re.compile(r"[A-Za-z0-9-]+")


def _likely(text: str, start: int, end: int, dots: list[tuple[int, int]]) -> bool:
    """Whether "name at host" may be an address: a framed or second dot says so; after a single bare dot the host must end in
    a known suffix, and in one that isn't an English word unless no other word follows on the line."""
    if len(dots) > 1 or "." in text[start:end] or not text[slice(*dots[0])].strip().isalpha():
        return True
    label = text[dots[0][1] : end].lower()
    return label in SUFFIXES or label in COUNTRIES and (label not in _ENGLISH or not _WORD_AFTER.match(text, end))


_WORD_AFTER = re.compile(r"[^\S\n]*\w")


def disguised(text: str) -> bool:
    """Whether any transducer may have something to rewrite; plain text skips them all. Every edit of _addresses is a framed
    mark or a bare dot, or " at " beside one of these, and no text without a run or an odd character changes before it."""
    if not text.isascii() and _ODD.search(text):
        return True
    return bool(_BRACKETS.search(text) or "dot" in text.lower() and _BAREDOT.search(text) or _RUN.search(text))


def deobfuscated(text: str) -> dict[str, list[tuple[int, int]]]:
    """Source spans of each kind that only the rewritten text shows."""
    tape = Tape(text)
    if not text.isascii():
        tape = tape.rewrite([(m.start(), m.end(), "") for m in _HIDDEN.finditer(text)])
        tape = Tape(tape.text.translate(_MAP), tape.start, tape.end)
    tape = tape.rewrite(_spelled(tape.text))
    tape = tape.rewrite(_addresses(tape.text))
    if tape.text == text:
        return {k: [] for k in KINDS}
    return {k: [tape.source(a, b) for a, b in spans] for k, spans in detect(tape.text).items()}


def spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and all spans: base ones and those of the rewritten text. An added span may overlap base ones: of a partly
    disguised identifier the base detectors see a fragment, which stays, and the rewritten text shows the whole."""
    base = detect(text)
    if not disguised(text):
        return base, base
    return base, {k: sorted({*base[k], *own}) for k, own in deobfuscated(text).items()}


def _listed(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


def _find(batches):
    for docs, texts in batches_of(batches, ["doc", "content"]):
        rows = []
        for doc, text in zip(docs, texts, strict=True):
            base, full = spans(text)
            rows.append((doc, *(len(base[k]) for k in KINDS), *(len(full[k]) - len(base[k]) for k in KINDS), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(full)))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:9]), pa.array(cols[9]), pa.array(cols[10])], ["doc", *KINDS, *(f"more_{k}" for k in KINDS), "sha", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base spans), n_added_* (spans that only
    deobfuscation shows), n_spans (all), base_sha256, spans.

    spans lists kind:start:end in code points, end exclusive, by kind, start and end; an added span may overlap others.
    Null text counts as empty: no spans. A null doc_id comes back as null; rows that repeat are judged each. Other
    columns are left out whatever their names; an empty table gives no rows."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("content"))
    out = d.mapInArrow(_find, "doc long, " + ", ".join(f"{k} long" for k in (*KINDS, *(f"more_{k}" for k in KINDS))) + ", sha string, spans string")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), *(F.col(k).alias(f"n_{k}") for k in KINDS), F.col("sha").alias("base_sha256"), "spans", *(F.col(f"more_{k}").alias(f"n_added_{k}") for k in KINDS), sum((F.col(k) + F.col(f"more_{k}") for k in KINDS), F.lit(0)).cast("long").alias("n_spans"))


def _mask(batches):
    for docs, texts in batches_of(batches, ["doc", "content"]):
        out = []
        for text in texts:
            parts, p = [], 0
            for a, b, k in sorted(((a, b, k) for k, own in spans(text)[1].items() for a, b in own), key=lambda s: (s[0], -s[1], s[2])):
                if a >= p:
                    parts += [text[p:a], f"<{k}>"]
                p = max(p, b)
            out.append("".join([*parts, text[p:]]))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(out, pa.string())], ["doc", "text"])


def masked(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by <kind>; overlapping spans go together, under the kind of the first and longest. Null text becomes empty."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("content"))
    return d.mapInArrow(_mask, "doc long, text string").select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text")

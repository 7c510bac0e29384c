"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Every kind has a pattern, a validator and a prior. A span's score is the prior, raised where a checksum confirms it
(Luhn for cards, mod 97 for account numbers) and raised again where a context word of its kind stands within
``CONTEXT_CHARS``. Kinds of the base contract stay whatever their score; the further kinds need ``THRESHOLD``.
All patterns are linear in the text: runs are consumed possessively and never tried again from within, but for account
numbers, whose tail is bounded.

Null and empty texts have no spans; offsets are code points, ends exclusive; repeated rows are scanned each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
THRESHOLD = 0.5
CONTEXT_CHARS = 40
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.5, "iban": 0.3, "ssn": 0.2}
CHECKSUM_GAIN = 0.4
CONTEXT_GAIN = 0.3
CONTEXT = {
    "email": ("mail", "e-mail", "contact"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "credit", "visa", "payment"), "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"), "ssn": ("ssn", "social security", "tax id"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++(?:\.[0-9]++(\.[0-9]++)?+)?+)?+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})")
_IBAN_TAIL = re.compile(r"(?:\x20?[A-Z0-9]){11,30}+")
#: characters of an account number by country
_IBAN_CHARS = {country: int(n) for n, countries in (line.split(":") for line in """
15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV
22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG
25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL 29:BR,EG,PS,QA,UA
30:JO,KW,MU 31:MT,SC 32:LC 33:RU""".split()) for country in countries.split(",")}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    """The check digits of account numbers: moved to the end, letters as 10 to 35, the rest of 97 is 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        if m.group(1) and all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """What follows a number may look like more of it: every end before a character that is none is tried, that of the
    country's length first, then the longest."""
    last = 0
    for m in _IBAN.finditer(text):
        start = m.start()
        if start < last:
            continue
        tail = _IBAN_TAIL.match(text, m.end()).end()
        ends = [e for e in range(tail, m.end(), -1) if text[e - 1] != " " and not _ALNUM.match(text, e)]
        codes = {e: code for e in ends if 15 <= len(code := text[start:e].replace(" ", ""))}
        own = _IBAN_CHARS.get(text[start:start + 2])
        for end in sorted(codes, key=lambda e: (len(codes[e]) != own, -e)):
            if mod97(codes[end]):
                yield start, end
                last = end
                break


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    yield from (m.span() for m in _SSN.finditer(text))


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}
_CONFIRMED = {"card", "iban"}


def find_spans(text: str) -> list[dict]:
    """Scored spans of one text, by kind as listed, then by start."""
    found = []
    for kind in KINDS:
        for start, end in _FINDERS[kind](text):
            near = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS]}".lower()
            score = PRIOR[kind] + CHECKSUM_GAIN * (kind in _CONFIRMED)
            score += CONTEXT_GAIN * any(re.search(rf"\b{w}\b", near) for w in CONTEXT[kind])
            if kind in BASE_KINDS or score >= THRESHOLD:
                found.append({"kind": kind, "start": start, "end": end, "score": round(min(score, 1.0), 3)})
    return found


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("score", pa.float64())]))
SPANS_TYPE = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pii): the scored spans of every whole text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [find_spans(t.as_py() or "") for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], [id_col, "pii"])

    return by_batch(docs.select(id_col, text_col), f"`{id_col}` {dict(docs.dtypes)[id_col]}, pii {SPANS_TYPE}", run)


def masked(text: str, spans: list[dict]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first stands for all."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the personal data of the text column masked; null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = (t.as_py() for t in batch.column(at))
        clean = [t and masked(t, find_spans(t)) for t in texts]
        return batch.set_column(at, text_col, pa.array(clean, batch.schema.field(at).type))

    return by_batch(docs, docs.schema, run)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

"""Personal data: regular expressions propose spans, validators confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_kind, map_texts, span_text, table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "name_phone")
BASE_KINDS = KINDS[:4]
#: What a validator's verdict is worth, and what a context word near the span adds or takes.
VALID, SYNTACTIC, NEAR, AGAINST, THRESHOLD, WINDOW = 0.9, 0.5, 0.3, 0.4, 0.7, 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind changes no match: a run of digits that fails at its start fails at every later digit.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:\x20?[0-9]|-[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+()-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])")
# Words that speak for a kind of span when they stand near it, and words that speak against any.
_FOR = {
    "email": ("mail", "email", "e-mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte", "bic"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "name_phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
}
_AGAINST = ("example", "sample", "version", "isbn", "order", "serial", "dummy", "test")
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @, in linear time."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _proposals(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, kind, confirmed by a validator); proposals that their validator refutes are left out."""
    if "@" in text:
        yield from ((a, b, "email", True) for a, b in _emails(text))
    if not any(d in text for d in "0123456789"):
        return
    for m in _IP.finditer(text):
        if all(_octet(p) for p in m[0].split(".")):
            yield m.start(), m.end(), "ip", True
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.start(), m.end(), "card", True
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield m.start(), m.end(), "phone", True
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield m.start(), m.end(), "iban", True
    if "-" in text:
        for m in _SSN.finditer(text):
            area, group, serial = m[0].split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                yield m.start(), m.end(), "ssn", False
    for m in _LOCAL_PHONE.finditer(text):
        yield m.start(), m.end(), "name_phone", False


def find_spans(text: str) -> list[Span]:
    """All spans of a text by start, then kind. The four base kinds stay whatever their score; the others stay when
    score reaches THRESHOLD and no base span overlaps them."""
    base, extra = [], []
    for start, end, kind, confirmed in _proposals(text):
        near = {w.lower() for w in _WORDS.findall(text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW])}
        score = (VALID if confirmed else SYNTACTIC) + NEAR * any(w in near for w in _FOR[kind]) - AGAINST * any(w in near for w in _AGAINST)
        span = Span(start, end, kind, min(1.0, max(0.0, score)))
        if kind in BASE_KINDS:
            base.append(span)
        elif span.score >= THRESHOLD:
            extra.append(span)
    extra = [e for e in extra if not any(b.start < e.end and e.start < b.end for b in base)] if extra else extra
    return sorted(base + extra, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SCHEMA = "array<struct<start: int, end: int, kind: string, score: double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, text: str = "text", to: str = "pii", keep: list[str] | None = None) -> DataFrame:
    """docs with the spans of personal data in a text column: (start, end, kind, score), code points, end exclusive.

    A null or empty text has no spans. Rows are looked at one by one, so repeated rows get equal spans and a null in any
    other column doesn't matter. A column of the name of the result gives way; keep names the columns to return, all by
    default. An empty table gives an empty one.
    """

    def scan(texts: list[str]) -> list[pa.Array]:
        return [pa.array([[s._asdict() for s in find_spans(t)] for t in texts], _SPANS)]

    return map_texts(docs, scan, {to: (SCHEMA, _SPANS)}, text, keep)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its counts of the fixed patterns, all spans and their scores. Edge cases as in find_pii."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [count_kind(F.col("pii"), k).alias(f"n_{k}") for k in BASE_KINDS]
    base = span_text(F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS)))
    scores = F.array_join(F.transform("pii", lambda s: F.round(s["score"], 3).cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), span_text(F.col("pii")).alias("spans"), scores.alias("scores"))

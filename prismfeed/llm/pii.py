"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds are email, ip, card (Luhn) and phone. On top come IBANs (mod-97),
which stand if they are written as usual or have context, and national numbers,
which only their context tells from other digits. Every
pattern is scanned once from left to right in linear time, long runs included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismfeed.llm._tables import map_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: A span of the added kinds stands from this score on; the context reaches so many code points to either side.
ACCEPT, REACH = 0.6, 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: How IBANs are written: in one, or in groups of four.
_GROUPED = re.compile(r"[A-Z0-9]{15,34}|[A-Z0-9]{4}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]")
#: Words near a span that speak for its kind.
CONTEXT = {
    "iban": ("iban", "bank", "konto", "account", "cuenta", "compte"),
    "ssn": ("ssn", "social security", "national id", "tax id"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile"),
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Local part, sign and a domain of at least two labels, found from each sign outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for s, e in emails(text):
            yield "email", s, e
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                yield "phone", *m.span()


_CONTEXT = {k: re.compile(rf"(?<![a-z])(?:{'|'.join(words)})s?(?![a-z])") for k, words in CONTEXT.items()}


def near(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a context word of the kind, as a word of its own, stands near the span."""
    around = f"{text[max(0, start - REACH) : start]} | {text[end : end + REACH]}".lower()
    return _CONTEXT[kind].search(around) is not None


def added_spans(text: str) -> Iterator[Span]:
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            score = 0.4 + 0.25 * bool(_GROUPED.fullmatch(m[0])) + 0.3 * near(text, "iban", *m.span())
            if score >= ACCEPT:
                yield Span("iban", *m.span(), score)
    if "-" in text:
        for m in _SSN.finditer(text):
            area, group, serial = m[0].split("-")
            valid = area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
            score = 0.3 + 0.1 * valid + 0.4 * near(text, "ssn", *m.span())
            if valid and score >= ACCEPT:
                yield Span("ssn", *m.span(), score)


def find_spans(text: str) -> list[Span]:
    """All spans by start, then kind as listed. Base spans always stand; context only moves their score."""
    out = [Span(k, s, e, 0.7 + 0.3 * near(text, k, s, e)) for k, s, e in base_spans(text)]
    out += added_spans(text)
    return sorted(out, key=lambda x: (x.start, KINDS.index(x.kind), x.end))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or group of overlapping spans, replaced by the kind of its first in brackets."""
    out, at = [], 0
    for x in spans:
        if x.start >= at:
            out += [text[at : x.start], f"[{x.kind.upper()}]"]
        at = max(at, x.end)
    return "".join([*out, text[at:]])


_TOGETHER = 512


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans: array of (kind, start, end, score)) for every row of df; offsets in code points, the end exclusive.

    Narrow, with no shuffle. A null or empty text has no spans; a very long one is
    searched whole; rows of repeated or null ids are searched each; an empty table
    gives an empty result; columns other than id and text are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _TOGETHER):
                b = whole.slice(at, _TOGETHER)
                found = [[x._asdict() for x in find_spans(t)] if t else [] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, span)], names=["id", "spans"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>").withColumnRenamed("id", id_col)


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of its texts replaced by its kind in brackets; null texts stay null, other columns as they are."""
    at, schema = df.columns.index(text_col), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _TOGETHER):
                b = whole.slice(lo, _TOGETHER)
                texts = [t and redacted(t, find_spans(t)) for t in b.column(at).to_pylist()]
                cols = [*b.columns]
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return map_rows(df, run, schema)


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))

    def count(k: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select(id_col, *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


__all__ = ["find_pii", "find_spans", "pii_digest", "redact_pii", "redacted", "joined", "luhn", "mod97"]

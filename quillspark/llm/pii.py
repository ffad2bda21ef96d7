"""Operator 2, personal data: patterns propose, checksums confirm, context scores.

Base kinds (email, ip, card, phone) are found leftmost and non-overlapping for
each kind and validated; a match that fails is dropped without a retry. Added
kinds: ``iban`` (mod-97), ``ssn`` (a number of the form 3-2-4) and ``secret`` (a
run of MIN_SECRET or more letters, digits and ``_+/-`` with both letters and digits
and an entropy of MIN_ENTROPY bits a character). A span's score is the kind's
prior, raised by context words within CONTEXT characters. Added spans count from
KEEP on, so ssn and secret need a context word; base spans always stay.

Null text is empty and has no spans. Texts are scanned whole; every pattern is
linear in the text. Repeated rows each get a row, null ids too; extra columns are
ignored by ``detect`` and handed on by ``redact``, whatever their names. Empty
table: an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import merge_spans

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
CONTEXT = 48
KEEP = 0.5
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "secret": 0.3}
HINTS = {
    "email": re.compile(r"\b(?:e-?mail|contact|write|mailto)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|tax id)\b", re.I),
    "secret": re.compile(r"(?<![a-z])(?:token|secret|password|passwd|pwd|(?:api|access|private)[ _-]?key|credentials?|bearer)(?![a-z])", re.I),
}
MIN_SECRET, MIN_ENTROPY = 20, 3.0
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A lookbehind keeps a long digit run from being tried at each of its digits; a start inside a run never matches where the run's own start failed.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{%d,}" % MIN_SECRET)
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def entropy(text: str) -> float:
    """Bits a character, by the characters' shares of the text."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in SECRET.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= MIN_ENTROPY:
            yield m.span()


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    return min(1.0, PRIOR[kind] + (0.4 if HINTS[kind].search(near) else 0.0))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; code points, end exclusive."""
    if not text:
        return []
    spans: list[tuple[str, int, int]] = []
    if "@" in text:
        spans += [("email", *s) for s in _emails(text)]
    if re.search("[0-9]", text):
        spans += [("ip", *s) for s in _ips(text)]
        spans += [("card", *s) for s in _cards(text)]
        if "+" in text:
            spans += [("phone", *s) for s in _phones(text)]
        for m in IBAN.finditer(text):
            if mod97(m[0].replace(" ", "")):
                spans.append(("iban", *m.span()))
        if "-" in text:
            spans += [("ssn", *m.span()) for m in SSN.finditer(text)]
        spans += [("secret", *s) for s in _secrets(text)]
    scored = [(k, a, b, score(k, text, a, b)) for k, a, b in spans]
    kept = [s for s in scored if s[0] in BASE or s[3] >= KEEP]
    return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def mask(text: str | None) -> str | None:
    """Each span, overlapping ones together, replaced by the kind of its first."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for a, b in merge_spans([(s[1], s[2]) for s in spans]):
        kind = next(s[0] for s in spans if s[1] == a)
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, score) for every document."""

    def run(batches):
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)] for t in b.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, personal data in ``text`` masked."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([mask(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans, their scores in the same order, and the counts by kind."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s.score, 2)), ",").alias("scores")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores, *[count(k) for k in KINDS[4:]])

"""Personal data: patterns propose, checksums confirm, context adjusts a score."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import texts

# Base kinds in output order, then the kinds the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
# Prior score of a confirmed proposal.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
# Words that raise the score of a kind when they stand close to it, before or after.
CONTEXT = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social", "security"),
}
# Words that lower the score of any kind: numbers of things, and made-up ones.
AGAINST = ("serial", "version", "invoice", "order", "isbn", "sku", "ticket", "example", "sample", "dummy")
CONTEXT_CHARS = 60
CONTEXT_BONUS, CONTEXT_MALUS = 0.3, 0.2
#: An added span is reported from this score on; base spans always are.
MIN_SCORE = 0.5

# The quantifiers are possessive and the starts anchored so that a text made of
# one endless digit run still costs linear time; the spans are those of the
# plain patterns matched leftmost without overlaps.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")


def luhn_ok(digits: str) -> bool:
    """Luhn check over a string of ASCII digits."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97_ok(iban: str) -> bool:
    """ISO 13616 check: country and check digits moved to the end, letters as 10..35."""
    compact = iban.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(ch, 36)) for ch in compact[4:] + compact[:4])) % 97 == 1


def _ssn_ok(s: str) -> bool:
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn_ok(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    """Capitals and digits, plain or in groups parted by single spaces; other writings are not proposed.

    Proposals may run into following capitals: shorten until mod-97 holds.

    The search goes on at the end of a confirmed span, or behind the start of a
    proposal of which no part is confirmed: another may begin inside either.
    """
    at = 0
    while m := _IBAN.search(text, at):
        end = m.end()
        at = m.start() + 1
        while end - m.start() >= 15:
            if text[m.start():end][-1] != " " and mod97_ok(text[m.start():end]):
                yield m.start(), end
                at = end
                break
            cut = text.rfind(" ", m.start(), end)
            if cut < 0:
                break
            end = cut


def _ssns(text: str):
    return [m.span() for m in _SSN.finditer(text) if _ssn_ok(m[0])]


def _score(kind: str, text: str, start: int, end: int) -> float:
    """Prior of the kind, raised by words that speak for it close by, lowered by words that speak against."""
    near = {w.lower() for at, to in ((max(0, start - CONTEXT_CHARS), start), (end, end + CONTEXT_CHARS))
            for w in _WORD.findall(text, at, to)}
    bonus = CONTEXT_BONUS if near.intersection(CONTEXT[kind]) else 0.0
    malus = CONTEXT_MALUS if near.intersection(AGAINST) else 0.0
    return round(max(0.0, min(1.0, PRIOR[kind] + bonus - malus)), 6)


def find_spans(text: str | None) -> list[dict]:
    """All spans of one text by kind, then start: kind, start, end (code points), score."""
    if not text:
        return []
    finders = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}
    out = []
    for kind, find in finders.items():
        for start, end in find(text):
            score = _score(kind, text, start, end)
            if kind in BASE_KINDS or score >= MIN_SCORE:
                out.append({"kind": kind, "start": start, "end": end, "score": score})
    return out


def redact_text(text: str, spans: list[dict]) -> str:
    """Each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] < at:
            if s["end"] > at:
                at = s["end"]
            continue
        out += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
        at = s["end"]
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def pii_spans(text: Column) -> Column:
    """Column of spans per text; null and empty texts give an empty list."""
    @F.arrow_udf(_SPANS)
    def spans(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("score", pa.float64())]))
        return pa.array([find_spans(t) for t in texts(column)], kind)

    return spans(text)


def redacted(text: Column) -> Column:
    """Text column with every span replaced by its kind, e.g. ``[EMAIL]``; null stays null."""
    @F.arrow_udf("string")
    def masked(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redact_text(t, find_spans(t)) for t in texts(column)], pa.string())

    return masked(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text_col`` replaced: same rows, other columns unchanged (any names).

    A null text stays null, an empty one empty; texts without findings are unchanged.
    """
    return docs.withColumn(text_col, redacted(F.col(f"`{text_col}`")))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the four base counts, base digest, all spans as text.

    Null and empty texts have no spans (digest of the empty string). Repeated
    rows and null ids are reported row by row; no other column is read.
    """
    fields = {f"n_{k}": "long" for k in BASE_KINDS} | {"base_sha256": "string", "spans": "string",
                                                       "n_spans": "long", "max_score": "double"}
    arrow = pa.struct([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t])
                       for n, t in fields.items()])

    @F.arrow_udf("struct<" + ",".join(f"{n}:{t}" for n, t in fields.items()) + ">")
    def report(column: pa.Array) -> pa.Array:
        rows = []
        for t in texts(column):
            spans = find_spans(t)
            line = [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]
            base = ",".join(x for x, s in zip(line, spans) if s["kind"] in BASE_KINDS)
            rows.append({f"n_{k}": sum(s["kind"] == k for s in spans) for k in BASE_KINDS}
                        | {"base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": ",".join(line),
                           "n_spans": len(spans), "max_score": max((s["score"] for s in spans), default=0.0)})
        return pa.array(rows, arrow)

    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), report(F.col(f"`{text_col}`")).alias("r"))
            .select("doc_id", *[F.col(f"r.{n}").alias(n) for n in fields]))

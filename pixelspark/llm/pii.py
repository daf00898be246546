"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs, digits, ``://`` and identifier cues (``token``, ``iban`` ...).
At each anchor a small deterministic parser expands to both sides and validates what it finds. Parsers of one kind never look
behind the end of their last match, so matches of a kind are the leftmost ones and do not overlap; no stretch of text is scanned more than a few times.

Cues count in any case and with a space, hyphen, underscore or nothing between their words. What follows must be valid: an IBAN by its remainder of 97, a social security number by its groups, keys,
passwords, account and passport numbers by their length and by holding a digit.

Kinds: ``email``, ``ip``, ``card``, ``phone`` (the base kinds) and, added by the method, ``url`` and ``account``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
#: Words after which an identifier may follow, and what it must be.
CUES = {
    "iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "number", "acct": "number", "passport": "number",
    **dict.fromkeys(("token", "secret", "password", "passwd", "api key", "access key", "private key", "bearer"), "secret"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s\"'<>|]+")
_LEAD = r"[ \t]{0,3}(?:is|no|nr|number)?[ \t.]{0,3}[:=#]?[ \t]{0,3}[\"']?"
_VALUE = re.compile(_LEAD + r"([A-Za-z0-9_-]{6,})", re.IGNORECASE | re.ASCII)
_IBAN = re.compile(_LEAD + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})", re.IGNORECASE | re.ASCII)
_SSN = re.compile(_LEAD + r"(([0-9]{3})[ -]?([0-9]{2})[ -]?([0-9]{4}))(?![0-9])", re.IGNORECASE | re.ASCII)
#: The longest account or passport number.
LONGEST = 34
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, keys in (("@", "@"), ("+", "+"), ("0", "0123456789"), ("url", ("://",))):
        for key in keys:
            a.add_word(key, (kind, len(key)))
    for cue, kind in CUES.items():
        for gap in " _-", "":
            for g in gap or ("",):
                form = cue.replace(" ", g)
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _lowered(text: str) -> str:
    """Lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _iban_end(found: str) -> int:
    """Length of the longest valid number at the start of ``found`` that ends with a group of it; 0 if there is none."""
    for end in range(len(found), 14, -1):
        if (end == len(found) or found[end] == " ") and found[end - 1] != " ":
            code = found[:end].replace(" ", "").upper()
            if 15 <= len(code) <= LONGEST and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                return end
    return 0


def _identifier(kind: str, text: str, at: int) -> tuple[int, int, int]:
    """Span of a valid identifier behind a cue that ends at ``at``, empty if there is none, and the end of what holds none for any cue inside it."""
    if kind == "iban" and (m := _IBAN.match(text, at)) and (end := _iban_end(m[1])):
        rest = m.start(1) + end
        if not text[rest : rest + 1].isalnum():
            return m.start(1), rest, rest
    if kind == "ssn" and (m := _SSN.match(text, at)) and m[2] not in ("000", "666") and m[2] < "900" and m[3] != "00" and m[4] != "0000":
        return *m.span(1), m.end()
    if kind in ("number", "secret") and (m := _VALUE.match(text, at)):
        valid = any("0" <= c <= "9" for c in m[1]) and (kind == "secret" or len(m[1]) <= LONGEST)
        return (*m.span(1), m.end()) if valid else (at, at, m.end())
    return at, at, at


def find_spans(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in ascending order; code points, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free, barren = dict.fromkeys(KINDS, 0), {"iban": 0, "ssn": 0, "number": 0, "secret": 0}
    ip_run = -2  # the last digit that belongs to a run in which no address starts
    for last, (kind, length) in automaton.iter(_lowered(text)):
        p = last - length + 1
        if kind == "0":
            if p >= free["card"]:
                m = _CARD.match(text, p)
                free["card"] = m.end() if m else p + 1
                if m and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            if p >= free["ip"]:
                if p != ip_run + 1:
                    m = _IP.match(text, p)
                    if m:
                        free["ip"] = m.end()
                        if all(len(x) < 4 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
                            out["ip"].append(m.span())
                        continue
                ip_run = p
        elif kind == "@":
            at = p
            while at > free["email"] and text[at - 1] in _LOCAL:
                at -= 1
            if at < p and (m := _DOMAIN.match(text, p + 1)):
                out["email"].append((at, m.end()))
                free["email"] = m.end()
        elif kind == "+":
            if p >= free["phone"] and (m := _PHONE.match(text, p)):
                free["phone"] = m.end()
                if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out["phone"].append(m.span())
        elif kind == "url":
            at = p
            while at > free["url"] and text[at - 1] in _SCHEME:
                at -= 1
            while at < p and not text[at].isalpha():
                at += 1
            if at < p and (m := _URL_REST.match(text, p + 3)):
                end = m.end()
                while end > p + 3 and text[end - 1] in ".,;:!?)":
                    end -= 1
                if end > p + 3:
                    out["url"].append((at, end))
                free["url"] = m.end()
        elif p >= free["account"] and last + 1 >= barren[kind]:
            a, b, barren[kind] = _identifier(kind, text, last + 1)
            if b > a:
                out["account"].append((a, b))
                free["account"] = b
    return out


def _joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for text in batch.column("text"):
            spans = find_spans(text.as_py() or "", automaton)
            for c, k in zip(columns, BASE_KINDS, strict=False):
                c.append(len(spans[k]))
            columns[4].append(hashlib.sha256(_joined(spans, BASE_KINDS).encode()).hexdigest())
            columns[5].append(_joined(spans, KINDS))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    A null or empty text has no spans: counts 0, ``spans`` empty, the hash of the empty string. Repeated rows give repeated rows, null ids
    stay null, an empty table gives no rows; further columns of ``docs`` are not used, whatever their names. Narrow: no shuffle.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; overlapping spans are merged, the earliest kind naming them. Null texts stay null."""
    small_batches(docs.sparkSession)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            out = []
            for t in batch.column(text_at):
                text, at, parts = t.as_py(), 0, []
                if text:
                    spans = sorted((a, b, k) for k, v in find_spans(text, automaton).items() for a, b in v)
                    for a, b, k in spans:
                        if a >= at:
                            parts += [text[at:a], f"<{k}>"]
                        at = max(at, b)
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield batch.set_column(text_at, batch.schema.field(text_at), pa.array(out, batch.schema.field(text_at).type))

    return docs.mapInArrow(run, docs.schema)

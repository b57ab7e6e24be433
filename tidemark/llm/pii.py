"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, digits, schemes (``://``)
and identifier cues ("token", "iban", ...).  At each anchor a deterministic local parser looks left
and right, finds the boundaries and validates what it found.  A text without anchors costs one scan.

The base kinds (email, ip, card, phone) give the leftmost matches of their grammar, one after another
without overlap within a kind; a match that fails its check is dropped and its characters are used up.
The method adds ``url`` (after a scheme), ``account`` (IBAN-like numbers with a right check sum, or a
number after an account cue) and ``secret`` (the value after a credential cue).

Defined cases: null and empty texts have no spans.  Offsets count code points, ends are exclusive.
Spans of different kinds may overlap.  Redaction replaces each run of overlapping spans by the name of
the first of them.  Other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: What a pipeline replaces: links stay, as they are seldom personal.
PRIVATE = ("email", "ip", "card", "phone", "account", "secret")

ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "ssn", "passport")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "access_key", "private_key", "client_id")

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEME = re.compile(r"(?:https?|ftps?|sftp|ssh|wss?)\Z", re.IGNORECASE | re.ASCII)
LINK = re.compile(r"[^\s<>\"'`|\\^{}]+")
VALUE = re.compile(r"(?:[ _-]?(?:number|no\.?|nr\.?|id|key))?[ \t]{0,3}[:=#][ \t]{0,3}[\"']?([A-Za-z0-9][A-Za-z0-9_./+~-]{5,})", re.IGNORECASE | re.ASCII)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    for text, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(text, (kind, len(text)))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str | None) -> list[tuple[int, str, int]]:
    """All spans (start, kind, end) of a text, by start, then kind."""
    if not text:
        return []
    spans: list[tuple[int, str, int]] = []
    email = ip = card = link = secret = account = 0  # up to where each kind has used up the text
    tail = bare = dot = 0  # of the last run of link characters: its end, that without signs, its last dot
    for last, (anchor, size) in automaton().iter(text):
        at = last - size + 1
        if anchor == "digit":
            if at >= card:
                m = CARD.match(text, at)
                card = m.end() if m else at + 1
                if m and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                    spans.append((at, "card", m.end()))
            if at >= ip and (at == 0 or not "0" <= text[at - 1] <= "9" or at == ip):
                if m := IP.match(text, at):
                    ip = m.end()
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                        spans.append((at, "ip", ip))
            if at >= account and at >= 2 and text[at - 1].isupper() and text[at - 2].isupper() and (at == 2 or not text[at - 3].isalnum()):
                if (m := IBAN.match(text, at - 2)) and (end := _shortest_iban(text, m)):
                    spans.append((at - 2, "account", end))
                    account = end
        elif anchor == "at":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                spans.append((start, "email", m.end()))
                email = m.end()
        elif anchor == "plus":
            if (m := PHONE.match(text, at)) and 9 <= len(_digits(m[0])) <= 15:
                spans.append((at, "phone", m.end()))
        elif anchor == "scheme":
            m = SCHEME.search(text, max(link, at - 5), at)
            if m and at + 3 >= tail:  # a run of link characters that wasn't read yet: one is read once, however many schemes it holds
                r = LINK.match(text, at + 3)
                tail = r.end() if r else at + 3
                bare = at + 3 + len(r[0].rstrip(".,;:!?)]")) if r else at + 3
                dot = text.rfind(".", at + 3, bare)
            if m and at + 3 < tail and (dot >= at + 3 or text.startswith("localhost", at + 3)):
                link = max(bare, at + 3)
                spans.append((m.start(), "url", link))
        elif (m := VALUE.match(text, last + 1)) and any("0" <= c <= "9" for c in m[1]):
            if anchor == "secret" and m.start(1) >= secret:
                spans.append((m.start(1), "secret", m.end(1)))
                secret = m.end(1)
            elif anchor == "account" and m.start(1) >= account:
                spans.append((m.start(1), "account", m.end(1)))
                account = m.end(1)
    return sorted(set(spans), key=lambda s: (s[0], ORDER[s[1]], s[2]))


def _shortest_iban(text: str, m: re.Match) -> int:
    """Where the longest stretch with a right check sum ends, or 0."""
    for end in range(m.end(), m.start() + 14, -1):
        if text[end - 1] == " " or text[end : end + 1].isalnum():
            continue
        plain = text[m.start() : end].replace(" ", "")
        if 15 <= len(plain) <= 34 and _iban(plain):
            return end
    return 0


def redact(text: str | None, kinds: tuple[str, ...] = PRIVATE) -> str | None:
    """The text with each run of overlapping spans of these kinds replaced by ``[KIND]``."""
    spans = [s for s in find(text) if s[1] in kinds]
    if not spans:
        return text
    out, done, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, all spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text"):
            spans = find(text.as_py())
            base = [s for s in spans if s[1] in BASE]
            kinds = [k for _, k, _ in base]
            rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def without(docs: DataFrame, kinds: tuple[str, ...] = PRIVATE) -> DataFrame:
    """The documents, with all their columns, their texts redacted; null stays null."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.set_column(at, batch.schema.field(at), pa.array([redact(t.as_py(), kinds) for t in batch.column(at)], batch.schema.field(at).type))

    return mapped(docs, run, docs.schema)


def redacted(kinds: tuple[str, ...] = PRIVATE):
    """A column function that redacts texts; null stays null."""
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, kinds) for t in texts], dtype=object)

    return of

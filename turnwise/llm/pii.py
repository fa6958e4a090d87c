"""Operator 9. Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, URL schemes and account cues); deterministic local
parsers expand each anchor to the boundaries of an email address, an IP address, a card number, a phone number, a URL or
an account and validate it. Anchors are found in one pass over a text, so the work is linear, and there is no shuffle.

Defined results: a null or empty text has no spans; null ids are passed on; repeated rows give repeated results; other
columns of the table are not read. Spans are code points with exclusive ends. Very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import arrow_rows, columns, short_batches, tidied

#: The order of the kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
_RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"]*)?")
_ACCOUNT = re.compile(r"(?i:[ ]?(?:number|no\.?|nr\.?|id|#))?[ ]?[:=#]?[ ]?(?:([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)|([A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,23}))(?![A-Za-z0-9])")
_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")
_SCHEMES = ("http", "https", "ftp")

_automaton = None


def _anchors():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for d in "0123456789":
            a.add_word(d, (0, 1))
        a.add_word("@", (1, 1))
        a.add_word("+", (2, 1))
        a.add_word("://", (3, 3))
        for cue in _CUES:
            for form in (cue, cue.capitalize(), cue.upper()):
                a.add_word(form, (4, len(form)))
        a.make_automaton()
        _automaton = a
    return _automaton


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start and then kind."""
    out = []
    ip_end = card_end = phone_end = mail_end = url_end = account_end = 0
    for last, (what, size) in _anchors().iter(text):
        at = last - size + 1
        if what == 0:
            if at >= ip_end and (at == 0 or not "0" <= text[at - 1] <= "9") and (m := _IP.match(text, at)):
                ip_end = m.end()
                if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
                    out.append((at, ip_end, "ip"))
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                if 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                    out.append((at, card_end, "card"))
        elif what == 1:
            start = at
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                mail_end = m.end()
                out.append((start, mail_end, "email"))
        elif what == 2:
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((at, phone_end, "phone"))
        elif what == 3:
            start = at
            while start > url_end and at - start < 6 and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if text[start:at].lower() in _SCHEMES and (m := _URL.match(text, at)):
                url_end = start + len((text[start : m.end()]).rstrip(".,;:!?)'"))
                out.append((start, url_end, "url"))
        elif at >= account_end and (at == 0 or not text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)):
            at = 1 if m[1] else 2
            if at == 2 or _mod97(m[1]):
                account_end = m.end(at)
                out.append((m.start(at), account_end, "account"))
    out.sort(key=lambda s: (s[0], _RANK[s[2]]))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span (overlaps joined, named by the first) replaced by its kind in brackets."""
    out, done, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base (kind:start:end of the base kinds), spans (of all kinds)."""
    short_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                spans = find_spans(text or "")
                kinds = [k for _, _, k in spans]
                rows.append((*[kinds.count(k) for k in BASE], joined([s for s in spans if s[2] in BASE]), joined(spans)))
            made = arrow_rows(pa.schema([*[(k, pa.int64()) for k in BASE], ("base", pa.string()), ("spans", pa.string())]), rows)
            yield pa.RecordBatch.from_arrays([b.column(0), *made.columns], names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return columns(docs, id_col, text_col).mapInArrow(tidied(run), schema)


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The table with every span in ``text_col`` replaced by its kind; ``length_col`` is set anew. Null texts stay null."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = [t and redact(t, find_spans(t)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    out = docs.mapInArrow(tidied(run), docs.schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.coalesce(F.char_length(text_col).cast(docs.schema[length_col].dataType), F.col(f"`{length_col}`")))
    return out


def digest(spans: DataFrame) -> DataFrame:
    return spans.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


def brute(text: str | None) -> str:
    """The base spans by plain regular expressions, for tests."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(re.fullmatch(r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])", p) for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

"""Personal data by anchor expansion.

Method: one Aho-Corasick pass over a text finds anchors (at-signs, plus signs, digits,
``://``, ``www.``, identifier cues such as ``IBAN``). At each anchor a small
deterministic parser expands to both sides, fixes the boundaries and validates them.
Anchors come in order of position, and a parser starts only beyond the end of the last
span of its kind, which gives leftmost non-overlapping spans. Every parser is linear in
what it reads: a failed number run is skipped as a whole.

Kinds ``email ip card phone`` are the base; ``url account street`` are added. Offsets are
code points, the end exclusive.

Defined results: a null text is empty; an empty one has no spans; equal documents give
equal rows, one for each input row; an empty table gives no rows. Only the named columns
are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.common import tidy

KINDS = ("email", "ip", "card", "phone", "url", "account", "street")
BASE = KINDS[:4]

# What the spans of the base kinds look like.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

_URL_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_IBAN_LENGTHS = {
    k[:2]: int(k[2:])
    for k in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 "
        "IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 "
        "SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9])")
_GLUE = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|#))?\x20{0,2}[:=#]?\x20{0,2}")
_STREET_LEFT = re.compile(r"[0-9]{1,5}[A-Za-z]?(?:\x20[A-Z][A-Za-z'.-]*){1,4}\Z")

_ACCOUNT_CUES = ("iban", "account", "acct", "routing", "ssn", "passport")
_STREET_CUES = (" Street", " Avenue", " Road", " Lane", " Boulevard", " Drive")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for cue in "0123456789":
        found.add_word(cue, "digit")
    for cue, kind in (("@", "email"), ("+", "phone"), ("://", "url"), ("www.", "www")):
        found.add_word(cue, kind)
    for cue in _ACCOUNT_CUES:
        for form in {cue, cue.upper(), cue.title()}:
            found.add_word(form, "account")
    for cue in _STREET_CUES:
        found.add_word(cue, "street")
    found.make_automaton()
    return found


_found: ahocorasick.Automaton | None = None


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def iban_end(text: str, at: int) -> int | None:
    """Where a valid IBAN from ``at`` ends: by its country's length, or else at the last end of a word that is valid."""
    if not (m := _IBAN.match(text, at)):
        return None
    ends = [k + 1 for k in range(at, m.end()) if text[k] != " "]
    length = _IBAN_LENGTHS.get(text[at : at + 2], 0)
    if 0 < length <= len(ends) and iban(text[at : ends[length - 1]]):
        return ends[length - 1]
    for end in reversed(ends[14:]):
        if (end == m.end() or not text[end].isalnum()) and iban(text[at:end]):
            return end
    return None


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    global _found
    if _found is None:
        _found = _automaton()
    out: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = url_end = account_end = street_end = 0
    for last, kind in _found.iter(text):
        if kind == "digit":
            if last >= card_end and (m := _CARD.match(text, last)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((last, 2, card_end))
            if last >= ip_end:
                if m := _IP.match(text, last):
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        out.append((last, 1, ip_end))
                else:
                    ip_end = _DIGITS.match(text, last).end()
        elif kind == "email":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                out.append((start, 0, email_end))
        elif kind == "phone":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((last, 3, phone_end))
        elif kind in ("url", "www"):
            start = last - 2 if kind == "url" else last - 3
            if kind == "url":
                while start > url_end and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if start == last - 2:
                    continue
            if start >= url_end and (m := _URL_REST.match(text, last + 1)):
                end = m.start() + len(m[0].rstrip(".,;:!?)]"))
                if "." in text[last + 1 : end] or "/" in text[last + 1 : end]:
                    url_end = end
                    out.append((start, 4, end))
        elif kind == "account":
            if last >= account_end:
                at = _GLUE.match(text, last + 1).end()
                end = iban_end(text, at)
                if end is None and (m := _NUMBER.match(text, at)):
                    end = m.end()
                if end is not None:
                    account_end = end
                    out.append((at, 5, account_end))
        elif last >= street_end:
            left = max(street_end, last - 80)
            cue_start = text.rfind(" ", 0, last + 1)
            window = text[left:cue_start]
            for k in _DIGITS.finditer(window):
                if (k.start() == 0 or not window[k.start() - 1].isalnum()) and _STREET_LEFT.match(window, k.start()):
                    street_end = last + 1
                    out.append((left + k.start(), 6, street_end))
                    break
    out.sort()
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_extra long"


def _report(batches):
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        counts = [[0] * len(batch) for _ in range(5)]
        shas, spans = [empty] * len(batch), [""] * len(batch)
        for k, text in enumerate(batch.column(1)):
            found = spans_of(text.as_py() or "")
            if found:
                base = [x for x in found if x[1] < 4]
                for x in found:
                    counts[min(x[1], 4)][k] += 1
                shas[k] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[k] = joined(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:4]), pa.array(shas), pa.array(spans), pa.array(counts[4], pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_extra"])


def pii_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds, their digest, all spans."""
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text}` as string) as t").mapInArrow(_report, REPORT)


def redacted(text: str) -> str:
    """``text`` with each span replaced by ``[KIND]``; of overlapping ones the first, then longest."""
    spans = spans_of(text)
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in sorted(spans, key=lambda x: (x[0], -x[2], x[1])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all rows and columns stay, null texts too."""
    at, kind = docs.columns.index(text), docs.schema[text].dataType.simpleString()
    if kind != "string":
        raise TypeError(f"{text} is {kind}, not string")

    def clean(batches):
        for batch in batches:
            column = batch.column(at)
            yield batch.set_column(at, batch.schema.field(at), pa.array([None if x is None else redacted(x) for x in column.to_pylist()], column.type))

    return docs.mapInArrow(tidy(clean), docs.schema)

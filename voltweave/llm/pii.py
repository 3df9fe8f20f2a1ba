"""Personal data by anchors: an Aho-Corasick automaton finds cues, small parsers expand and validate around them.

Anchors are at-signs, plus signs, digits, schemes and cues of identifiers and secrets; text without any is never parsed.
Each parser is deterministic: it expands to the boundary of its own alphabet, left no further than the end
of the kind's last match, and drops what fails validation without another try.

Defined cases: a null text is empty and has no spans; a null doc_id stays null; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_url long, n_account long, n_secret long, n_spans long"
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")

# Alphabets and cues.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
URL_STOP = frozenset(" \t\n\r\x0b\x0c\"'<>{}|\\^`")
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "www.")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "AKIA", "ASIA")
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key")

DOMAIN_PART = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NUMBER = re.compile(r"[\x20:#.=-]{0,4}(?:(?:no|nr|num|number)[\x20:#.=]{1,3})?([0-9]{6,18})(?![0-9A-Za-z])", re.I)
SECRET = re.compile(r"[\"']?\x20{0,2}(?:=>?|:)\x20{0,2}[\"']?([A-Za-z0-9+/=_.-]{16,4096})(?![A-Za-z0-9])")
KEY = re.compile(r"A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])")


@lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, patterns in (("email", "@"), ("digit", "0123456789"), ("phone", "+"), ("url", SCHEMES), ("account", CUES), ("secret", SECRET_CUES)):
        for p in patterns:
            for form in {p} if p.isupper() else {p, p.upper(), p.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban(text: str) -> bool:
    """The check number of ISO 13616."""
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive, by start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, kept or dropped
    for at, (kind, size) in automaton().iter(text):
        start = at - size + 1
        if kind == "email":
            low = start
            while low > done["email"] and text[low - 1] in LOCAL:
                low -= 1
            if low < start and (m := DOMAIN_PART.match(text, at + 1)):
                spans["email"].append((low, m.end()))
                done["email"] = m.end()
        elif kind == "digit":
            if start and text[start - 1] in "0123456789":
                continue  # inside a run of digits: matches begin at a run's start and end at a run's end
            if start >= done["ip"] and (m := IP.match(text, start)):
                done["ip"] = m.end()
                if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                    spans["ip"].append(m.span())
            if start >= done["card"] and (m := CARD.match(text, start)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans["card"].append(m.span())
        elif kind == "phone":
            if start >= done["phone"] and (m := PHONE.match(text, start)):
                done["phone"] = m.end()
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    spans["phone"].append(m.span())
        elif kind == "url":
            if start < done["url"] or start and text[start - 1].isalnum():
                continue
            end = at + 1
            while end < len(text) and text[end] not in URL_STOP:
                end += 1
            while end > at + 1 and text[end - 1] in ".,;:!?)]":
                end -= 1
            done["url"] = end
            host = text[at + 1 : end]
            if "." in host or "@" in host:
                spans["url"].append((start, end))
        elif kind == "secret":
            if start >= done["secret"] and not (start and text[start - 1].isalnum()) and (m := SECRET.match(text, at + 1)):
                done["secret"] = m.end(1)
                if any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
                    spans["secret"].append(m.span(1))
        elif start >= done["account"] and not (start and text[start - 1].isalnum()):
            m = KEY.match(text, start)
            if m is None:
                for low in range(at + 1, min(at + 12, len(text))):  # the identifier follows its cue closely
                    if m := IBAN.match(text, low):
                        break
                m = m if m and iban(m[0]) else NUMBER.match(text, at + 1)
            if m:
                span = m.span(1) if m.re is NUMBER else m.span()
                spans["account"].append(span)
                done["account"] = span[1]
    return spans


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def redact(text: str) -> str:
    """The text with each span replaced by its kind in square brackets; of overlapping spans the first, then the longest, names it."""
    out, at = [], 0
    found = sorted((s, -e, k) for k, v in find(text).items() for s, e in v)
    merged: list[list] = []
    for s, e, k in found:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], -e)
        else:
            merged.append([s, -e, k])
    for s, e, k in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            spans = find(text.as_py() or "")
            base = joined(spans, BASE_KINDS)
            rows.append((*(len(spans[k]) for k in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest() if base else EMPTY_SHA, joined(spans, KINDS), *(len(spans[k]) for k in KINDS[4:]), sum(map(len, spans.values()))))
        columns = list(zip(*rows, strict=True)) or [[]] * 10
        kinds = [pa.string() if n in ("base_sha256", "spans") else pa.int64() for n in names[1:]]
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def find_private(docs: DataFrame) -> DataFrame:
    """One row per document with counts and spans; needs doc_id and text, ignores all other columns."""
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def redact_private(docs: DataFrame) -> DataFrame:
    """The same rows and columns with the text redacted; a null text stays null, n_chars follows the text where there is such a column."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (x := t.as_py()) is None else redact(x) for t in batch.column("text")]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            columns["text"] = pa.array(texts, columns["text"].type)
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)

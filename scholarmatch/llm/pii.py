"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds ``email``, ``ip``, ``card`` and ``phone`` follow their patterns and validators exactly. The method adds
``iban`` (mod-97), ``ssn`` (three-part number with a context word) and ``cardlike`` (13 to 15 digits passing Luhn
with a context word) and ``cards`` (card numbers side by side, which the base pattern sees as one number). Of an account
code whose last groups are words that follow it, the longest part that passes is taken. Every span has a score: a start
value by kind, raised by context words in the ``WINDOW`` characters before or after it. Added spans are returned from ``ACCEPT`` on; base spans always stay.

Each pattern is matched in time linear in the text: only where a character that it needs occurs, and over maximal
runs, so that one very long token costs no more than its length.

Defined cases: a null text counts as empty; repeated rows are scanned one by one; an empty table gives an empty
result; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "cardlike", "cards")
#: Score of a span without context words, by kind.
START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "cardlike": 0.3, "cards": 0.7}
#: Words nearby that raise the score, by kind.
CONTEXT = {
    "email": ("mail", "contact"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank"), "ssn": ("ssn", "social", "security"),
    "cardlike": ("card", "amex", "diners", "credit", "payment"),
    "cards": ("card", "visa", "credit", "payment"),
}
RAISE = 0.2
ACCEPT = 0.5
WINDOW = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PARTS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_GROUP = re.compile("[0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 check of an account code: first four characters last, letters as 10 to 35."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """For each '@' the run of local characters before it, back to the last match, is the leftmost start."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (rest := _DOMAIN.match(text, at)):
            found.append((start, rest.end()))
            last = rest.end()
        at = text.find("@", max(at + 1, last))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Runs of dotted numbers, taken four by four from the left."""
    found = []
    for run in _PARTS.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((at, at + size))
            at += size + 1
    return found


def numbers(text: str) -> list[tuple[int, int, str]]:
    """Runs of digits with single blanks or dashes inside, with their digits."""
    return [(m.start(), m.end(), m.group().replace(" ", "").replace("-", "")) for m in _DIGITS.finditer(text)]


def split_cards(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Card numbers side by side in one long run: neighbouring groups that add up to 16 to 19 digits passing Luhn."""
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, start, end)]
    found, i = [], 0
    while i < len(groups):
        digits, step = "", 1
        for k in range(i, len(groups)):
            digits += text[groups[k][0] : groups[k][1]]
            if len(digits) > 19:
                break
            if len(digits) >= 16 and luhn(digits):
                found.append((groups[i][0], groups[k][1]))
                step = k - i + 1
                break
        i += step
    return found


def accounts(text: str) -> list[tuple[int, int]]:
    """Account codes that pass mod-97; a match that fails is tried without its last groups."""
    found, match = [], _IBAN.search(text)
    while match:
        start, end = match.span()
        while end > start:
            code = text[start:end].replace(" ", "")
            if len(code) < 15:
                end = start
            elif len(code) <= 34 and mod97(code):
                found.append((start, end))
                break
            else:
                end = max(start, text.rfind(" ", start, end))
        match = _IBAN.search(text, end if end > start else match.end())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every span in ``text``, by kind in its order, then start."""
    spans: list[tuple[str, int, int]] = []
    if "@" in text:
        spans += [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        spans += [("ip", *s) for s in addresses(text)]
        all_runs = numbers(text)
        runs = [r for r in all_runs if 13 <= len(r[2]) <= 19 and luhn(r[2])]
        spans += [("card", s, e) for s, e, d in runs if len(d) >= 16]
        if "+" in text:
            spans += [("phone", *s) for s in phones(text)]
        spans += [("iban", *s) for s in accounts(text)]
        spans += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        spans += [("cardlike", s, e) for s, e, d in runs if len(d) < 16]
        spans += [("cards", *part) for s, e, d in all_runs if len(d) > 19 for part in split_cards(text, s, e)]
    scored = []
    for kind, start, end in spans:
        around = f"{text[max(0, start - WINDOW) : start]}\n{text[end : end + WINDOW]}".lower()
        score = min(1.0, START[kind] + RAISE * (any(w in around for w in CONTEXT[kind])))
        if kind in KINDS or score >= ACCEPT:
            scored.append((kind, start, end, score))
    return scored


def redact(text: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    out, last = [], 0
    for kind, start, end, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += [text[last:start], f"<{kind}>"]
            last = end
    return "".join([*out, text[last:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            spans = find(text.as_py() or "")
            names = [f"{k}:{s}:{e}" for k, s, e, _ in spans]
            base = ",".join(n for n, s in zip(names, spans) if s[0] in KINDS)
            rows.append((
                *[sum(s[0] == k for s in spans) for k in KINDS], hashlib.sha256(base.encode()).hexdigest(), ",".join(names),
                sum(s[0] in ADDED for s in spans), ",".join(f"{s[3]:.1f}" for s in spans),
            ))
        columns = list(zip(*rows)) if rows else [()] * 8
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "scores"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names)


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, scores: one row per input row.

    The texts stay in their partitions: no shuffle, and one Arrow batch in memory at a time.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_scan, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long, scores string")

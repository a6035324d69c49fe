"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds (email, ip, card, phone) follow fixed patterns and checks and are always
kept. Further kinds (bank account number, social security number, national phone,
secret) are proposed by their own patterns and kept when their score, raised by a
passed checksum and by context words just before the span, reaches ``KEEP``.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from wardlight.llm.common import texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "national", "secret")
KEEP = 0.5
CONTEXT_CHARS = 48

# fixed values: the patterns and limits of the base kinds
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, IP_MOST = (13, 19), (9, 15), 255

_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+().-])(?:\(0?[0-9]{2,4}\)|0[0-9]{2,4}|[0-9]{3})[\x20./-][0-9][0-9\x20./-]{4,10}[0-9](?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_+/-]{20,}+(?![A-Za-z0-9_])")
_CONTEXT = {
    "iban": re.compile(r"iban|account|bank|konto|cuenta|compte", re.I),
    "ssn": re.compile(r"ssn|social|security|tax", re.I),
    "national": re.compile(r"phone|tel\b|tel[.:]|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone", re.I),
    "secret": re.compile(r"token|secret|password|passwd|api[_ -]?key|apikey|private[_ -]?key|credential", re.I),
    "card": re.compile(r"card|visa|credit|debit|karte|tarjeta|carte", re.I),
}
_BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.2, "ssn": 0.3, "national": 0.2, "secret": 0.2}
CHECKSUM_BONUS, CONTEXT_BONUS = 0.5, 0.35

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Mod-10 check of a card number."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064 check of an international account number without spaces."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses. Only at signs are looked at, each with
    the run of local characters before it, so the time stays linear."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def _addresses(text: str) -> list[Span]:
    parts_ok = lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= IP_MOST for p in s.split("."))
    return [("ip", m.start(), m.end()) for m in _IP.finditer(text) if parts_ok(m[0])]


def _cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 2 * CARD_DIGITS[1]:
            digits = m[0].replace(" ", "").replace("-", "")
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                out.append(("card", m.start(), m.end()))
    return out


def _phones(text: str) -> list[Span]:
    return [
        ("phone", m.start(), m.end()) for m in _PHONE.finditer(text)
        if PHONE_DIGITS[0] <= sum(c.isdigit() for c in m[0]) <= PHONE_DIGITS[1]
    ]


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by kind as listed, then start."""
    out = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += _addresses(text) + _cards(text)
        if "+" in text:
            out += _phones(text)
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    """Confidence in a proposed span: its kind, its checksum, the words before it."""
    value = _BASE_SCORE[kind]
    if kind == "iban" and mod97(text[start:end].replace(" ", "")):
        value += CHECKSUM_BONUS
    if kind in _CONTEXT and _CONTEXT[kind].search(text, max(0, start - CONTEXT_CHARS), start):
        value += CONTEXT_BONUS
    if kind == "secret":
        body = text[start:end]
        mixed = sum((any(map(str.isdigit, body)), any(map(str.islower, body)), any(map(str.isupper, body))))
        value += 0.1 * mixed - 0.3 * (not any(map(str.isdigit, body)))
    return min(1.0, max(0.0, value))


def more_spans(text: str, taken: list[Span]) -> list[Span]:
    """Further spans that reach ``KEEP`` and do not touch a span taken before."""
    if not _DIGIT.search(text):
        return []
    out: list[Span] = []
    held = sorted((a, b) for _, a, b in taken)
    for kind, pattern in zip(MORE_KINDS, (_IBAN, _SSN, _NATIONAL, _SECRET)):
        for m in pattern.finditer(text):
            clear = all(m.end() <= a or m.start() >= b for a, b in held)
            if clear and score(text, kind, m.start(), m.end()) >= KEEP:
                out.append((kind, m.start(), m.end()))
                held.append((m.start(), m.end()))
    return out


def joined_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets."""
    base = base_spans(text)
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in base + more_spans(text, base)):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, counts of the base kinds,
    ``base_sha256`` of the base spans and ``spans``, all spans as
    kind:start:end (code points, end exclusive). A null text is empty; a null id
    stays null; repeated rows give repeated rows."""

    def find(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE_KINDS}
            digests, spans = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                kinds = [k for k, _, _ in base]
                for k in BASE_KINDS:
                    counts[k].append(kinds.count(k))
                digests.append(sha256(joined_spans(base).encode()).hexdigest())
                spans.append(joined_spans(base + more_spans(text, base)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    return texts_of(docs).mapInArrow(
        find,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )

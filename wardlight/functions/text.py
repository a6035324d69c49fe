"""Text expressions: folding, comparable cells, flags on questions and SQL."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERAL = 32  # different letters that are replaced one after the other


# fixed values: patterns that decide the flags below; (?U) makes \b and \w see
# accented letters
RATIO_TERMS = r"(?iU)\b(taxa|percentual|propor[cç][ãa]o|porcentagem)\b"
DOMAIN_TERMS = (
    r"(?iU)\b(incidente|phishing|malware|ddos|ransomware|vulnerabilidad\w*|cve\b|cvss|"
    r"senha|password|pol[ií]tica|playbook|ataque|breach|exfiltr\w*|amea[çc]a|"
    r"exploit|patch|mitre|t[áa]tica|lgpd|anpd|triagem|severidade|falsos? positiv\w*|"
    r"incident|attack|threat|breached?)\b"
)
PREDICTION_TERMS = (
    r"(?isU)\b(probabilidad\w*|previs\w*|chance|risco|prioriz\w*|tend[eê]ncia|estim\w*)\b"
    r".*\bfalsos? positiv\w*"
    r"|\bfalsos? positiv\w*.*\b(probabilidad\w*|previs\w*|chance|risco|qual|quais)\b"
    r"|\b(quais|qual)\b.*\b(podem|poderiam|potencia\w*|prov[áa]ve\w*|candidat\w*)\b"
    r".*\bfalsos? positiv\w*"
)
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# fixed values: what counts as white space at the ends of a text
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.btrim(value, F.lit(WHITE))


@lru_cache(maxsize=1 << 16)
def _bare_letter(letter: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))


def bare(text: str) -> str:
    """Unicode's canonical decomposition without its combining marks. What takes a letter's place
    is decomposed already, so letters can be replaced in any order."""
    if text.isascii():
        return text
    changed = {c: plain for c in set(text) if c > "\x7f" and (plain := _bare_letter(c)) != c}
    if len(changed) > SEVERAL:
        return text.translate(str.maketrans(changed))
    for letter, plain in changed.items():
        text = text.replace(letter, plain)
    return text


def fold(value: Column) -> Column:
    """Lower case without accents, of any script (see :func:`bare`). Spark lower-cases; the marks
    go in one pass over each text of an Arrow batch."""

    @F.arrow_udf(T.StringType())
    def plain(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else bare(x) for x in texts.to_pylist()], pa.string())

    return plain(F.lower(value))


def comparable(value: Column) -> Column:
    """A cell in a form that can be compared: numbers to two decimals, other
    text trimmed and in lower case, null as ``none``."""
    text = strip(value.cast("string"))
    number = F.when(text.rlike(NUMBER), F.expr("1")).isNotNull()
    return F.coalesce(
        F.when(number, F.round(text.try_cast("double"), 2).cast("string")),
        F.lower(text),
        F.lit("none"),
    )


def strip_reasoning(value: Column) -> Column:
    """Text after the first closing reasoning tag, trimmed."""
    at = F.locate("</think>", value)
    return strip(F.when(at > 0, F.substr(value, at + F.lit(len("</think>")))).otherwise(value))


def asks_ratio(question: Column) -> Column:
    return question.rlike(RATIO_TERMS)


def in_domain(question: Column) -> Column:
    return question.rlike(DOMAIN_TERMS)


def prediction_intent(question: Column) -> Column:
    return question.rlike(PREDICTION_TERMS)


# what splits tokens becomes a space
_SPLIT = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def token_list(text: str) -> list[str]:
    """What :func:`tokens` finds, for use inside a task. Only two letters beyond ASCII have a small
    form that holds one of ``[a-z]``, the dotted I and the Kelvin sign, and Python's agrees on both."""
    return text.lower().encode().translate(_SPLIT).decode().split()


def tokens(text: Column) -> Column:
    """Runs of ``[a-z0-9]`` in the lower-cased text; other letters split words."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)

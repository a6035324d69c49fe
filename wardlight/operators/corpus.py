"""Sectioning and chunking of documents.

All steps stay inside the row of a document: no shuffle, and a document is the
largest thing a task holds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wardlight.functions.text import strip
from wardlight.plans.sizing import spread

HEADING = r"#{2,3} "
UNTITLED = "Introducao"
CHUNK_CHARS, OVERLAP, SLACK, MIN_CHARS = 900, 120, 200, 40
LINE_BREAK = re.compile("\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")


def sections_of(text: str, heading: str = HEADING) -> list[tuple[str, str]]:
    """Title and body of the sections of a text. A section starts at a line matching
    ``heading``; what comes before the first is untitled."""
    unix = LINE_BREAK.sub("\n", text)
    starts = [m.start() for m in re.finditer(rf"\n(?={heading})", unix)] if unix else []
    found = []
    for a, b in zip([-1, *starts], [*starts, len(unix)] if unix else []):
        piece = unix[a + 1 : b]
        titled = re.match(heading, piece)
        first = piece.partition("\n")[0]
        found.append((first.lstrip("# ").strip() if titled else UNTITLED, piece.strip()))
    return found


def _lists(rows: list[list[tuple] | None], kind: pa.ListType) -> pa.Array:
    """Lists of pairs as an Arrow array."""
    ends = np.cumsum([0, *(len(r or ()) for r in rows)]).astype(np.int32)
    parts = list(zip(*(x for r in rows if r for x in r))) or [()] * kind.value_type.num_fields
    pairs = pa.StructArray.from_arrays(
        [pa.array(v, f.type) for v, f in zip(parts, kind.value_type.fields)], fields=kind.value_type.fields
    )
    return pa.ListArray.from_arrays(pa.array(ends), pairs, type=kind)


# The functions below are declared as not deterministic for one reason: else Spark computes them a second
# time in a filter that it moves below them.


def _pairs(first: str, second: str) -> tuple[T.ArrayType, pa.ListType]:
    ours = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in (first, second)]))
    return ours, to_arrow_type(ours)


def section_list(text: Column, heading: str = HEADING) -> Column:
    """Sections of a text as ``array<struct<section, body>>`` (see :func:`sections_of`)."""
    ours, kind = _pairs("section", "body")

    def cut(texts: pa.Array) -> pa.Array:
        return _lists([sections_of(x or "", heading) for x in texts.to_pylist()], kind)

    return F.arrow_udf(cut, ours).asNondeterministic()(text)


def block_list(text: Column, heading: str, size: int, overlap: int) -> Column:
    """Blocks of all sections of a text as ``array<struct<section, text>>``."""
    ours, kind = _pairs("section", "text")

    def cut(texts: pa.Array) -> pa.Array:
        return _lists([
            [(title, block) for title, body in sections_of(x or "", heading) for block in blocks_of(body, size, overlap)]
            for x in texts.to_pylist()
        ], kind)

    return F.arrow_udf(cut, ours).asNondeterministic()(text)


def split_sections(docs: DataFrame, heading: str = HEADING) -> DataFrame:
    kept = [c for c in docs.columns if c != "text"]
    return docs.select(
        *kept, F.posexplode(section_list(F.col("text"), heading)).alias("section_no", "_s")
    ).select(*kept, "section_no", "_s.section", "_s.body")


def cut_points(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of the blocks of a long text. A block ends at the last line
    break of its second half, else at full size, and the next one starts
    ``overlap`` characters before that end, at least one further on."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    at = 0
    for _ in range(len(text)):
        if at + size >= len(text):
            yield at, len(text)
            return
        # break positions inside [at + size // 2, at + size); the first place never counts
        found = breaks[bisect_left(breaks, max(at + 1, at + size // 2)) : bisect_left(breaks, at + size)]
        stop = found[-1] if found else at + size
        yield at, stop
        at = max(at + 1, stop - overlap)


def blocks_of(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP) -> list[str]:
    if len(text) <= size + SLACK:
        return [text]
    cut = (text[a:b].strip() for a, b in cut_points(text, size, overlap))
    return [block for block in cut if block]


def _block_lists(bodies: Column, size: int, overlap: int) -> Column:
    """Blocks of each body; only rows with a long body visit Python."""

    @F.pandas_udf("array<array<string>>")
    def cut(rows: pd.Series) -> pd.Series:
        return rows.map(
            lambda many: None if many is None else [blocks_of(b, size, overlap) for b in many]
        )

    long = F.exists(bodies, lambda b: F.char_length(b) > size + SLACK)
    return F.coalesce(cut(F.when(long, bodies)), F.transform(bodies, lambda b: F.array(b)))


def split_long(sections: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """One row per block of each section body, numbered inside the section."""
    kept = [c for c in sections.columns if c != "body"]
    return sections.select(
        *kept,
        F.posexplode(F.flatten(_block_lists(F.array("body"), size, overlap))).alias(
            "block_no", "block"
        ),
    )


def chunks(
    docs: DataFrame, heading: str = HEADING, size: int = CHUNK_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """Chunks of (doc_id, source, text) documents: blocks of at least 40
    characters, numbered per document."""
    listed = spread(docs.select("doc_id", "source", "text"), "doc_id").select(
        "doc_id", "source", block_list(F.col("text"), heading, size, overlap).alias("_b")
    )
    long_enough = F.filter("_b", lambda c: F.char_length(strip(c["text"])) >= MIN_CHARS)
    return listed.select(
        "doc_id", "source", F.posexplode(long_enough).alias("chunk_no", "_c")
    ).select(
        F.format_string("%s::%03d", F.col("doc_id").cast("string"), "chunk_no").alias("chunk_id"),
        "doc_id", "source", "chunk_no", "_c.section", "_c.text",
    )

"""Retrieval packing: windows filled with lexical neighbours of a seed document.

Documents are spread over shards of bounded size by their ids and texts. A shard tokenises
its texts, cuts whole windows off long documents and keeps the rest as leftovers
in a BM25 inverted index. The first unused leftover seeds a window; the index
returns unused neighbours by their score over all shared terms, which fill the window
greedily; the one that no longer fits is cut and its tail stays in the index. Only a shard's last window
runs short, and it is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import part_of_row, parts_for, ranges, texts_of, total_bytes
from wardlight.llm.subword import subwords, vocabulary_path

WINDOW = 2048
END_ID = 1
SHARD_BYTES = 4 << 20
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Postings:
    """BM25 index of the leftovers of one shard: postings sorted by term."""

    def __init__(self, leftovers: list[np.ndarray]):
        lengths = np.fromiter(map(len, leftovers), np.int64, len(leftovers))
        doc = np.repeat(np.arange(len(leftovers)), lengths)
        token = np.concatenate(leftovers).astype(np.int64) if len(leftovers) else np.zeros(0, np.int64)
        pair, tf = np.unique(token << 32 | doc, return_counts=True)
        self.term, self.doc = pair >> 32, pair & 0xFFFFFFFF
        self.terms, self.first = np.unique(self.term, return_index=True)
        self.end = np.append(self.first[1:], len(self.term))
        df = self.end - self.first
        n = max(1, len(leftovers))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if n and len(lengths) else 1.0))
        self.weight = (np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        by_doc = np.argsort(self.doc, kind="stable")
        self.slot = np.repeat(np.arange(len(self.terms)), df)[by_doc]
        self.doc_first = np.searchsorted(self.doc[by_doc], np.arange(len(leftovers) + 1))
        self.df, self.n = df, len(leftovers)
        # a term in a sixteenth of the leftovers has a row of weights; the rows have at most 16 places a posting
        hot = np.flatnonzero(df * 16 > n)
        self.row = np.full(len(df), -1)
        self.row[hot] = np.arange(len(hot))
        self.dense = np.zeros((len(hot), self.n), np.float32)
        row = np.repeat(self.row, df)
        self.dense[row[row >= 0], self.doc[row >= 0]] = self.weight[row >= 0]

    def neighbours(self, seed: int, used: np.ndarray, most: int) -> np.ndarray:
        """At least ``most`` unused leftovers that share a term with the seed (all, if fewer), best first by
        the score over all shared terms."""
        own = self.slot[self.doc_first[seed] : self.doc_first[seed + 1]]
        own = own[self.df[own] > 1]
        rare = own[self.row[own] < 0]
        at = ranges(self.first[rare], self.df[rare])
        scores = np.bincount(self.doc[at], self.weight[at], self.n)
        scores = scores + self.dense[self.row[own][self.row[own] >= 0]].sum(axis=0)
        scores[used] = 0
        found = np.flatnonzero(scores)
        if len(found) > most:
            found = found[scores[found] >= np.partition(scores[found], -most)[-most]]
        return found[np.argsort(-scores[found], kind="stable")]


def powers(n: int) -> list[int]:
    """Powers of two that add up to ``n``, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack(tokens: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``document, start, length, sequence, offset`` for the ids of one shard."""
    out, sequence = [], 0
    rest: list[tuple[int, int]] = []  # document and start of what is left of it
    for doc, ids in enumerate(tokens):
        whole = len(ids) // window * window
        for start in range(0, whole, window):
            out.append((doc, start, window, sequence, 0))
            sequence += 1
        if whole < len(ids):
            rest.append((doc, whole))
    index = Postings([tokens[d][s:] for d, s in rest])
    used = np.zeros(len(rest), bool)
    at = [s for _, s in rest]
    left = int(sum(len(tokens[d]) - s for d, s in rest))
    room_of = powers(left % window)
    seed = walk = 0

    def place(k: int, room: int, filled: int) -> int:
        doc = rest[k][0]
        take = min(room - filled, len(tokens[doc]) - at[k])
        out.append((doc, at[k], take, sequence, filled))
        at[k] += take
        used[k] = at[k] == len(tokens[doc])
        return filled + take

    while left:
        room = window if left >= window else room_of.pop(0)
        while used[seed]:
            seed += 1
        filled = place(seed, room, 0)
        if filled < room:
            for k in index.neighbours(seed, used, room - filled):  # each brings a token at least
                filled = place(int(k), room, filled)
                if filled == room:
                    break
        walk = max(walk, seed)
        while filled < room:  # no neighbour is left: the next unused ones in order
            if used[walk]:
                walk += 1
            else:
                filled = place(walk, room, filled)
        left -= filled
        sequence += 1
    return out


def packed(docs: DataFrame, window: int = WINDOW, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per piece, see ``PIECES``. A null text is empty and still has its end
    id; rows with equal ids are packed as documents of their own."""
    texts = texts_of(docs)
    shards = parts_for(total_bytes(texts), shard_bytes)

    def fill(table: pa.Table) -> pa.Table:
        encode = subwords(path or vocabulary_path())
        table = table.sort_by("doc_id")
        docs_ = table.column("doc_id").to_pylist()
        ids = [np.append(t, np.int32(END_ID)) for t in encode.many(table.column("text").to_pylist(), added=True)]
        shard = table.column("__shard")[0].as_py()
        rows = pack(ids, window)
        crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in rows]
        columns = list(zip(*rows)) if rows else [()] * 5
        return pa.table({
            "doc_id": pa.array([docs_[d] for d in columns[0]], pa.int64()),
            "start": pa.array(columns[1], pa.int64()), "length": pa.array(columns[2], pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": pa.array([len(ids[d]) for d in columns[0]], pa.int64()),
            "sequence_id": pa.array([(shard << 32) + s for s in columns[3]], pa.int64()),
            "offset": pa.array(columns[4], pa.int64()),
        })

    return texts.withColumn("__shard", part_of_row(shards)).groupBy("__shard").applyInArrow(fill, PIECES)

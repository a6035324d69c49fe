"""Alignment of two public tokenizers' tokens over a corpus, by diagonal run skipping.

Both tokenizers cut the same bytes, so an alignment only needs the rising arrays of their
tokens' end offsets. Most of it lies on diagonals: from a common end on, the next ends are
equal one by one at the current *shift* between the two token numbers. Exponential probing
compares stretches of 1, 2, 4 ... ends at that shift and jumps what is equal; where ends
differ, the shorter side is advanced until both meet again, which makes an irregular group
and the next shift. Many texts are aligned side by side as *lanes* of numpy arrays, and long texts are
cut into several lanes at ends both have in common.

Corpus-wide counts of linked id pairs are summed per task and then by pair, which also
spreads frequent pairs; the number of pairs is bounded by the two vocabularies, not by the
corpus. Counts go back to the documents in shards of bounded size.
"""

from __future__ import annotations

import json
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import blob, joined, parts_for, ranges, runs_of, slices, text_buffer, texts_of, written

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
HELD_PAIRS = 1_000_000  # distinct pairs a task counts before it passes them on
SHARD_PAIRS = 2_000_000  # pairs sent to the tasks at once, 32 MB
LANE = 512  # tokens of a lane, about
SEEK = 64  # tokens looked at for a common end to cut a lane
SLICE = 1 << 20  # bytes of text aligned at once
# fixed value: the split rule of the first vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.zeros(0, np.int64)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Ids of both tokenizers and the bytes of their tokens.

    The first vocabulary's merges are run by ``tiktoken``, three times as fast as by its own library; ids
    are equal (tested over all of Unicode). Special tokens are ordinary text.
    """

    def __init__(self, first: str, second: str):
        import sentencepiece
        import tiktoken

        from wardlight.llm.subword import _byte_letters

        letters = _byte_letters()
        with open(first, encoding="utf-8") as f:
            model = json.load(f)["model"]
        raw = {bytes(letters[c] for c in token): number for token, number in model["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merged = [bytes(letters[c] for c in left + right) for left, right in merges]
        order = [bytes([b]) for b in range(256)] + merged
        self.number = np.array([raw[x] for x in order], np.int32)
        self.first = tiktoken.Encoding(
            "first", pat_str=PATTERN, mergeable_ranks={x: i for i, x in enumerate(order)}, special_tokens={}
        )._core_bpe
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.a_bytes = Spelled({number: x for x, number in raw.items()})
        self.b_bytes = Spelled({
            i: bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        })

    def encoded(self, texts: list[str]):
        """Flat ids and tokens per text of both sides; the first side gets the space that the second adds itself."""
        a = [self.first.encode_ordinary(" " + t) if t else [] for t in texts]
        b = self.second.encode(texts, num_threads=1) if texts else []
        out = []
        for found in (a, b):
            n = np.fromiter(map(len, found), np.int64, len(found))
            out += [np.fromiter(chain.from_iterable(found), np.int32, int(n.sum())), n]
        out[0] = self.number[out[0]]
        return out


class Spelled:
    """Bytes of token ids."""

    def __init__(self, raw: dict[int, bytes]):
        held = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.length = np.array([len(x) for x in held], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(held), np.uint8)

    def differ(self, ids: np.ndarray, n: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts whose tokens (``n`` each) do not spell the text's bytes."""
        ends = np.concatenate(([0], np.cumsum(self.length[ids])))[np.concatenate(([0], np.cumsum(n)))]
        out = np.diff(ends) != np.diff(off)
        fit = np.flatnonzero(~out & (n > 0))
        spelled = self.flat[ranges(self.first[ids], self.length[ids])]
        wrong = spelled[ranges(ends[fit], np.diff(ends)[fit])] != data[ranges(off[fit], np.diff(off)[fit])]
        out[fit[np.repeat(np.arange(len(fit)), np.diff(off)[fit])[wrong]]] = True
        return out


@lru_cache(maxsize=1)
def tokens(first: str, second: str) -> Tokens:
    """One per Python worker."""
    return Tokens(first, second)


def cut_lanes(a_end: np.ndarray, b_end: np.ndarray, a_at: np.ndarray, b_at: np.ndarray):
    """First tokens of the lanes on both sides: every text, and ends in common about every
    ``LANE`` tokens of long ones."""
    n = np.diff(a_at)
    cuts = ranges(np.zeros(len(n), np.int64), np.maximum(n - 1, 0) // LANE) + 1
    at = np.repeat(a_at[:-1], np.maximum(n - 1, 0) // LANE) + cuts * LANE
    near = np.minimum(at[:, None] + np.arange(SEEK), len(a_end) - 1)
    place = np.searchsorted(b_end, a_end[near])
    met = b_end[np.minimum(place, len(b_end) - 1)] == a_end[near] if len(b_end) else np.zeros(near.shape, bool)
    some = met.any(1)
    first = np.argmax(met, 1)[some]
    more_a, more_b = near[some, first] + 1, place[some, first] + 1
    i, j = np.concatenate([a_at[:-1], more_a]), np.concatenate([b_at[:-1], more_b])
    order = np.unique(i, return_index=True)[1]  # a text without tokens starts where the next one does
    keep = order[i[order] < len(a_end)]
    return i[keep], j[keep]


def aligned(a_end: np.ndarray, b_end: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last token of each group on both sides, for texts whose tokens ``a_at`` and ``b_at`` part.
    Ends rise through all texts, and each text's last ends are equal on both sides."""
    if not len(a_end):
        return NONE, NONE
    i, j = cut_lanes(a_end, b_end, a_at, b_at)
    stop = np.append(i[1:], len(a_end))  # of the first side; lanes follow each other
    step = np.ones(len(i), np.int64)
    close = np.zeros(len(a_end), np.int64)  # 1 + last token of the other side, where a group ends
    while len(i):
        # compare the next ends at this shift
        n = np.minimum(np.minimum(step, stop - i), len(b_end) - j)
        head = np.cumsum(n) - n
        x = ranges(i, n)
        y = x + np.repeat(j - i, n)
        differs = a_end[x] != b_end[y]
        close[x[~differs]] = y[~differs] + 1  # an equal end is a common one, wherever it stands
        same = np.minimum.reduceat(np.where(differs, np.arange(len(x)), len(x)), head) - head
        same = np.minimum(same, n)
        i, j = i + same, j + same
        step = np.where(same == n, 2 * step, 1)
        # lanes whose next ends differ: advance the side that is behind until both meet
        at = np.flatnonzero(same < n)
        p, q = i[at], j[at]
        while len(at):
            less = a_end[p] < b_end[q]
            more = a_end[p] > b_end[q]
            met = ~(less | more)
            close[p[met]] = q[met] + 1
            i[at[met]], j[at[met]] = p[met] + 1, q[met] + 1
            p, q, at = (p + less)[~met], (q + more)[~met], at[~met]
        on = i < stop
        i, j, stop, step = i[on], j[on], stop[on], step[on]
    a_last = np.flatnonzero(close)
    return a_last, close[a_last] - 1


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all numbers below ``size``, right-aligned with room for a mark, and their mask."""
    text = np.array([str(i).rjust(5, "\0") + "\0" for i in range(size)], "S6")
    table = np.frombuffer(text.tobytes().ljust(6 * size, b"\0"), np.uint8).reshape(size, 6).copy()
    mask = table > 0
    mask[:, 5] = True
    return table, mask


@lru_cache(maxsize=1)
def digits() -> tuple[np.ndarray, np.ndarray]:
    return _digits(100_000)


class Aligned:
    """Tokens, groups and links of a run of texts."""

    def __init__(self, known: Tokens, texts: list[str]):
        raw = [(" " + t).encode() if t else b"" for t in texts]
        off = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))))
        data = np.frombuffer(b"".join(raw), np.uint8)
        a, a_n, b, b_n = known.encoded(texts)
        other = known.a_bytes.differ(a, a_n, data, off) | known.b_bytes.differ(b, b_n, data, off)

        def side(ids, n, spelled):
            ids, n = ids[~np.repeat(other, n)], np.where(other, 0, n)
            return ids, np.cumsum(spelled.length[ids]), np.concatenate(([0], np.cumsum(n)))

        self.a, self.a_end, self.a_at = side(a, a_n, known.a_bytes)
        self.b, self.b_end, self.b_at = side(b, b_n, known.b_bytes)
        self.a_last, self.b_last = aligned(self.a_end, self.b_end, self.a_at, self.b_at)
        # groups before each text; a group's last tokens end together: a link
        self.at = np.searchsorted(self.a_last, self.a_at)
        self.pairs = (self.a[self.a_last].astype(np.uint32) << np.uint32(16)) | self.b[self.b_last].astype(np.uint32)

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        table, mask = digits()
        na, nb = len(self.a), len(self.b)
        # a group's own tokens stand after all tokens of earlier groups, its second side's after its first's
        a_before = np.concatenate(([0], self.b_last + 1))
        a_group = np.searchsorted(self.a_last, np.arange(na))
        b_group = np.searchsorted(self.b_last, np.arange(nb))
        a_place = np.arange(na) + a_before[a_group]
        b_place = np.arange(nb) + self.a_last[b_group] + 1 if nb else NONE
        ids, mark = np.empty(na + nb, np.int64), np.full(na + nb, ord(","), np.uint8)
        ids[a_place], ids[b_place] = self.a, self.b
        mark[a_place[self.a_last]] = ord("|")
        mark[b_place[self.b_last]] = ord(";")
        wide = table[ids]
        wide[:, 5] = mark
        held = mask[ids]
        flat = wide[held].tobytes()
        ends = np.concatenate(([0], np.cumsum(held.sum(1))))[self.a_at + self.b_at]
        return [flat[x : y - 1].decode() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


class PairCounts:
    """Counts of pairs, few arrays at a time."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, pairs: np.ndarray) -> None:
        found, counts = np.unique(pairs, return_counts=True)
        self.held.append((found, counts))
        self.n += len(found)
        if self.n > 2 * HELD_PAIRS:
            self.held = [self.sums()]
            self.n = len(self.held[0][0])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.uint32), NONE
        pairs = np.concatenate([p for p, _ in self.held])
        counts = np.concatenate([c for _, c in self.held])
        order = np.argsort(pairs, kind="stable")
        first, _ = runs_of(pairs[order])
        return pairs[order][first], (np.add.reduceat(counts[order], first) if len(first) else NONE)


def alignments(docs: DataFrame, first: str | None = None, second: str | None = None, digests: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups, links, pairs, counts``: a row per text with its groups (with
    ``digests``: their SHA-256) and packed links (first side's id in the upper 16 bits), and rows with a
    null ``n_a`` that hold the pairs a task has counted."""
    first, second = first or tokenizer_path(FIRST), second or tokenizer_path(SECOND)

    def counted(counts: PairCounts) -> pa.RecordBatch:
        pairs, n = counts.sums()
        row = [None] * 6 + [pairs.astype(np.int64).tolist(), n.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    names = "doc_id n_a n_b n_groups groups links pairs counts".split()
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def apply(batches):
        known, counts = tokens(first, second), PairCounts()
        for batch in batches:
            _, off = text_buffer(batch.column(1))
            for i, j in slices(off, SLICE):
                found = Aligned(known, batch.column(1).slice(i, j - i).to_pylist())
                counts.add(found.pairs)
                at, groups = found.at.tolist(), found.groups()
                if digests:
                    groups = [sha256(g.encode()).hexdigest() if g else g for g in groups]
                rows = [
                    batch.column(0).slice(i, j - i),
                    pa.array(np.diff(found.a_at)), pa.array(np.diff(found.b_at)), pa.array(np.diff(found.at)),
                    pa.array(groups, pa.string()),
                    pa.array([blob(found.pairs[x:y]) for x, y in zip(at[:-1], at[1:])], pa.binary()),
                    pa.nulls(j - i, kinds[6]), pa.nulls(j - i, kinds[7]),
                ]
                yield pa.RecordBatch.from_arrays(rows, names)
                if counts.n > HELD_PAIRS:
                    yield counted(counts)
                    counts = PairCounts()
        yield counted(counts)

    longs = ", ".join(f"{n} long" for n in names[:4])
    return texts_of(docs).mapInArrow(apply, f"{longs}, groups string, links binary, pairs array<long>, counts array<long>")


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, n, best``: links of each id pair in the corpus, and whether no pair with the same second
    id has more. At most the product of the vocabularies' sizes, and one row per task and pair before the sum."""
    rows = found.where("n_a IS NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    sums = rows.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    sums = sums.withColumn("b", F.col("pair").bitwiseAND(0xFFFF))
    most = sums.groupBy("b").agg(F.max("n").alias("most"))
    return sums.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, first: str | None = None, second: str | None = None, digests: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for each row of ``docs``.

    The text after a space is encoded by both tokenizers (paths of the vocabulary files ``first`` and
    ``second``). Offsets where tokens of both end cut them into groups; the two tokens that end there
    are linked. ``n_best`` counts links whose id pair is linked as often in the corpus as any pair with its
    second id, ``count_sum`` sums the corpus counts of all links. Null and empty texts, and texts that the
    second tokenizer does not give back byte for byte, have no tokens: zeros and empty ``groups``.
    Rows are taken one by one, with or without an id, repeated or not; other columns are left out.
    ``groups`` is several times as long as the text; with ``digests`` it is the SHA-256 of that (hexadecimal),
    so that the long form is neither written nor sent.
    """
    found = written(alignments(docs, first, second, digests), "alignments")
    pairs = written(pair_counts(found), "alignment-pairs")
    texts = found.where("n_a IS NOT NULL").select("doc_id", "n_a", "n_b", "n_groups", "groups", "links")
    shards = parts_for(pairs.count(), SHARD_PAIRS)
    for shard in range(shards):
        # bounded by SHARD_PAIRS, and evenly spread; one shard unless the vocabularies pair very freely
        here = pairs.where(F.pmod(F.xxhash64("pair"), F.lit(shards)) == shard) if shards > 1 else pairs
        texts = _with_counts(texts, here)
    return texts.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *(
        F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")
    ), "groups") if shards else texts


def _with_counts(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``texts`` with what these pairs add to ``n_best`` and ``count_sum``."""
    held = pairs.toArrow()
    order = np.argsort(held.column("pair").to_numpy())
    pair = held.column("pair").to_numpy()[order].astype(np.uint32)
    value = held.column("n").to_numpy()[order]
    best = held.column("best").to_numpy()[order]
    sent = texts.sparkSession.sparkContext.broadcast((pair, value, best))
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "links", "n_best", "count_sum"]
    old = [c for c in names if c in texts.columns]

    def apply(batches):
        pair, value, best = sent.value
        for batch in batches:
            links = batch.column(old.index("links"))
            n = np.diff(text_buffer(links)[1]) // 4
            all_ = joined(links, np.uint32)
            at = np.minimum(np.searchsorted(pair, all_), max(0, len(pair) - 1))
            hit = pair[at] == all_ if len(pair) else np.zeros(len(all_), bool)
            sums = []
            for values in (best, value):
                upto = np.concatenate(([0], np.cumsum(np.where(hit, values[at] if len(pair) else 0, 0))))
                ends = np.cumsum(n)
                sums.append(upto[ends] - upto[ends - n])
            columns = {c: batch.column(k) for k, c in enumerate(old)}
            for c, more in zip(("n_best", "count_sum"), sums):
                columns[c] = pa.array(more + (columns[c].to_numpy() if c in columns else 0), pa.int64())
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return texts.mapInArrow(apply, "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary, n_best long, count_sum long")

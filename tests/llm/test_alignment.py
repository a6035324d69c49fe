"""Tokenizer alignment against the tokenizers' own output and a plain merge of end offsets."""

import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.brute import sha
from wardlight.llm import alignment
from wardlight.llm.queries import QUERIES
from wardlight.llm.subword import _byte_letters

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    """``text -> (a ids, b ids, groups, links)``, none for texts without tokens."""
    first = Tokenizer.from_file(alignment.tokenizer_path(alignment.FIRST))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.tokenizer_path(alignment.SECOND))
    letters = _byte_letters()
    spelled = {i: bytes(letters[c] for c in t) for t, i in first.get_vocab(False).items()}

    def raw(i):
        return bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()

    def encode(text):
        if not text:
            return None
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        x, y = [spelled[i] for i in a], [raw(i) for i in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            return None
        a_end, b_end = np.cumsum([len(t) for t in x]).tolist(), np.cumsum([len(t) for t in y]).tolist()
        i = j = 0
        groups, links = [], []
        for end in sorted({*a_end} & {*b_end}):
            p, q = a_end.index(end, i) + 1, b_end.index(end, j) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        return a, b, ";".join(groups), links

    return encode


def digests(plain, docs):
    """Rows of the query for ``(id, text)`` pairs."""
    found = [(k, plain(t)) for k, t in docs]
    counts = Counter(x for _, f in found if f for x in f[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    for k, f in found:
        if f is None:
            yield k, 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, groups, links = f
            yield (k, len(a), len(b), groups.count(";") + 1, len(links), sum(counts[x] == most[x[1]] for x in links),
                   sum(counts[x] for x in links), sha(groups))


def odd_texts():
    out = ["", " ", "  ", "a  b   c \n d\n  e", "\n x", "x\n", "▁a b", "<unk> <s>", "<|endoftext|> a", "日本語 " * 50, "é" * 300 + " ﬁ",
           "z" * 3000 + " y", "\x00 \x1c a\x1c b", "  a  b \x85 c\x85 d", "a　 b \t c", "1234 5 67", "emoji 🙂🙂 ok", "don't I'll we're 's", "é a"]
    return out + ["".join(random.Random(i).choices(" \n\t ab1,.'é語🙂", k=60)) for i in range(120)]


@pytest.mark.parametrize("lane", [4, 512])
def test_groups_and_links_of_odd_and_real_texts(llm, plain, monkeypatch, lane):
    monkeypatch.setattr(alignment, "LANE", lane)
    known = alignment.tokens(alignment.tokenizer_path(alignment.FIRST), alignment.tokenizer_path(alignment.SECOND))
    texts = odd_texts() + [r.text or "" for r in llm.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    found = alignment.Aligned(known, texts)
    for i, (text, groups) in enumerate(zip(texts, found.groups())):
        pairs = [(int(p) >> 16, int(p) & 0xFFFF) for p in found.pairs[found.at[i] : found.at[i + 1]]]
        expected = plain(text)
        assert (groups, pairs) == (("", []) if expected is None else expected[2:]), text[:80]


def test_first_ids_equal_the_librarys_over_all_of_unicode():
    known = alignment.tokens(alignment.tokenizer_path(alignment.FIRST), alignment.tokenizer_path(alignment.SECOND))
    library = Tokenizer.from_file(alignment.tokenizer_path(alignment.FIRST))
    library.encode_special_tokens = True
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)} .{chr(c)}." for c in points[i : i + 4096]) for i in range(0, len(points), 4096)]
    for text, own in zip(texts, library.encode_batch([" " + t for t in texts], add_special_tokens=False)):
        assert known.number[known.first.encode_ordinary(" " + text)].tolist() == own.ids


@pytest.mark.parametrize("seed", range(30))
def test_random_ends(seed):
    """Rising end offsets of several texts; groups end exactly where both sides do."""
    r = random.Random(seed)
    a_end, b_end, a_at, b_at, base = [], [], [0], [0], 0
    for _ in range(r.randrange(1, 6)):
        size = r.choice([0, 1, 3, 50, 3000])
        if size:
            keep = r.choice([0.05, 0.5, 0.95])
            for ends in (a_end, b_end):
                ends += [base + e for e in range(1, size) if r.random() < keep] + [base + size]
        base += size
        a_at.append(len(a_end))
        b_at.append(len(b_end))
    a, b = np.array(a_end, np.int64), np.array(b_end, np.int64)
    x, y = alignment.aligned(a, b, np.array(a_at), np.array(b_at))
    both = sorted({*a_end} & {*b_end})
    assert a[x].tolist() == both and b[y].tolist() == both


@pytest.mark.parametrize("shard,held", [(2_000_000, 1_000_000), (500, 300)])
def test_odd_rows_against_brute_force(llm, odd, odd_rows, none, plain, monkeypatch, shard, held):
    monkeypatch.setattr(alignment, "SHARD_PAIRS", shard)
    monkeypatch.setattr(alignment, "HELD_PAIRS", held)
    got = [
        (*tuple(r)[:-1], sha(r.groups) if r.groups else "")
        for r in alignment.align(odd).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    ]
    assert sorted(map(str, got)) == sorted(map(str, digests(plain, odd_rows)))
    assert alignment.align(none).count() == 0


def test_query_against_brute_force(llm, plain):
    got = [tuple(r) for r in QUERIES["op12_tokenizer_alignment"](llm, SMALL).collect()]
    docs = [(r.doc_id, r.text) for r in llm.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(got) == sorted(digests(plain, docs))

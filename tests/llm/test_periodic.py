"""Periodic runs against a direct search over all periods."""

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute import WORD, sha
from wardlight.llm import periodic
from wardlight.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def runs_of_words(words):
    """``(start, end, period)``: every stretch on which words a period apart agree, by direct comparison."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in found.items())


def digest(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    n = len(words)
    h = crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(runs_of_words(words), key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    gone = {i for a, b, q in runs for i in range(a + q, b)}
    shown = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
    return (len(runs), *shown, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def found(texts, order=None):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return [(sorted(map(tuple, own.tolist())), keep.tolist()) for _, own, keep in periodic.runs_per_text(batch, order)]


def some_texts(n=120):
    r = random.Random(11)
    out = []
    for _ in range(n):
        letters, size = r.choice([1, 2, 2, 3, 5, 30]), r.choice([0, 5, 12, 13, 30, 80, 200])
        words = [f"w{r.randrange(letters)}" for _ in range(size)]
        if r.random() < 0.5 and size > 20:
            p = r.randrange(1, size // 2)
            a = r.randrange(size - 2 * p + 1)
            for i in range(a + p, min(size, a + p * r.randrange(2, 5))):
                words[i] = words[i - p]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("appended", [1, 7, 64, 1 << 17])
def test_any_number_of_words_appended_at_a_time(monkeypatch, appended):
    monkeypatch.setattr(periodic, "APPENDED", appended)
    texts = some_texts(40 if appended < 10 else 120)
    for text, (own, keep) in zip(texts, found(texts)):
        expected = runs_of_words(text.split())
        assert own == expected
        gone = {i for a, b, q in expected for i in range(a + q, b)}
        assert [i for i, k in enumerate(keep) if not k] == sorted(gone)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=90))
def test_two_words(words):
    assert found([" ".join(words)])[0][0] == runs_of_words(words)


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    real = periodic.span_hashes
    monkeypatch.setattr(periodic, "span_hashes", lambda *a, **k: real(*a, **k) % np.uint64(3) << np.uint64(1))
    texts = some_texts(60)
    assert [own for own, _ in found(texts)] == [runs_of_words(t.split()) for t in texts]


def test_runs_come_out_once_nothing_can_extend_them():
    words = np.array([2 * (i % 3) + 100 for i in range(30)] + [2 * i + 500 for i in range(64)], np.uint64)
    stream = periodic.Stream(len(words))
    seen = [len(stream.append(words[i : i + 1])) > 0 for i in range(len(words))]
    assert not any(seen[:30]) and any(seen[30:60])


def test_one_word_over_and_over_and_a_long_period():
    size = 40_000
    long = " ".join(f"p{i}" for i in range(9_000))
    got = found(["ab " * size, f"{long} {long} tail"])
    assert got[0] == ([(0, size, 1)], [True] + [False] * (size - 1))
    assert got[1][0] == [(0, 18_000, 9_000)]


def test_odd_rows_against_brute_force(llm, odd, odd_rows, none, tmp_path):
    got = {}
    for r in periodic.find_runs(odd, periodic.planted_order).collect():
        got.setdefault(r.doc_id, []).append(
            (r.n_runs, r.start, r.length, r.period, r.exponent_milli, sha(r.runs), sha(r.collapsed))
        )
    by_id = {}
    for k, t in odd_rows:
        if len(t or "") < 20_000:
            by_id.setdefault(k, []).append(digest(k, t))
    order = lambda rows: sorted(map(str, rows))
    for k, rows in by_id.items():
        assert order(got[k]) == order(rows), k
    assert got[1020][0][:5] == (1, 0, 30_000, 1, 30_000_000) or crc32(b"1020") % 10 == 0
    assert periodic.find_runs(none).count() == 0


def test_query_against_brute_force(llm):
    rows = QUERIES["op11_periodic_runs"](llm, SMALL).collect()
    texts = {r.doc_id: r.text for r in llm.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    checked = 0
    for r in rows:
        if len(texts[r.doc_id] or "") < 8_000:
            assert tuple(r)[1:] == digest(r.doc_id, texts[r.doc_id]), r.doc_id
            checked += 1
    assert checked > 100 and any(r.n_runs for r in rows)

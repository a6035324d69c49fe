"""SimHash classes against direct comparison of all fingerprints."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.brute import LOWER, WORD
from wardlight.llm import simhash
from wardlight.llm.common import text_buffer
from wardlight.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def labels(fps):
    """Least place that links lead to, by direct comparison."""
    a, b = [], []
    for i in range(0, len(fps), 1000):
        x, y = np.nonzero(np.bitwise_count(fps[i : i + 1000, None] ^ fps[None]) <= 2)
        a.append(x + i)
        b.append(y)
    return spread(np.concatenate(a), np.concatenate(b), len(fps))


def spread(a, b, n):
    out = np.arange(n)
    node, low = simhash.forest(a, b, n)
    out[node] = low
    return out


def classes(rows):
    """``(id, fingerprint, component)`` of ``(id, text)`` pairs."""
    fps = [fingerprint(t) for _, t in rows]
    held = [i for i, (k, _) in enumerate(rows) if k is not None]
    label = labels(np.array([fps[i] for i in held], np.uint64))
    least = {}
    for i, l in zip(held, label.tolist()):
        least[l] = min(least.get(l, rows[i][0]), rows[i][0])
    component = {i: least[l] for i, l in zip(held, label.tolist())}
    return [(k, f"{fp:016x}", component.get(i)) for i, ((k, _), fp) in enumerate(zip(rows, fps))]


def sets_of_fingerprints():
    rng = np.random.default_rng(3)
    one = np.uint64(1)
    some = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    flips = [one << rng.integers(0, 64, 6000, dtype=np.uint64) for _ in range(3)]
    yield "spread", rng.integers(0, 1 << 63, 6000, dtype=np.uint64) << one
    yield "close together", rng.integers(0, 1 << 14, 4000, dtype=np.uint64) & rng.integers(0, 1 << 14, 4000, dtype=np.uint64)
    yield "groups", np.repeat(some, 60) ^ flips[0] ^ flips[1] ^ flips[2]
    yield "a chain", np.cumsum(one << (np.arange(0, 63, dtype=np.uint64)), dtype=np.uint64)


@pytest.mark.parametrize("name,fps", list(sets_of_fingerprints()))
@pytest.mark.parametrize("leaf", [100, 1])
def test_trees_and_shards_lose_no_link(name, fps, leaf):
    fps = np.random.default_rng(4).permutation(np.unique(fps))
    expected = labels(fps)
    assert (spread(*simhash.links_in(fps, len(fps)), len(fps)) == expected).all()
    tree = simhash.TopTree.fitted(fps[:: max(1, len(fps) // 200)], leaf)
    a, b, home = [], [], 0
    for _, own, visiting in tree.dealt(fps):
        at = np.concatenate([own, visiting])
        x, y = simhash.links_in(fps[at], len(own))
        a.append(at[x])
        b.append(at[y])
        home += len(own)
    assert home == len(fps)
    assert (spread(np.concatenate(a), np.concatenate(b), len(fps)) == expected).all()


def test_few_pairs_are_held(monkeypatch):
    monkeypatch.setattr(simhash, "HELD_PAIRS", 50)
    for _, fps in sets_of_fingerprints():
        fps = np.unique(fps)
        assert (spread(*simhash.links_in(fps, len(fps)), len(fps)) == labels(fps)).all()


def test_shingle_hash_is_sparks(llm):
    row = llm.range(1).select(F.xxhash64(F.lit("a bé c")).alias("h")).first()
    data, off = text_buffer(llm.createDataFrame([("A bé  C",)], "t string").toArrow().column(0))
    assert int(simhash.fingerprints(data, off).view(np.int64)[0]) == row.h


@pytest.mark.parametrize("shard,hot", [(50_000, 1_000_000), (8, 1)])
def test_odd_rows_against_brute_force(llm, odd, odd_rows, none, monkeypatch, shard, hot):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "HOT", hot)
    if shard < 100:
        monkeypatch.setattr(simhash, "SAMPLE_SHARE", 2)
        monkeypatch.setattr(simhash, "SAMPLE_LEAF", 2)
    got = [tuple(r) for r in simhash.near_classes(odd).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(map(str, got)) == sorted(map(str, classes(odd_rows)))
    assert simhash.near_classes(none).count() == 0


def test_query_against_brute_force(llm):
    rows = [(r.doc_id, r.text) for r in llm.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op13_simhash_classes"](llm, SMALL).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(classes(rows))

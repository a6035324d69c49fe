"""The methods inside the tasks against plain versions."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from wardlight.llm import (
    common, decontaminate, jaccard, language, lines, nearest, packing, pii, quality, repeats, suffix_array, suffix_trees,
)
from wardlight.llm.subword import subwords, vocabulary_path

settings.register_profile("llm", deadline=None)  # first calls load tables
settings.load_profile("llm")


def buffer(texts):
    return common.text_buffer(pa.array(texts, pa.string()))


@given(st.lists(st.text("aB \t\né日", max_size=30), max_size=8))
def test_words_and_hashes(texts):
    data, off = buffer(texts)
    starts, ends, at = common.word_spans(data, off)
    raw = data.tobytes()
    found = [[raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(at[:-1], at[1:])]
    assert found == [brute.WORD.findall(t) for t in texts]
    words = [w.translate(brute.LOWER) for row in found for w in row]
    h = common.span_hashes(data, starts, ends, lower=True)
    assert len(set(h.tolist())) == len(set(words))
    assert {w: x for w, x in zip(words, h.tolist())} == dict(zip(words, h.tolist()))


def test_parts_agree_with_spark(llm):
    ids = [0, 1, -1, 7, 2**40 + 3, -(2**62), 123456789]
    got = llm.createDataFrame([(i,) for i in ids], "i long").select(common.part_of("i", 37)).collect()
    assert [r[0] for r in got] == common.parts_of_ids(np.array(ids), 37).tolist()


@given(st.text("ab.@-_+% c1", max_size=60))
@settings(max_examples=400)
def test_emails_follow_the_pattern(text):
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert pii.emails(text) == [("email", m.start(), m.end()) for m in plain.finditer(text)]


@given(st.text("0123 .-+()25", max_size=50))
@settings(max_examples=400)
def test_base_patterns(text):
    def found(kind, pattern, ok):
        return [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m[0])]

    digits = lambda s: re.sub(r"\D", "", s)
    expected = found("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split(".")))
    expected += found("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)))
    expected += found("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)
    assert pii.base_spans(text) == expected


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [k for k, _, _ in pii.more_spans(t, pii.base_spans(t))]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert kinds("pay to GB82 WEST 1234 5698 7654 33 now") == []
    assert kinds("his social security number is 123-45-6789.") == ["ssn"]
    assert kinds("the code 123-45-6789 of the part") == []
    assert kinds("call 030 1234567 today") == ["national"] and kinds("lot 030 1234567 today") == []
    assert kinds('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == ["secret"]
    assert kinds("the longword" + "x" * 40) == []
    assert pii.masked("mail a@b.co or +1 202 555 0100") == "mail <email> or <phone>"
    assert pii.base_spans("1" * 100_000 + "." + "2" * 5000 + ".3.4") == []  # very long runs stay linear
    assert pii.emails("a" * 200_000) == [] and pii.emails("a" * 50_000 + "@") == []


@given(st.lists(st.binary(min_size=1, max_size=18), min_size=1, max_size=60, unique=True))
def test_cuckoo_filter(keys):
    keys = [k.ljust(18, b"\1") for k in dict.fromkeys(keys)]
    held = lines.CuckooFilter.of(keys)
    assert all(k in held for k in keys)
    again = lines.CuckooFilter.load(held.dump())
    for k in keys:
        assert again.delete(k)
    assert not again.table.any() and not any(k in again for k in keys)


@given(st.lists(st.sampled_from([b"abcab", b"ba", b"c", b"aaaaaaaaaa", b"abcabcabcabc"]), min_size=1, max_size=60),
       st.integers(8, 40), st.integers(3, 50))
@settings(max_examples=60, deadline=None)
def test_suffix_sort(parts, window, block):
    text = np.frombuffer(b"".join(parts), np.uint8)
    at = np.arange(max(0, len(text) - window + 1))
    raw = text.tobytes()
    place, seen = [], {}
    for places, number in suffix_array.equal_windows(text, at, window, block):
        for p, n in zip(places.tolist(), number.tolist()):
            place.append(p)
            seen.setdefault(raw[p : p + window], set()).add((n, int(places[0])))
    assert [raw[p : p + window] for p in place] == sorted(raw[p : p + window] for p in at)
    assert all(len(v) == 1 for v in seen.values())


def test_cover_reaches_every_pair():
    p = suffix_array.PERIOD
    for a in range(p):
        for b in range(p):
            s = suffix_array.SHIFTS[a, b]
            assert (a + s) % p in suffix_array.COVER and (b + s) % p in suffix_array.COVER


@given(st.lists(st.integers(0, 3), min_size=6, max_size=200), st.integers(2, 40))
@settings(max_examples=60, deadline=None)
def test_suffix_trees(symbols, most):
    symbols = np.array(symbols, np.uint32)
    depth = 4
    at = np.arange(len(symbols) - depth + 1)
    seen, covered = {}, []
    for batch in suffix_trees.prefix_groups(symbols, at, depth, most):
        leaves, parted = suffix_trees.subtree(symbols, batch, depth)
        node = suffix_trees.deep_nodes(parted, depth)
        covered += leaves.tolist()
        for p, n in zip(leaves.tolist(), node.tolist()):
            key = tuple(symbols[p : p + depth].tolist())
            assert seen.setdefault(key, (id(leaves), n)) == (id(leaves), n)
        assert len(set(node.tolist())) == len({tuple(symbols[p : p + depth].tolist()) for p in leaves})
    assert sorted(covered) == at.tolist()


@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=25))
@settings(max_examples=100, deadline=None)
def test_divide_skip(sets):
    values = np.concatenate([np.sort(np.array(sorted(s), np.uint64)) for s in sets])
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    linked = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    held = jaccard.Lists(values, at, 75)
    for d, s in enumerate(sets):
        others = np.ones(len(sets), bool)
        assert held.search(d, others) == [x for x, o in enumerate(sets) if x != d and linked(s, o)]
        assert all(held.linked(d, x) == linked(s, o) for x, o in enumerate(sets))
    root = list(range(len(sets)))
    for _ in sets:
        for i, s in enumerate(sets):
            for j, o in enumerate(sets):
                if linked(s, o):
                    root[i] = root[j] = min(root[i], root[j])
    assert jaccard.classes(values, at).tolist() == root


def test_attention_gradient():
    rng = np.random.default_rng(0)
    w = {n: x.astype(np.float64) for n, x in language.first_weights().items()}
    after = rng.normal(size=(language.ROWS, language.CLASSES))
    rows, target = rng.integers(0, 50, (3, 9)), rng.integers(0, language.CLASSES, (3, 9))
    seen = rng.random((3, 9)) < 0.8
    _, g = language.gradients(w, rows, target, seen, after)
    for name in w:
        spot = tuple(rng.integers(0, s) for s in w[name].shape) if name != "e" else (int(rows[0, 0]), 3)
        if name == "p":
            spot = (2, 3)
        keep, step = w[name][spot], 1e-4
        w[name][spot] = keep + step
        up, _ = language.gradients(w, rows, target, seen, after)
        w[name][spot] = keep - step
        down, _ = language.gradients(w, rows, target, seen, after)
        w[name][spot] = keep
        assert abs((up - down) / (2 * step) - g[name][spot]) < 1e-3


def some_model(rng, size=3000):
    counts = rng.integers(0, 50, size).astype(np.float32)
    row, own = language.ranked_rows(counts)
    klass, inside = language.classes_of(counts, own, rng.integers(0, 9, (size, language.OWN_CLASSES)).astype(float))
    after = language.following(rng.integers(0, 9, (language.ROWS, language.CLASSES)).astype(float))
    weights = {n: x + 0.1 * rng.normal(size=x.shape).astype(np.float32) for n, x in language.first_weights().items()}
    return language.Model(weights, language.Tables(row, klass, inside, after))


def test_classes_and_tables_are_distributions():
    model = some_model(np.random.default_rng(2))
    t = model.tables
    assert np.allclose(np.bincount(t.klass, np.exp(t.inside), language.CLASSES)[np.unique(t.klass)], 1, atol=1e-3)
    assert np.allclose(np.exp(t.after).sum(axis=1), 1, atol=1e-4)
    assert (np.bincount(t.klass[:], minlength=language.CLASSES)[: language.OWN_CLASSES] == 1).all()


def test_companies_part_subwords_of_different_texts():
    """Subwords that stand among the same frequent ones are in one company."""
    rng = np.random.default_rng(6)
    near = np.zeros((400, language.OWN_CLASSES))
    near[:200, :16] = rng.poisson(30, (200, 16))
    near[200:, 16:] = rng.poisson(30, (200, 16))
    group = language.companies(near, np.full(400, 10.0), np.arange(400))
    assert not {*group[:200]} & {*group[200:]}


def test_each_subword_scored_once_and_causally():
    rng = np.random.default_rng(1)
    model = some_model(rng)
    ids = rng.integers(0, 3000, 150).astype(np.int32)
    at = np.array([0, 0, 7, 7, 150])
    got = language.score_subwords(model, ids, at, 2998)
    changed = ids.copy()
    changed[100:] = (changed[100:] + 1) % 3000  # later subwords must not matter
    assert np.allclose(got[:100], language.score_subwords(model, changed, at, 2998)[:100], atol=1e-5)
    short = language.score_subwords(model, ids[:7], np.array([0, 7]), 2998)
    assert np.allclose(got[:7], short, atol=1e-5)  # texts do not see each other


def plain_scores(model, ids, start):
    """One place at a time: attention over the subwords from the window's start to this place."""
    w, t = {n: x.astype(float) for n, x in model.weights.items()}, model.tables
    before = [start, *ids[:-1]]
    stride = language.WINDOW - language.OVERLAP
    out = []
    for i, x in enumerate(ids):
        k = 0 if i < language.WINDOW else (i - language.OVERLAP) // stride
        places = range(k * stride, i + 1)
        rows = [t.row[before[j]] for j in places]
        inputs = [w["e"][r] + w["p"][j - k * stride] for r, j in zip(rows, places)]
        q, keys, values = inputs[-1] @ w["qkv"][:, :16], [y @ w["qkv"][:, 16:32] for y in inputs], [y @ w["qkv"][:, 32:] for y in inputs]
        a = np.exp([np.clip(q @ y / 4, -30, 30) for y in keys])
        z = sum(p * v for p, v in zip(a / a.sum(), values)) + inputs[-1]
        s = z @ w["o"] + w["b"] + t.after[rows[-1]]
        out.append(s[t.klass[x]] - np.log(np.exp(s).sum()) + t.inside[x])
    return np.array(out)


def test_scores_against_one_place_at_a_time():
    rng = np.random.default_rng(4)
    model = some_model(rng)
    for n in (1, language.WINDOW, language.WINDOW + 1, 200):
        ids = rng.integers(0, 3000, n).astype(np.int32)
        got = language.score_subwords(model, ids, np.array([0, n]), 2998)
        assert np.allclose(got, plain_scores(model, ids, 2998), atol=1e-3)


def test_mixture_follows_the_better_side():
    counts = np.repeat([0, 40], 500)
    counted = np.where(counts, -2.0, -6.0)
    weight = language.mixture(counted, np.where(counts, -6.0, -2.0), counts)[language._ranges_of(np.array([0, 40]))]
    assert weight[0] < 0.05 and weight[1] > 0.95
    assert np.allclose(language.mixture(counted[:0], counted[:0], counts[:0]), 0.5)


def test_scores_of_a_part_against_plain_arithmetic():
    """Words' own products of subwords, mixture weights by plain steps, sums over each text."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    encode = language.subwords()
    size = encode.size + 2
    model = some_model(rng, size)
    words = [f"word{'abcdefgh'[i % 8]}{i}" for i in range(25)]
    ids = [i if i else None for i in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in ids]
    part = language.Part.spelled(ids, pa.array(texts), encode, 1)
    got = language.score_part(model, part, part.n.astype(np.int64), 500, 26, size)
    c = {"": sum(not language.held_out(d) for d in ids)}
    for d, text in zip(ids, texts):
        for x in text.split():
            c[x] = c.get(x, 0) + (not language.held_out(d))
    rows = []
    for d, text in zip(ids, texts):
        tokens = [*text.split(), ""]
        subs = [encode.many([x])[0] if x else np.array([size - 1]) for x in tokens]
        logs = plain_scores(model, np.concatenate(subs), size - 2) / np.log(10)
        ends = np.cumsum([len(s) for s in subs])
        rows.append((d, tokens, [logs[e - len(s) : e].sum() for s, e in zip(subs, ends)]))
    kind = lambda n: min(max(n, 0).bit_length(), language.MIXED - 1)
    seen = [
        (c[x] - tokens.count(x), s) for d, tokens, spell in rows if language.fold(d) == language.KEPT_FOLD
        for x, s in zip(tokens, spell)
    ]
    weight = dict.fromkeys(range(language.MIXED), 0.5)
    for _ in range(language.MIXED_STEPS):
        shares = {k: [] for k in weight}
        for n, s in seen:
            w, p = weight[kind(n)], (n + 1) / 527
            shares[kind(n)].append(w * p / (w * p + (1 - w) * 10**s))
        weight = {k: (sum(v) + 5) / (len(v) + 10) for k, v in shares.items()}
    expected = [
        sum(np.log10(weight[kind(c[x])] * (c[x] + 1) / 527 + (1 - weight[kind(c[x])]) * 10**s) for x, s in zip(tokens, spell))
        for _, tokens, spell in rows
    ]
    assert np.allclose(got["score"], expected, atol=1e-2)


def test_subword_ids_equal_the_library():
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary_path())
    exact.encode_special_tokens = True
    texts = ["", " ", "it's They'LL ''s 'tis", "Straße.### ÀÉÎ õ÷× ½ ¿que? <|endoftext|>", "a1b22 3.14 e-mail@x", "日本語 naïvé",
             "ſ K İ ǅ", "x" * 300, "\x00\x1c ", "Ünïcödé!!! &&&%%%", "’s 'S"]
    for found, text in zip(subwords().many(texts), texts):
        assert found.tolist() == exact.encode(text, add_special_tokens=False).ids, text


@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=40), min_size=1, max_size=30))
@settings(deadline=None)
def test_pack(docs):
    tokens = [np.array(d, np.int32) for d in docs]
    rows = packing.pack(tokens, 16)
    covered = sorted((d, s, s + n) for d, s, n, _, _ in rows)
    for d, t in enumerate(tokens):
        mine = [(a, b) for k, a, b in covered if k == d]
        assert mine[0][0] == 0 and mine[-1][1] == len(t) and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))
    filled = {}
    for _, _, n, q, o in rows:
        assert filled.get(q, 0) == o
        filled[q] = o + n
    assert all(n == 16 or n & (n - 1) == 0 for n in filled.values())
    assert sum(n == 16 for n in filled.values()) == sum(map(len, docs)) // 16


def test_packing_prefers_neighbours():
    rng = np.random.default_rng(2)
    topics = [rng.integers(100 * k, 100 * k + 10, (6, 8)) for k in range(1, 4)]
    docs = [topics[i % 3][i // 3].astype(np.int32) for i in range(18)]
    first = {}
    for d, _, _, q, _ in packing.pack(docs, 48):
        first.setdefault(q, set()).add(d % 3)
    assert all(len(v) == 1 for v in first.values())


def test_packing_scores_all_shared_terms():
    """Document 1 shares one of the seed's twelve rarest terms, document 2 forty others."""
    seed, fill = np.arange(60), lambda a: np.arange(1000 * a, 1000 * a + 100)
    docs = [seed, np.append(seed[:1], fill(1)), np.append(seed[20:], fill(2)), *[np.append(seed[k:12], fill(3 + k)) for k in range(1, 12)],
            *[np.append(seed[12:], fill(20 + k)) for k in range(12)]]
    index = packing.Postings([d.astype(np.int32) for d in docs])
    bm25 = np.zeros(len(docs))
    mean = np.mean([len(d) for d in docs])
    for t in seed:
        df = sum(t in d for d in docs)
        idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
        bm25 += [idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(d) / mean)) if df > 1 and t in d else 0 for d in docs]
    used = np.arange(len(docs)) == 0
    got = index.neighbours(0, used, len(docs))
    assert sorted(got) == sorted(np.flatnonzero((bm25 > 0) & ~used))
    assert np.all(np.diff(bm25[got]) <= 1e-5) and bm25[2] > bm25[1] and list(got).index(2) < list(got).index(1)
    few = index.neighbours(0, used, 3)
    assert len(few) >= 3 and np.array_equal(few, got[: len(few)])


def test_release_gives_memory_back():
    """Small freed arrays below one that is still in use."""
    def held():
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("RssAnon"))

    before = held()
    many = [np.ones(8_000) for _ in range(3_000)]  # 192 MB in pieces that stay in the heap
    last = np.ones(8_000)
    many.clear()
    common.release()
    assert held() - before < 60_000 and len(last)


def leak_bodies(item):
    data, off = buffer([item])
    return decontaminate.plain(data, off)[0].tobytes().rstrip(b" ")


def test_leaks_against_alignment():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    items = [(i, say(30 + 5 * i)) for i in range(6)]
    held = decontaminate.Segments.of(items)
    texts = []
    for k in range(60):
        body = list(items[k % 6][1])
        for _ in range(int(rng.integers(0, 30))):
            at = int(rng.integers(0, len(body)))
            body[at : at + int(rng.integers(0, 2))] = rng.choice(list("xyz "), int(rng.integers(0, 2))).tolist()
        texts.append(say(20) + ", " + "".join(body) + "! " + say(20))
    texts += [say(60), "", "short"]
    data, off = buffer(texts)
    row, item, start, end, edits = decontaminate.leaks(held, data, off)
    expected = set()
    for r, t in enumerate(texts):
        body = leak_bodies(t)
        for s in range(len(held.length)):
            n = int(held.length[s])
            if brute.fewest_edits(held.text[s, :n].tobytes(), body) <= decontaminate.budget(n):
                expected.add((r, int(held.item[s])))
    assert set(zip(row.tolist(), item.tolist())) == expected and len(expected) > 10
    raw = data.tobytes()
    for r, i, a, b, e in zip(row, item, start, end, edits):
        if e == 0:
            assert leak_bodies(raw[off[r] + a : off[r] + b].decode(errors="replace")) in leak_bodies(items[i][1]) or b - a >= 120


def test_a_search_holds_little_whatever_the_batch():
    rng = np.random.default_rng(3)
    words = ["".join(w) for w in rng.choice(list("abcdefgh"), (2000, 6))]
    item = " ".join(words[:40])
    texts = [" ".join(rng.choice(words, 1500)) for _ in range(800)]  # 8 MB, a batch
    texts[5], texts[700] = texts[5] + " " + item, item + " " + texts[700]
    segments, column = decontaminate.Segments.of([(1, item)]), pa.array(texts)
    tracemalloc.start()
    found = [(i + r).tolist() for i, _, _, (r, *_) in decontaminate.searched(segments, column)]
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(found, []) == [5, 700]
    assert held < 80 << 20


def test_leaks_ignore_case_and_marks():
    item = "Éâtre ou la vérité, dit-il; et puis rien de plus que cela pour aujourd'hui, mes amis de toujours et d'ici."
    held = decontaminate.Segments.of([(4, item), (5, "too short")])
    data, off = buffer(["x " + item.upper().replace(",", " --") + " y", item[:60], item])
    row, found, *_ = decontaminate.leaks(held, data, off)
    assert sorted(zip(row.tolist(), found.tolist())) == [(0, 4), (2, 4)]


@given(st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=2, max_size=40), st.integers(1, 5))
@settings(deadline=None)
def test_group_bounds_lose_nothing(vectors, k):
    x = np.array(vectors, float)
    pivots = x[: max(1, len(x) // 6)]
    near = ((x[:, None, :] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1)
    far = np.linalg.norm(x - pivots[near], axis=1)
    size = np.bincount(near, minlength=len(pivots))
    radius = np.array([far[near == g].max() if size[g] else 0 for g in range(len(pivots))])
    pairs = set(nearest.needed(pivots, radius, size, pivots, radius, size, k))
    for q in range(len(x)):
        score = x @ x[q]
        best = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-score[i], i))[:k]
        assert all((near[q], near[i]) in pairs for i in best)


def test_rules_and_lasso():
    rng = np.random.default_rng(4)
    x = rng.random((600, len(quality.STATS)))
    y = ((x[:, 2] < 0.4) & (x[:, 5] > 0.3)).astype(float)
    model = quality.fit(x, y)
    assert 0 < len(model.rules) < 60  # sparse
    margin = model.bias + sum(w * quality._matches(x, r) for r, w in zip(model.rules, model.weights))
    assert ((margin > 0) == (y > 0.5)).mean() > 0.95
    assert quality.fit(x, np.ones(600)).rules == [] and quality.fit(x[:0], y[:0]).bias == 0


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_anchors_follow_the_content(kind):
    shape = suffix_array.SHAPE if kind == "bytes" else suffix_trees.SHAPE
    rng = np.random.default_rng(6)
    shared = rng.integers(0, 60, 700)
    texts = [np.concatenate((rng.integers(0, 60, n), shared, rng.integers(0, 60, 9))) for n in (0, 37, 250)]
    symbols = np.concatenate(texts).astype(shape.kind)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    h, place, lo, hi = repeats.anchors(shape, symbols, off)
    w = shape.window - shape.gram
    assert ((lo <= place) & (place <= hi + w) & (place - hi >= 0)).all()
    windows = {int(p): (int(x), int(a - p)) for x, a, b, e in zip(h, place, lo, hi) for p in range(b, e + 1)}
    inside = [p for a, b in zip(off[:-1], off[1:]) for p in range(a, b - shape.window + 1)]
    assert sorted(windows) == inside  # every window has one anchor
    for p in range(700 - shape.window + 1):
        assert len({windows[n + p + off[i]] for i, n in enumerate((0, 37, 250))}) == 1


def test_statistics_do_not_cross_texts():
    data, off = buffer(["a a", "", "a b", "B!! |"])
    found = quality.measures(data, off)
    alone = [quality.measures(*buffer([t]))[0] for t in ("a a", "", "a b", "B!! |")]
    assert np.allclose(found, np.stack(alone)) and not found[1].any()


def test_windows_hold_every_subword_once():
    subs = np.arange(1, 200, dtype=np.int32)
    at = np.array([0, 1, 33, 65, 66, 199])
    found = language.cut_windows(subs, at, 999)
    assert found.shape[1] == language.WINDOW + 1
    assert found[:, 1:][found[:, 1:] >= 0].tolist() == subs.tolist()
    whole = (at[-1] - at[-2] - 1) // language.WINDOW  # windows of the last text before its last one
    assert (found[:, 0] == 999).sum() == 5 and found[-1, 0] == subs[at[-2] + whole * language.WINDOW - 1]
    assert not len(language.cut_windows(subs[:0], np.zeros(1, np.int64), 999))


def test_leaks_of_passages_at_every_offset():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    item = say(80)[:390].strip()
    held = decontaminate.Segments.of([(7, item)])
    n, more = decontaminate.SEGMENT, decontaminate.STRIDE - 1
    exact = [item[a : a + n] for a in range(len(item) - n + 1)]
    edited = []
    for a in range(len(item) - n - more + 1):
        body = list(item[a : a + n + more])
        for at in rng.choice(len(body), decontaminate.budget(n), replace=False):  # changed, doubled or lost
            body[at] = ["z", body[at] + "z", ""][int(rng.integers(0, 3))]
        edited.append("".join(body))
        assert brute.fewest_edits(edited[-1].encode(), item.encode()) <= decontaminate.budget(n)
    for passages in (exact, edited):
        data, off = buffer([f"{say(12)} {p.strip()} {say(12)}" for p in passages])
        row, found, start, end, _ = decontaminate.leaks(held, data, off)
        assert row.tolist() == list(range(len(passages))) and set(found.tolist()) == {7}
        assert (end - start >= n - 2 * decontaminate.budget(n)).all()
    assert not len(decontaminate.leaks(held, *buffer([say(200)]))[0])


def test_short_items_are_matched_whole():
    held = decontaminate.Segments.of([(1, "Too short, really"), (2, "Éa"), (3, " -- "), (4, "to be or not to be that is it")])
    texts = ["so: too short (REALLY)", "too short reallyx", "éa", "atoo short really", "x éA.", "To be, or not to be: that is it", "to be or not to be"]
    row, item, start, end, edits = decontaminate.leaks(held, *buffer(texts))
    assert list(zip(row.tolist(), item.tolist())) == [(0, 1), (2, 2), (4, 2), (5, 4)] and not edits.any()
    assert texts[0].encode()[start[0] : end[0]] == b"too short (REALLY"


def test_markers_in_texts_are_the_librarys_tokens():
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(vocabulary_path())
    texts = ["end <|endoftext|> next", "<|startoftext|>", "a<|EndOfText|>b", "<|endoftext|", "é<|endoftext|>日", "plain text, 12", ""]
    for found, text in zip(subwords().many(texts, added=True), texts):
        assert found.tolist() == untouched.encode(text, add_special_tokens=False).ids, text
    assert subwords().many(texts[:1], added=True)[0].tolist() == [806, 49407, 1131]


def test_long_secrets():
    for key in ("24be64439e3e49cf" * 8, "aB3/" * 500):
        text = f"secret={key} end"
        assert pii.more_spans(text, pii.base_spans(text)) == [("secret", 7, 7 + len(key))]
    assert pii.more_spans("x1-" * 50_000, []) == []  # no context; a long run is passed over once


def test_overlapping_windows_score_their_new_places_only(monkeypatch):
    rng = np.random.default_rng(14)
    model, asked = some_model(rng), []
    attend = language.attend
    monkeypatch.setattr(language, "attend", lambda *a: (asked.append(found := attend(*a)), found)[1])
    ids = rng.integers(0, 3000, 40_040 + 9).astype(np.int32)
    got = language.score_subwords(model, ids, np.array([0, 40_040, len(ids)]), 2998)
    assert sum(s.shape[0] * s.shape[1] for s, _ in asked) < 1.01 * len(ids)
    assert np.allclose(got[:200], plain_scores(model, ids[:200], 2998), atol=1e-3)
    assert np.allclose(got[-9:], plain_scores(model, ids[-9:], 2998), atol=1e-3)


def test_words_spelled_at_once():
    """Ids of many words from their bytes, also of words outside the plain characters."""
    import random

    pick, letters = random.Random(3), "abcABC0129'.,<|>\u00e9\u00c0\u00ff\u00df\u00d7\x85\u4e2d\u0130\u017f\U0001f600\u0301\x00\x7f"
    words = ["", "", "it's9", "<|endoftext|>x", "ABC'LL", *("".join(pick.choices(letters, k=pick.randint(0, 9))) for _ in range(3000)), ""]
    encode = subwords()
    for some in (words, words[:2], words[:1], []):
        raw = [w.encode() for w in some]
        ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
        starts = ends - np.array([len(w) for w in raw], np.int64)
        ids, sizes = encode.word_ids(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
        expected = [encode.many([w])[0].tolist() for w in some]
        assert sizes.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]

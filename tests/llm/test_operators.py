"""Each operator on whole tables: real documents, then nulls, empty and very long
texts, ties, repeated rows, clashing column names and empty tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import SMALL
from wardlight.llm.common import written
from wardlight.llm import (
    components, decontaminate, jaccard, language, lines, nearest, packing, pii, quality, queries, repeats, suffix_array,
    suffix_trees,
)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def benchmark(llm):
    return llm.read.parquet(f"{SMALL}/benchmark.parquet")


def test_pii(odd, odd_rows, none):
    got = rows(pii.find_pii(odd))
    expected = []
    for k, t in odd_rows:
        base = pii.base_spans(t or "")
        n = Counter(kind for kind, _, _ in base)
        expected.append((k, *(n[x] for x in pii.BASE_KINDS), brute.sha(pii.joined_spans(base)),
                         pii.joined_spans(base + pii.more_spans(t or "", base))))
    assert got == sorted(expected, key=str)
    assert pii.find_pii(none).count() == 0


def test_language(odd, odd_rows, none):
    got = sorted(([*r] for r in language.scored(odd).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    expected = sorted(brute.language(odd_rows), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in expected]
    assert np.allclose([r[5] for r in got], [r[5] for r in expected])
    floor = np.log10(language.LEAST_WEIGHT)
    assert all(np.isfinite(r[6]) and r[6] >= r[5] + r[2] * floor - 1e-6 for r in got)
    assert language.scored(none).count() == 0


def test_language_beats_counts_on_held_out(llm):
    """By far more than a mixture with the counts could lose; and what attention adds to the table of
    following classes, alone, beats that table and the subwords' own frequencies."""
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.scored(docs).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() + 0.05 * got.n_tokens.sum()
    encode = language.subwords()
    size = encode.size + 2
    spelled = language.spelled_parts(docs.select("doc_id", "text"), language.vocabulary_path(), 1, 1)
    model = language.train(spelled, size, 1)
    (_, part), = language.Part.rows(spelled.toArrow())
    subs, where, at = part.subs(np.flatnonzero(part.folds == language.HELD_FOLD))
    alone = language.score_subwords(model, subs, where[at], size - 2).sum()
    still = language.Model({n: 0 * w for n, w in model.weights.items()}, model.tables)
    counts = np.bincount(part.flat, np.repeat(part.n, part.length), size) + 0.5
    assert alone > language.score_subwords(still, subs, where[at], size - 2).sum() + 0.02 * len(subs)
    assert alone > np.log(counts / counts.sum())[subs].sum() + 0.3 * len(subs)


def components_of(odd_rows):
    return brute.link_classes(odd_rows)


@pytest.mark.parametrize("block", [1024, 2])
def test_jaccard(odd, odd_rows, none, monkeypatch, block):
    monkeypatch.setattr(jaccard, "CLASS_DOCS", block)  # with 2, classes are cut into cells
    expected = components_of(odd_rows)
    got = rows(jaccard.link_classes(odd))
    assert len(got) == len(odd_rows)
    assert {r[0]: r[1:] for r in got if r[0] is not None} == expected
    assert sorted(r[1:] for r in got if r[0] is None) == sorted(
        (brute.link_classes([(0, t)])[0][0], None) for k, t in odd_rows if k is None
    )
    assert expected[1005][1] == odd_rows[3][0] and expected[1004][1] == 1003  # ties go to the smallest id
    if block == 2:
        assert jaccard.link_classes(none).count() == 0


def test_jaccard_of_many_near_copies(llm):
    """One large class of different texts, cut into cells."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for d in range(60):
        w = list(base)
        for i in rng.integers(0, 120, int(rng.integers(0, 5))):
            w[i] = f"new{d}x{i}"
        docs.append((d, " ".join(w)))
    docs += [(100 + d, " ".join(f"u{d}y{i}" for i in range(40)) + " " + " ".join(base[:30])) for d in range(20)]
    df = llm.createDataFrame(docs, "doc_id long, text string").repartition(4)
    expected = brute.link_classes(docs)
    old, jaccard.CLASS_DOCS = jaccard.CLASS_DOCS, 7
    try:
        got = {r[0]: tuple(r[1:]) for r in jaccard.link_classes(df).collect()}
    finally:
        jaccard.CLASS_DOCS = old
    assert got == expected


def test_components(llm):
    edges = [(1, 2), (3, 2), (3, 9), (20, 21), (21, 20), (30, 30), *[(100, i) for i in range(101, 130)], *[(i, i + 1) for i in range(200, 260)]]
    got = {r[0]: r[1] for r in components.components(llm.createDataFrame(edges, "a long, b long")).collect()}
    expected = {n: low for low, ns in {1: (1, 2, 3, 9), 20: (20, 21), 30: (30,), 100: range(100, 130), 200: range(200, 261)}.items() for n in ns}
    assert got == expected


def test_quality(odd, none, llm):
    labels = llm.createDataFrame(
        [(i, int(i % 3 > 0), 0, None) for i in range(60)] + [(5, None, 1, None), (None, 1, 0, None), (6, 7, 0, None)],
        "doc_id long, quality int, toxic int, text string",
    )
    got = quality.scored(odd, labels).collect()
    assert len(got) == odd.count()
    for r in got:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out is held and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    kept = quality.accepted(odd, labels)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)
    assert quality.scored(none, labels).count() == 0 and quality.accepted(none, labels).count() == 0
    assert {r.score for r in quality.scored(odd, labels.limit(0)).collect()} == {0.5}


def test_quality_on_held_out_rows(llm):
    sf = "/root/testdata/sf0.01"
    labels = llm.read.parquet(f"{sf}/labels.parquet")
    got = quality.scored(llm.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_nearest(llm):
    rng = np.random.default_rng(9)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    vectors[40] = (40, vectors[20][1])  # ties
    vectors[41] = (41, vectors[20][1])
    vectors += [(900, None), (901, [1.0, None]), (920, [float("nan")] * 6), (940, [float("inf"), 0.0]), (None, [1.0] * 6),
                (960, [0.5, 0.5]), (41, vectors[20][1])]
    df = llm.createDataFrame([(i, v, 1, 2.0) for i, v in vectors], "vec_id long, embedding array<float>, rank int, score double")
    scaled = [(i, [np.floor(64 * float(np.float32(x))) for x in v]) for i, v in vectors
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q in sorted({i for i, _ in scaled if i % 20 == 0}):
        v = next(v for i, v in scaled if i == q)
        found = sorted((-int(sum(a * b for a, b in zip(v, w))), i) for i, w in scaled if i != q)[:4]
        expected += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    assert rows(nearest.top_k(df, 4, 20)) == sorted(expected, key=str)
    for name, value in (("GROUP_QUERIES", 3), ("SLICE_ROWS", 11)):
        old = getattr(nearest, name)
        setattr(nearest, name, value)
        assert rows(nearest.top_k(df, 4, 20)) == sorted(expected, key=str)
        setattr(nearest, name, old)
    assert nearest.top_k(df.limit(0), 4, 20).count() == 0


def test_decontamination(odd, odd_rows, none, benchmark, monkeypatch):
    items = {r.item_id: r.text for r in benchmark.collect()}
    extra = [(2000, "start " + items[3] + " stop"), (2001, items[4].upper()), (2002, items[5][: len(items[5]) // 2])]
    df = odd.unionByName(odd.sparkSession.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, benchmark).collect()}
    assert {(2000, 3), (2001, 4)} <= found
    exact = {(k, i) for k, t in odd_rows for i, x in items.items() if t and x in t}
    assert exact <= found
    clean = decontaminate.without_leaks(df, benchmark)
    assert clean.columns == df.columns
    bad = {k for k, _ in found}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(
        str(k) for k, t in odd_rows + extra if k not in bad or k is None
    )
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)  # several shards, the same result
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, benchmark).collect()} == found
    assert decontaminate.find_leaks(none, benchmark).count() == 0
    assert decontaminate.find_leaks(odd, benchmark.limit(0)).count() == 0
    nulls = odd.sparkSession.createDataFrame([(None, "x"), (1, None), (2, "")], "item_id long, text string")
    assert decontaminate.without_leaks(odd, nulls).count() == len(odd_rows)


def test_packing(odd, odd_rows, none):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.vocabulary_path())
    exact.encode_special_tokens = True
    got = packing.packed(odd).collect()
    ids = defaultdict(list)
    for k, t in odd_rows:
        ids[k].append(np.array(exact.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    filled = defaultdict(list)
    seen = Counter()
    for r in got:
        assert any(r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        filled[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id] += r.length
    assert seen == {k: sum(map(len, v)) for k, v in ids.items()}
    sizes = []
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        sizes.append(at)
    padding = sum(0 if n == 2048 or n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding == 0 and max(sizes) <= 2048
    assert packing.packed(none).count() == 0


def fill_hot(shape):
    return repeats.Shape(shape.window, shape.gram, shape.kind, hot=1)


@pytest.mark.parametrize("hot", [False, True])
def test_word_dedup(odd, odd_rows, none, monkeypatch, hot):
    if hot:  # every repeated anchor takes the way of hot ones
        monkeypatch.setattr(suffix_trees, "SHAPE", fill_hot(suffix_trees.SHAPE))
    found = brute.word_dedup(odd_rows)
    got = [tuple(r) for r in suffix_trees.remove_repeats(odd).collect()]
    assert len(got) == len(odd_rows)
    assert sorted(r for r in got if r[0] is not None) == sorted((k, *found[k, t or ""]) for k, t in odd_rows if k is not None)
    assert all(r[2] == 0 for r in got if r[0] is None)
    assert suffix_trees.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_byte_dedup(odd, odd_rows, none, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix_array, "SHAPE", fill_hot(suffix_array.SHAPE))
    found = brute.byte_dedup(odd_rows)
    got = [(*r[:4], bytes(r[4])) for r in suffix_array.remove_repeats(odd).collect()]
    assert sorted(r for r in got if r[0] is not None) == sorted((k, *found[k, t or ""]) for k, t in odd_rows if k is not None)
    assert all(r[2] == 0 for r in got if r[0] is None)
    assert suffix_array.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_texts_of_one_id_are_documents_of_their_own(llm, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix_trees, "SHAPE", fill_hot(suffix_trees.SHAPE))
        monkeypatch.setattr(suffix_array, "SHAPE", fill_hot(suffix_array.SHAPE))
    say = lambda name, n: " ".join(f"{name}word{i}" for i in range(n))
    p, q, r = say("p", 60), say("q", 40), say("r", 45)
    docs = [
        (1, p), (1, say("x", 30) + " " + q), (2, q), (2, q), (3, r + " own " + p), (3, r), (3, r + " " + q), (3, None), (4, say("y", 50)),
        (-5, r), (-5, say("z", 25) + " " + r), (None, r), (None, p),
    ]
    words, spans = brute.word_dedup(docs), brute.byte_dedup(docs)
    assert words[2, q][1] == 40 and spans[2, q][1] == len(q)
    for turn in (docs, docs[::-1]):
        table = llm.createDataFrame(turn, "doc_id long, text string").coalesce(1)
        got = sorted(tuple(x) for x in suffix_trees.remove_repeats(table).collect() if x.doc_id is not None)
        assert got == sorted((k, *words[k, t or ""]) for k, t in docs if k is not None)
        got = sorted((*x[:4], bytes(x.kept)) for x in suffix_array.remove_repeats(table).collect() if x.doc_id is not None)
        assert got == sorted((k, *spans[k, t or ""]) for k, t in docs if k is not None)


def test_line_dedup(odd, odd_rows, none):
    index = lines.LineIndex.build(odd)
    got = rows(index.clean(odd, counts=True).select("doc_id", "n_lines", "n_dropped", "text"))
    expected = [(k, n, d, t if n == 0 or d else old) for (k, n, d, t), (_, old) in zip(brute.line_dedup(odd_rows), odd_rows)]
    assert got == sorted(expected, key=str)
    assert index.clean(odd).columns == odd.columns
    assert lines.LineIndex.build(none).clean(none).count() == 0


def test_line_index_is_reversible(llm, odd, odd_rows):
    state = lambda x: (rows(x.references), rows(x.blocked))
    whole = lines.LineIndex.build(odd)
    some = odd.where("doc_id % 2 = 0")
    rest = odd.where("doc_id IS NULL OR doc_id % 2 <> 0")
    grown = lines.LineIndex.build(rest).insert(some)
    assert state(grown) == state(whole)
    shrunk = grown.delete(some)
    assert state(shrunk) == state(lines.LineIndex.build(rest))
    for index, docs in ((grown, odd_rows), (shrunk, [(k, t) for k, t in odd_rows if k is None or k % 2])):
        df = llm.createDataFrame([(k, t) for k, t in docs], "doc_id long, text string")
        got = rows(index.clean(df, counts=True).select("doc_id", "n_dropped"))
        assert got == sorted(((k, d) for k, _, d, _ in brute.line_dedup(docs)), key=str)
        keys = {r.key for r in index.blocked.collect()}
        held = [lines.CuckooFilter.load(bytes(r["filter"])) for r in index.filters.collect()]
        assert all(any(bytes(k) in f for f in held) for k in keys)
    assert state(shrunk.delete(odd)) == ([], [])


def test_same_as_sql(llm):
    from compare import compare, connect

    con = connect(SMALL)
    for name, sql in queries.SQL.items():
        found, n, _ = compare(queries.QUERIES[name](llm, SMALL), con, sql)
        assert not found and n


def test_language_gathers_from_whole_texts(llm):
    """What stands anywhere in a long training document is counted, once, however texts are dealt to parts."""
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(900)) + " zebra") for i in range(20)] + [(None, "zebra " * 50)]
    encode = language.subwords()
    size, begin = encode.size + 2, encode.size
    sequences = [
        [x for word in t.split() for x in encode.many([word])[0].tolist()] + [size - 1] for k, t in docs if not language.held_out(k)
    ]
    counts = np.bincount(np.concatenate(sequences), minlength=size).astype(float)
    counts[begin] += len(sequences)
    row, own = language.ranked_rows(counts)
    for tasks, part_bytes in ((1, 1 << 20), (3, 20_000)):
        df = llm.createDataFrame(docs, "doc_id long, text string").repartition(tasks)
        language_part, language.PART_BYTES = language.PART_BYTES, part_bytes
        try:
            spelled = written(language.spelled_parts(df, language.vocabulary_path(), tasks, 3), "spelled")
        finally:
            language.PART_BYTES = language_part
        parts = [p for _, p in language.Part.rows(spelled.toArrow())]
        assert len(parts) >= (tasks if tasks > 1 else 1) and sum(len(p.ids) for p in parts) == len(docs)
        found = language.gathered(spelled, size, len(parts))
        assert (found.row == row).all()
        near = np.zeros((size, language.OWN_CLASSES))
        pairs = np.zeros((language.ROWS, language.CLASSES))
        for s in sequences:
            for i in range(0, len(s), language.WINDOW):
                window = np.array(s[i : i + language.WINDOW])
                near[np.unique(window)] += 0  # every subword of a window gets the window's frequent ones
                for x in window:
                    near[x] += np.bincount(own[window][own[window] >= 0], minlength=language.OWN_CLASSES)
        klass, inside = language.classes_of(counts, own, near)
        assert (found.klass == klass).all() and np.allclose(found.inside, inside, atol=1e-5)
        for s in sequences:
            np.add.at(pairs, (row[[begin, *s[:-1]]], klass[s]), 1)
        assert np.allclose(found.after, language.following(pairs), atol=1e-4)


def test_packing_keeps_markers(llm):
    from tokenizers import Tokenizer

    text = "one <|endoftext|> two <|startoftext|>"
    ids = np.array(Tokenizer.from_file(packing.vocabulary_path()).encode(text, add_special_tokens=False).ids + [1], "<u4")
    got = packing.packed(llm.createDataFrame([(5, text)], "doc_id long, text string")).collect()
    assert {r.doc_tokens for r in got} == {len(ids)}
    assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got)


@pytest.mark.parametrize("name", ["language", "packing", "lines", "repeats"])
def test_rows_without_id_or_of_one_id_spread(llm, name):
    """No Python task of a group sees all rows without an id, nor, where rows are
    treated separately, all rows of one id."""
    from wardlight.llm import common

    docs = [(None if i % 2 else 5, f"text {i} " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(200)]
    df = llm.createDataFrame(docs, "doc_id long, text string").repartition(4)
    if name == "packing":
        n = df.groupBy("doc_id", common.part_of_row(8).alias("p")).count().groupBy("doc_id").count().collect()
        assert [r["count"] for r in n] == [8, 8]
    made = {
        "language": lambda: language.scored(df), "packing": lambda: packing.packed(df),
        "lines": lambda: lines.LineIndex.build(df).clean(df, counts=True),
        "repeats": lambda: suffix_array.remove_repeats(df),
    }[name]()
    assert made.select("doc_id").where("doc_id IS NULL").count() >= 100
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    if name == "language":  # parts are made where texts lie, and hold rows of any id
        parts = language.spelled_parts(df, language.vocabulary_path(), 4, 1).toArrow()
        assert len({n for n in parts.column("part").to_pylist()}) == 4
    elif name in ("lines", "repeats"):  # by a map, outside the groups
        assert "MapInArrow uncut" in plan or "MapInArrow untouched" in plan
    else:
        assert "xxhash64(doc_id" in plan and "text" in plan.split("xxhash64(doc_id")[1].split("42")[0]


def test_line_index_keeps_columns_of_any_name(llm, odd, odd_rows):
    rows = odd.withColumns({"__part": F.lit("mine"), "c0": F.lit(7), "key2": F.lit(None).cast("int")})
    out = lines.LineIndex.build(rows).clean(rows)
    assert out.columns == rows.columns
    got = sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str)
    assert got == sorted(((k, t) for k, _, _, t in brute.line_dedup(odd_rows)), key=str)
    assert {(r["__part"], r.c0, r.key2) for r in out.collect()} == {("mine", 7, None)}


def test_nearest_with_a_query_id_given_many_times(llm):
    """The query's own rows are its closest ones and take no part."""
    rng = np.random.default_rng(3)
    own = [(0, [5.0 + 0.01 * i, 5.0]) for i in range(40)]
    others = [(i, [float(x) for x in rng.normal(size=2)]) for i in range(1, 90)]
    df = llm.createDataFrame(own + others, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in nearest.top_k(df, 5, 1000).collect()]
    query = min(np.floor(np.array(v) * 64).astype(int).tolist() for _, v in own)
    scores = sorted((-int(np.dot(query, np.floor(np.array(v) * 64).astype(int))), i) for i, v in others)[:5]
    assert sorted(got) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_quality_fits_the_same_rows_in_both_ways(llm):
    docs, labels = (llm.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    good = {r.doc_id for r in quality.scored(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in quality.accepted(docs, labels).collect()} == good

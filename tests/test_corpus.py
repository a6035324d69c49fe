import pytest
from pyspark.sql import functions as F

from wardlight.operators import corpus, fusion, lexical, neighbours
from wardlight.sources.files import read_corpus, read_golden, read_history, write_corpus

THREE = {
    "a.md": "Preamble line\n\n## One\nfirst body\r\n### Two ##\nsecond body\n",
    "b.md": "## Only\n" + "x" * 30,
    "c.md": "## Long\n" + "\n".join(f"line {i} " + "y" * 40 for i in range(52)),
}


@pytest.fixture
def folder(tmp_path):
    for name, text in THREE.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "note.txt").write_text("not a document")
    return str(tmp_path)


def test_read_corpus(spark, folder, tmp_path):
    got = {r["source"]: r for r in read_corpus(spark, folder).collect()}
    assert set(got) == set(THREE) and got["a.md"]["doc_id"] == "a"
    assert got["b.md"]["text"] == THREE["b.md"]
    with pytest.raises(FileNotFoundError):
        read_corpus(spark, folder, "*.rst")
    with pytest.raises(FileNotFoundError):
        read_corpus(spark, str(tmp_path / "missing"))


def test_write_corpus(spark, frame, tmp_path):
    """A folder per task, not one per document; copies of an id share a file, a missing text is an empty line."""
    rows = [(i, f"text {i}\nü") for i in range(300)] + [(7, "again"), (400, None), (401, ""), (None, "no id")]
    docs = frame(rows, "doc_id long, value string").repartition(3, "doc_id")
    for directory in (str(tmp_path / "plain"), f"file://{tmp_path}/with%20space"):
        got = {r["doc_id"]: r["text"] for r in read_corpus(spark, write_corpus(docs, directory), "*.txt").collect()}
        assert len(got) == 303
        assert all(got[f"doc_id={i}"] == f"text {i}\nü\n" for i in range(300) if i != 7)
        assert sorted(got["doc_id=7"].splitlines()) == ["again", "text 7", "ü"]
        assert (got["doc_id=400"], got["doc_id=401"], got["doc_id=None"]) == ("\n", "\n", "no id\n")
    assert sorted(p.name for p in (tmp_path / "plain").iterdir()) == ["part-00000", "part-00001", "part-00002"]


def test_sections(spark, folder):
    docs = read_corpus(spark, folder)
    got = [(r["section"], r["body"]) for r in corpus.split_sections(docs).where("doc_id = 'a'").orderBy("section_no").collect()]
    assert got == [("Introducao", "Preamble line"), ("One", "## One\nfirst body"), ("Two ##", "### Two ##\nsecond body")]
    assert [r["section"] for r in corpus.split_sections(docs).where("doc_id = 'b'").collect()] == ["Only"]


def test_empty_text_has_no_section(frame):
    assert corpus.split_sections(frame([(1, "")], "doc_id int, text string")).count() == 0


def test_blocks_cover_text_and_end():
    text = "".join(f"{w}\n" * 3 + "." * (7 * i % 31) + "\n" for i, w in enumerate(["alpha", "be", "gamma ray", "d"] * 25))
    points = list(corpus.cut_points(text, 170, 35))
    assert points[0][0] == 0 and points[-1][1] == len(text)
    assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(points, points[1:]))
    assert all(b - a <= 170 for a, b in points)
    assert "".join(text[a:b] for (a, _), (b, _) in zip(points, points[1:])) + text[points[-1][0]:] == text
    # a block ends at the last line break of its second half, if it has one
    assert list(corpus.cut_points("aaaaaa\nbbb\ncccccc", 12, 2))[0] == (0, 10)
    assert corpus.blocks_of("z" * 1100) == ["z" * 1100]
    assert [len(b) for b in corpus.blocks_of("z" * 1101)] == [900, 321]
    # an overlap larger than the block still moves on
    assert list(corpus.cut_points("abcdef", 2, 5))[-1][1] == 6


def test_chunks_drop_short_and_number_per_document(spark, folder):
    rows = corpus.chunks(read_corpus(spark, folder)).orderBy("doc_id", "chunk_no").collect()
    assert {r["doc_id"] for r in rows} == {"c"}
    assert [r["chunk_id"] for r in rows][:2] == ["c::000", "c::001"]
    assert all(r["section"] == "Long" for r in rows)


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, rank int")


def test_rrf_ties_and_order(spark):
    near = ranked(spark, [(1, "a", 1), (1, "b", 2)])
    lex = ranked(spark, [(1, "c", 1), (1, "b", 2), (1, "d", 3)])
    got = [r["chunk_id"] for r in fusion.rrf(near, lex, 4).orderBy("rank").collect()]
    assert got == ["b", "a", "c", "d"]  # b is in both; a and c tie, vector first
    assert [r["chunk_id"] for r in fusion.rrf(near, None, 1).collect()] == ["a"]


def test_hydrate_lexical_only_hit(spark):
    near = spark.createDataFrame([(1, "a", 1, 0.12345)], "query_id int, chunk_id string, rank int, distance double")
    lex = ranked(spark, [(1, "b", 1), (1, "gone", 2)])
    chunks = spark.createDataFrame([("a", "ta", "sa", "x"), ("b", "tb", "sb", "y")], "chunk_id string, text string, source string, section string")
    got = {r["chunk_id"]: r for r in fusion.hydrate(fusion.rrf(near, lex, 3), near, chunks).collect()}
    assert got["a"]["distance"] == 0.123 and got["b"]["distance"] == -1.0
    assert got["gone"]["source"] == "desconhecida" and got["gone"]["text"] == ""
    text = fusion.evidence(fusion.hydrate(fusion.rrf(near, lex, 2), near, chunks)).first()["evidence"]
    assert text == "[Fonte: sa | Secao: x]\nta\n\n[Fonte: sb | Secao: y]\ntb"


def test_identifiers_found_by_lexical_search(spark):
    texts = ["technique T1566 phishing mail", "resolution 15 2024 notice", "patch CVE 2025 2183 now", "nothing to see"]
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = spark.createDataFrame([(0, "T1566?"), (1, "15/2024"), (2, "CVE-2025-2183")], "query_id long, text string")
    best = lexical.bm25_search(lexical.bm25_index(docs), asked, 1).where("rank = 1").collect()
    assert {(r["query_id"], r["chunk_id"]) for r in best} == {(0, 0), (1, 1), (2, 2)}


def test_empty_corpus(spark):
    index = lexical.bm25_index(spark.createDataFrame([], "chunk_id long, text string"))
    asked = spark.createDataFrame([(0, "a")], "query_id long, text string")
    assert index.n_chunks == 0 and lexical.bm25_search(index, asked, 3).count() == 0


def test_reindex_is_idempotent(spark, folder, tmp_path):
    docs, path = read_corpus(spark, folder), str(tmp_path / "index")
    n = fusion.reindex(docs, path)
    assert n == fusion.reindex(docs, path) > 0
    assert lexical.load_index(spark, path).n_chunks == n


def test_embeddings_are_unit_and_match_themselves(spark):
    docs = spark.createDataFrame([(0, "alpha beta beta"), (1, "gamma delta"), (2, "alpha gamma")], "chunk_id long, text string")
    model = neighbours.fit_tfidf(docs)
    vectors = neighbours.embed(docs, model=model)
    assert all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-9 for r in vectors.collect())
    near = neighbours.knn(vectors.withColumnRenamed("chunk_id", "query_id"), vectors, 1).collect()
    assert all(r["query_id"] == r["chunk_id"] for r in near)

    @F.pandas_udf("array<double>")
    def lengths(s):
        return s.map(lambda x: [float(len(x)), 1.0])

    prefixed = neighbours.embed(docs, lengths, "query: ").first()["vector"]
    assert abs(prefixed[0] / prefixed[1] - len("query: alpha beta beta")) < 1e-9


def test_read_golden_and_history(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"descricao": "x", "casos": [{"id": "a", "pergunta": "p?", "doc": "d.md"},\n {"id": "b", "fatos": ["f"]}]}')
    got = {r["id"]: r for r in read_golden(spark, str(tmp_path / "g.json")).collect()}
    assert got["a"]["doc"] == "d.md" and got["b"]["fatos"] == ["f"]
    assert read_history(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    assert read_history(spark, str(tmp_path / "bad")).count() == 0

from pyspark.sql import functions as F

from wardlight.functions.text import (
    asks_ratio,
    comparable,
    fold,
    in_domain,
    prediction_intent,
    strip_reasoning,
    tokens,
)


def one(frame, value, expr):
    return frame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_fold(frame):
    assert one(frame, "Força BRUTA Exfiltração Crítica", fold) == "forca bruta exfiltracao critica"
    assert one(frame, "proporção", fold) == "proporcao"


def test_comparable(frame):
    cells = {"5": "5.0", " 2.345 ": "2.35", "ABC ": "abc", "1e3": "1000.0", None: "none", "1.0f": "1.0f"}
    for value, expected in cells.items():
        assert one(frame, value, comparable) == expected


def test_strip_reasoning(frame):
    assert one(frame, "<think>a\nb</think>\n ok </think> x ", strip_reasoning) == "ok </think> x"
    assert one(frame, "  plain\n", strip_reasoning) == "plain"


def test_ratio_terms_with_accents(frame):
    assert one(frame, "Qual a proporção?", asks_ratio)
    assert one(frame, "TAXA de erro", asks_ratio)
    assert not one(frame, "taxação", asks_ratio)


def test_prediction_intent(frame):
    asked = [
        "Previsão de falsos positivos para a fila da noite",
        "falso positivo: há RISCO de ser isso neste lote?",
        "quais eventos poderiam\nvirar falsos positivos",
        "entre os falsos positivos, quais pesam mais",
        "tendência de falso positivo por turno",
    ]
    facts = ["falsos positivos por turno", "mostre o lote 7", "risco do lote 7", "previsão do tempo"]
    assert all(one(frame, q, prediction_intent) for q in asked)
    assert not any(one(frame, q, prediction_intent) for q in facts)


def test_domain(frame):
    assert one(frame, "um patch para o servidor do lote 7", in_domain)
    assert one(frame, "AMEAÇA vista ontem", in_domain)
    assert one(frame, "a tática muda por turno", in_domain)
    assert not one(frame, "previsão do tempo para amanhã", in_domain)


def test_tokens_split_at_accents(frame):
    assert one(frame, "Ação T1566 e 15/2024", tokens) == ["a", "o", "t1566", "e", "15", "2024"]


def test_fold_over_all_of_unicode(spark):
    """Every assigned letter and mark: canonical decomposition without combining marks."""
    import unicodedata

    def bare(text):
        return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))

    letters = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM" and not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c} " for c in letters[i : i + 500]) for i in range(0, len(letters), 500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low"), fold(F.col("t")).alias("folded"))
    found = df.collect()
    assert len(letters) > 130_000
    assert [r["folded"] for r in found] == [bare(r["low"]) for r in found]
    row = spark.createDataFrame([("Ação 한글 がぎ Крёй آب क़लम Ängström Ǘ",)], "t string").select(fold(F.col("t"))).first()
    assert row[0] == bare("Ação 한글 がぎ Крёй آب क़लम Ängström Ǘ".lower())


def test_folding_of_single_texts():
    from wardlight.functions.text import SEVERAL, bare

    import unicodedata

    many = "".join(chr(0xAC00 + 7 * i) for i in range(3 * SEVERAL)) + "\u0301a\u0327\u0301"  # marks out of order
    for text in ("", "plain", "\u00e9\u00e9 \u01d8 e\u0301", many):
        assert bare(text) == "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def test_tokens_in_tasks_equal_the_expression(spark):
    from wardlight.functions.text import token_list

    texts = ["", "A\u00e7\u00e3o T1566", "\u0130stanbul \u212a9 \u03a3\u03a3 x\u00df\u00b2", "a\x00b\tc\u00a0d", "\ud55c1\uae00Z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("k")).collect()
    assert all(token_list(r["t"]) == r["k"] for r in rows) and token_list(texts[2])[:4] == ["i", "stanbul", "k9", "x"]


def _python_steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("EvalPython")


def test_text_steps_run_once_in_python(spark):
    """Texts are folded, counted and cut in one pass of a task, which no filter repeats."""
    from wardlight.operators import corpus, lexical, neighbours

    docs = spark.createDataFrame([(1, "s", "One \u00e9 text"), (2, "s", None), (3, "s", "")], "doc_id long, source string, text string")
    given = docs.where("text IS NOT NULL")
    for vectors in (neighbours.embed(docs, neighbours.letter_profile), neighbours.embed(given, model=neighbours.fit_tfidf(given))):
        assert _python_steps(vectors.select(F.posexplode("vector").alias("p", "x")).where("x <> 0")) == 1
    assert _python_steps(corpus.chunks(docs)) == 1
    assert _python_steps(docs.select(fold(F.col("text")))) == 1
    counted = lexical.bm25_index(docs.withColumnRenamed("doc_id", "chunk_id"))
    assert counted.n_chunks == 3 and counted.postings.count() == 2


def test_letters_of_null_and_empty_texts(spark):
    from wardlight.operators.neighbours import embed, letter_profile

    docs = spark.createDataFrame([(1, "aB\u212aB"), (2, None), (3, "")], "i int, text string")
    got = {r["i"]: r["vector"] for r in embed(docs, letter_profile).collect()}
    assert got[1][:2] == [1 / 6**0.5, 2 / 6**0.5] and abs(got[1][10] - 1 / 6**0.5) < 1e-12
    assert got[2] == [None] * 26 and got[3] == [0.0] * 26

import pytest

from wardlight.llm.common import prepared
from wardlight.plans.session import local_session  # noqa: F401  (the session comes from the parent folder)

SMALL = "/root/testdata/sf0.001"
#: extra columns with names that the operators use themselves
EXTRA = "lang string, source string, n_chars long, part int, bucket int, key string, words int, score double, h binary, component long"


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def odd_rows(llm):
    """Real documents with copies, then nulls, empty and very long texts, ties and
    repeated rows."""
    real = [(r.doc_id, r.text) for r in llm.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    passage = " ".join(f"Shared{i}" for i in range(40))
    line = "A line of the kind that many documents repeat, word for word"
    return real + [
        (1000, None), (1001, ""), (1002, " \t\n "), (1003, "one"), (1004, "One"), (1005, real[3][1]), (1006, real[3][1] + " end"),
        (1007, passage), (1008, "before " + passage + " after"), (1009, "x " + passage.replace("Shared20", "Other") + " y"),
        *[(1010 + i, f"{line}\n own words {i}\n\t {line.upper()} \n" + "tail " * i) for i in range(7)],
        (1020, "ab " * 30_000), (1021, "z" * 50_000), (1022, "é" * 300 + " " + "日本語 " * 60), (1023, "日本語 " * 60),
        (1024, "  \x00 \x1c a b c d e"), (1025, "aB cD eF gH iJ"), (1026, "ab cd ef gh ij"),
        (1030, real[5][1]), (1030, real[5][1]), (None, real[7][1]), (None, None), (None, line),
    ]


@pytest.fixture(scope="session")
def odd(llm, odd_rows):
    rows = [(k, t, None, "s", len(t or ""), 1, None, "k", 2, 0.5, b"x", 3) for k, t in odd_rows]
    return llm.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(5).cache()


@pytest.fixture(scope="session")
def none(llm):
    return llm.createDataFrame([], f"doc_id long, text string, {EXTRA}")

"""The pipeline's stages, one after the other, against plain versions."""

import pytest

import corpus_pipeline as pipeline
from tests.llm import brute
from tests.llm.conftest import SMALL
from wardlight.llm import decontaminate, packing, quality
from wardlight.llm.common import written


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, llm, odd):
    folder = str(tmp_path_factory.mktemp("sf"))
    odd.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        llm.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(llm, odd, sf_dir):
    docs = odd
    after = {}
    for name, stage in pipeline.STAGES[:-1]:
        before = pairs(docs)
        docs = written(stage(llm, docs, sf_dir), "stage")
        assert docs.columns == odd.columns
        after[name] = (before, pairs(docs), docs)
    before, got, _ = after["quality classifier"]
    labels = llm.read.parquet(f"{SMALL}/labels.parquet")
    good = [r.doc_id for r in quality.scored(odd, labels).collect() if r.predicted]
    assert [k for k, _ in got] == sorted(good, key=str)
    before, got, out = after["line dedup"]
    expected = [(k, t if n else old) for (k, _, n, t), (_, old) in zip(brute.line_dedup(before), before)]
    assert got == sorted(expected, key=str)
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    before, got, _ = after["n-gram Jaccard join"]
    classes = brute.link_classes(before)
    assert got == [(k, t) for k, t in before if k is None or classes[k][1] == k]
    before, got, docs = after["benchmark decontamination"]
    bench = llm.read.parquet(f"{SMALL}/benchmark.parquet")
    held = decontaminate.Segments.of([(r.item_id, r.text) for r in bench.collect()])
    assert set(got) <= set(before)
    gone = {k for k, _ in set(before) - set(got)}
    found = {k for k, t in before if t and len(decontaminate.leaks(held, *_buffer(t))[0])}
    assert gone == {k for k in found if k is not None} | ({None} & gone)
    items = [r.text for r in bench.collect()]
    assert not any(t and x in t for _, t in got for x in items)
    pieces = pipeline.STAGES[-1][1](llm, docs, sf_dir).toPandas()
    assert set(pieces.doc_id.dropna()) == {k for k, _ in got if k is not None}
    assert pieces.groupby("sequence_id").length.sum().max() <= packing.WINDOW


def test_registered_once_per_operator():
    from __spark_entry__ import oracle_sql, queries

    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in queries() and len(pipeline.STAGES) == 5
    assert {"op5_voronoi_topk", "op9_line_dedup"} <= set(oracle_sql())


def _buffer(text):
    import pyarrow as pa

    from wardlight.llm.common import text_buffer

    return text_buffer(pa.array([text], pa.string()))


def test_run_and_empty_table(llm, odd, sf_dir, tmp_path):
    assert pipeline.run(llm, sf_dir).count() > 0
    folder = str(tmp_path / "empty")
    odd.limit(0).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        llm.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert pipeline.run(llm, folder).count() == 0

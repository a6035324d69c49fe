"""Document folders, golden sets and the run history."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.plans.session import mounted

GOLDEN_CASE = (
    "id string, pergunta string, tipo string, doc string, ferramentas_esperadas array<string>, "
    "doc_esperado string, fatos array<string>, sql_referencia string, fatos_template array<string>"
)
HISTORY = (
    "ran_at timestamp, runs int, cases long, coverage double, routing double, "
    "hallucination double, grade double, latency double, faithfulness double, "
    "relevance double, sql_correct double"
)


def read_corpus(spark: SparkSession, directory: str, pattern: str = "*.md") -> DataFrame:
    """One row per document file right in the folder, or in the folders a pattern in
    ``directory`` names: doc_id (name without suffix), source (file name), path, text (UTF-8, not unpacked).
    No matching file is an error."""
    try:
        # a file's bytes cost a third of what the text reader takes to set up for each file
        docs = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    except AnalysisException as exc:
        raise FileNotFoundError(f"no {pattern} under {directory}") from exc
    if docs.isEmpty():
        raise FileNotFoundError(f"no {pattern} under {directory}")
    name = F.col("_metadata.file_name")
    return docs.select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"),
        name.alias("source"),
        F.col("_metadata.file_path").alias("path"),
        F.col("content").cast("string").alias("text"),
    )


def write_corpus(docs: DataFrame, directory: str) -> str:
    """The texts of ``doc_id, value`` as files whose path holds ``doc_id=<id>``, each text with a line end; a task's
    rows of one id share a file. Returns the folders, as a pattern for :func:`read_corpus`.

    On a file system that the executors mount, a task writes its files into one folder and names it at its end, so
    no folder is made, moved or listed per document. On other stores Spark writes a folder for each."""
    base = mounted(docs.sparkSession, directory)
    if base is None:
        docs.write.partitionBy("doc_id").text(directory)
        return f"{directory}/doc_id=*"

    def put(batches):
        task, last, out = TaskContext.get(), None, None
        made = f"{base}/_{task.partitionId()}-{task.taskAttemptId()}"
        os.makedirs(made)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None or doc != last:
                    if out:
                        out.close()
                    last, out = doc, open(f"{made}/doc_id={doc}.txt", "wb")
                out.write((text or b"") + b"\n")
        if out:
            out.close()
        try:
            os.rename(made, f"{base}/part-{task.partitionId():05d}")
        except OSError:
            if not os.path.isdir(f"{base}/part-{task.partitionId():05d}"):  # an earlier attempt has written the same
                raise
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32())], ["part"])

    rows = docs.select("doc_id", F.col("value").cast("binary").alias("value")).sortWithinPartitions("doc_id")
    rows.mapInArrow(put, "part int").count()
    return f"{directory}/part-*"


def read_golden(spark: SparkSession, path: str, one_object: bool = True) -> DataFrame:
    """Cases of golden sets, each an object with an array ``casos``: one object
    per file, or per line when ``one_object`` is off."""
    sets = spark.read.schema(f"casos array<struct<{_fields(GOLDEN_CASE)}>>").json(
        path, multiLine=one_object
    )
    return sets.select(F.explode("casos").alias("c")).select("c.*")


def _fields(ddl: str) -> str:
    return ", ".join(":".join(part.split(" ", 1)) for part in ddl.split(", "))


def append_history(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str, schema: str = HISTORY) -> DataFrame:
    """The run history; a missing or unreadable one counts as empty."""
    try:
        history = spark.read.schema(schema).parquet(path)
        history.limit(1).collect()
        return history
    except Exception:  # whatever the reader raises: no history yet
        return spark.createDataFrame([], schema)

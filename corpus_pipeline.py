"""Corpus pipeline over ``documents``: quality, lines, near duplicates, benchmark, packing.

Each stage takes all its predecessor kept, as written, and its decisions take effect.
All but the last return the columns of ``documents``, whatever other columns there are and however they
are named. Null texts count as empty ones. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import decontaminate, jaccard, lines, packing, quality
from wardlight.llm.common import prepared, read, written


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject. Each row is judged by its own text, rows without an
    id and rows of one id too; empty and null texts have a score like any others."""
    prepared(spark)
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; ``n_chars`` follows the text. A
    document of repeated lines only stays, with an empty text. Rows of one id are one document for the
    counts; rows without an id are not counted and lose no lines; a null text stays null."""
    prepared(spark)
    out = lines.LineIndex.build(docs).clean(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the smallest id. Empty and null texts are linked with
    nothing and stay; rows of one id stay or go together; rows without an id stay."""
    prepared(spark)
    found = jaccard.link_classes(docs)
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items. Each row is judged by its own text, also without an id;
    empty and null texts hold no passage and stay."""
    prepared(spark)
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens. Each row is packed by itself, rows of one id and
    rows without one too; an empty or null text is its end id."""
    prepared(spark)
    return packing.packed(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs

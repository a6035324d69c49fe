"""Ad-hoc read-only SQL, result comparison and facts drawn from results."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions.text import comparable
from wardlight.operators.audit import OK, clean_statement, read_only_verdict


class BlockedSQLError(ValueError):
    """The statement is not a single read-only SELECT."""


def check_select(spark: SparkSession, sql: str) -> str:
    """The cleaned statement, or an error naming the rule it breaks."""
    row = spark.range(1).select(
        clean_statement(F.lit(sql)).alias("text"), read_only_verdict(F.lit(sql)).alias("verdict")
    ).first()
    if row["verdict"] != OK:
        raise BlockedSQLError(row["verdict"])
    return row["text"]


def run_select(
    spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: int | None = None
) -> DataFrame:
    """Run one SELECT/WITH over the given tables; all rows unless ``max_rows`` is given.

    Besides the words checked in the text, file paths as tables are switched off for
    the call, and every relation of the analysed plan must be one of ``tables`` or a name
    the statement defines itself. The session's own views are left as they were.
    """
    text = check_select(spark, sql)
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        with _as_views(spark, tables):
            found = spark.sql(text)
            found.schema  # analysed while files are off and the tables are there
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", before)
    given = {name.lower() for name in tables}
    if unknown := sorted(_other_relations(found._jdf.queryExecution().analyzed(), given)):
        raise BlockedSQLError(f"unknown table {unknown[0]}")
    return found if max_rows is None else found.limit(max_rows)


@contextlib.contextmanager
def _as_views(spark: SparkSession, tables: dict[str, DataFrame]):
    """The tables as session views while a statement is analysed; views of the caller with
    the same names are there again afterwards, other names are gone."""
    held = spark._jsparkSession.sessionState().catalog()
    own = {name: spark.table(name) for name in tables if held.getTempView(name).isDefined()}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        yield
    finally:
        for name in tables:
            if name in own:
                own[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


# leaves of a plan that read no table
NO_TABLE = {"OneRowRelation", "LocalRelation", "CTERelationRef", "Range"}


def _other_relations(plan, given: set[str]) -> set[str]:
    """Names of what an analysed plan reads besides the given views, subqueries included."""
    kind = plan.getClass().getSimpleName()
    if kind == "View" and plan.isTempView() and plan.desc().identifier().table().lower() in given:
        return set()
    below = [seq.apply(i) for seq in (plan.children(), plan.subqueries()) for i in range(seq.size())]
    if not below and kind not in NO_TABLE:
        return {plan.simpleString(1).lower()}
    found = set().union(*(_other_relations(p, given) for p in below))
    if kind == "View" and found:
        return {plan.desc().identifier().table().lower()}
    return found


def cells(df: DataFrame) -> DataFrame:
    """Each row as one list of comparable cells, in column order."""
    return df.select(F.array(*[comparable(F.col(f"`{c}`")) for c in df.columns]).alias("cells"))


def same_result(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row telling whether two results hold the same rows the same number
    of times, whatever the column names and row order. Rows of one side count
    up, of the other down; repeats fold map-side."""
    signed = cells(a).withColumn("sign", F.lit(1)).unionByName(
        cells(b).withColumn("sign", F.lit(-1))
    )
    return (
        signed.groupBy("cells")
        .agg(F.sum("sign").alias("balance"))
        .agg(
            F.coalesce(F.sum(F.abs("balance")), F.lit(0)).alias("rows_apart"),
        )
        .select((F.col("rows_apart") == 0).alias("same"), "rows_apart")
    )


def derive_facts(templates: DataFrame, values: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """Facts of each case: templates (case_id, template) with ``{name}`` filled
    from values (case_id, name, value), plus the fixed facts (case_id, fact).

    A template naming an unknown value stays as it is. A case has one value per
    column of its result, so its map is short.
    """
    known = (
        values.groupBy("case_id", "name")
        .agg(F.min("value").alias("value"))
        .groupBy("case_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("known"))
    )
    names = F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), 1)
    filled = F.aggregate(
        F.array_distinct(names),
        F.col("template"),
        lambda text, name: F.replace(
            text, F.concat(F.lit("{"), name, F.lit("}")), F.element_at("known", name)
        ),
    )
    complete = F.forall(names, lambda n: F.map_contains_key("known", n))
    facts = templates.join(known, "case_id", "left").select(
        "case_id", F.when(complete, filled).otherwise(F.col("template")).alias("fact")
    )
    return facts if fixed is None else facts.unionByName(fixed.select("case_id", "fact"))

"""Audit of logged questions, generated SQL and model texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from wardlight.functions.text import asks_ratio, in_domain, prediction_intent, strip
from wardlight.operators.canon import (
    dictionary_beside,
    one_edit_away,
    same_ignoring_case,
    scope_dictionary,
    value_lists,
)

# fixed values: words that mark writing or resource access, anywhere in the text
FORBIDDEN = (
    r"(?iU)\b(insert|update|delete|drop|alter|create|replace|copy|export|import|attach|detach|"
    r"pragma|call|set|prepare|execute|read_csv|read_parquet|glob)\b"
)
# Spark's own ways out of a query: files as tables, reflection, scripts, table functions over files
OUTSIDE = (
    r"(?iU)\b(reflect|try_reflect|java_method|transform\s*\([^)]*\)\s*using|read_files|cloud_files|"
    r"(parquet|csv|json|orc|text|binaryfile|avro|xml|delta|jdbc)\s*\.\s*`)|`\s*[a-z0-9+]*:?/"
)
READS = r"(?iU)^(select|with)\b"
# fixed values: table with optional alias after FROM/JOIN, and words that are no alias
SOURCE = r"(?iU)\b(?:FROM|JOIN)\s+([a-zA-Z_]\w*)(?:\s+(?:AS\s+)?([a-zA-Z_]\w*))?"
NOT_ALIAS = (
    "ON USING WHERE GROUP ORDER LIMIT INNER LEFT RIGHT FULL CROSS NATURAL SET VALUES"
).split()
# fixed values: a column compared with a text literal
EQUALS_TEXT = r"(?iU)((?:\w+\.)?)(\w+)\s*=\s*'([^']*)'"

OK, NOT_SELECT, SEVERAL, BLOCKED = "ok", "not_select", "several_statements", "blocked_word"


def clean_statement(sql: Column) -> Column:
    """Trimmed statement without its closing semicolons."""
    return strip(F.regexp_replace(strip(sql), r";+$", ""))


def read_only_verdict(sql: Column) -> Column:
    text = clean_statement(sql)
    return (
        F.when(~text.rlike(READS), NOT_SELECT)
        .when(text.contains(";"), SEVERAL)
        .when(text.rlike(FORBIDDEN) | text.rlike(OUTSIDE), BLOCKED)
        .otherwise(OK)
    )


def audit_read_only(df: DataFrame, sql: str = "sql_text") -> DataFrame:
    return df.withColumn("verdict", read_only_verdict(F.col(sql)))


def verdict_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("verdict").agg(F.count("*").alias("n"))


def lint_ratio(df: DataFrame) -> DataFrame:
    """The question asks for a rate and the SQL divides nothing."""
    return df.withColumn(
        "no_division", asks_ratio(F.col("question")) & ~F.col("sql_text").contains("/")
    )


# fixed values: the condition of a CASE, and a division by all rows
CASE_CONDITION = r"(?i)CASE WHEN ([^)]+)"
BY_ALL_ROWS = "/COUNT(*)"


def lint_denominator(df: DataFrame) -> DataFrame:
    """Divides by a bare COUNT(*) while the CASE condition narrows the group."""
    squeezed = F.regexp_replace(F.upper("sql_text"), r"(?U)\s+", "")
    condition = F.regexp_extract("sql_text", CASE_CONDITION, 1)
    return df.withColumn(
        "wide_denominator",
        squeezed.contains(BY_ALL_ROWS) & F.upper(condition).contains(" AND "),
    )


def _sources(sql: Column) -> Column:
    """Names a column may be qualified with, in order, with their table."""

    def names(pair):
        own = F.named_struct(F.lit("name"), pair["table"], F.lit("table"), pair["table"])
        alias = F.named_struct(F.lit("name"), pair["alias"], F.lit("table"), pair["table"])
        usable = (pair["alias"] != "") & ~F.upper(pair["alias"]).isin(*NOT_ALIAS)
        return F.when(usable, F.array(alias, own)).otherwise(F.array(own))

    pairs = F.arrays_zip(
        F.regexp_extract_all(sql, F.lit(SOURCE), 1).alias("table"),
        F.regexp_extract_all(sql, F.lit(SOURCE), 2).alias("alias"),
    )
    return F.flatten(F.transform(pairs, names))


def literal_findings(df: DataFrame, enums: DataFrame) -> DataFrame:
    """Text literals compared with enumerated columns: wrong case (``case``) or
    one edit away from an allowed value of the known table (``near``).

    Aliases are resolved inside the row of each statement; only the dictionary
    is joined.
    """
    # the statement is searched once; a comparison found is taken apart by itself
    compared = F.regexp_extract_all("sql_text", F.lit(EQUALS_TEXT), 0)
    part = lambda i, name: F.regexp_extract("found", EQUALS_TEXT, i).alias(name)
    used = (
        df.where(F.col("sql_text").contains("'"))
        .select("query_id", _sources(F.col("sql_text")).alias("names"), F.posexplode(compared).alias("pos", "found"))
        .select("query_id", "pos", "names", part(1, "prefix"), part(2, "column"), part(3, "literal"))
        .withColumn("qualifier", F.regexp_replace("prefix", r"\.$", ""))
        .withColumn(
            "_name", F.when(F.col("qualifier") != "", F.col("qualifier")).otherwise(F.col("column"))
        )
        .withColumn(
            "table",
            F.try_element_at(
                F.filter("names", lambda n: n["name"] == F.col("_name")), F.lit(-1)
            )["table"],
        )
        .drop("names", "prefix", "_name")
    )
    used = dictionary_beside(used, value_lists(enums), ["table", "column"], "own")
    used = dictionary_beside(
        used, scope_dictionary(enums).select("column", "allowed"), ["column"], "any"
    )
    literal, low = F.col("literal"), F.col("_low")
    # lower case of a literal, which may be a long text, is made once for all values
    return (
        used.withColumn("_low", F.lower("literal"))
        .withColumn("_same", same_ignoring_case(F.coalesce("own", "any"), low))
        .withColumn("_fixed", F.when(F.col("_same") != literal, F.col("_same")))
        .withColumn("_near", F.when(F.col("_same").isNull(), one_edit_away(F.col("own"), low)))
        .withColumn(
            "finding",
            F.when(F.col("_fixed").isNotNull(), "case").when(F.col("_near").isNotNull(), "near"),
        )
        .where(F.col("finding").isNotNull())
        .select(
            "query_id", "pos", "table", "column", "literal", "finding",
            F.coalesce("_fixed", "_near").alias("suggestion"),
        )
    )


def extract_json(df: DataFrame, schema: StructType, text: str = "text") -> DataFrame:
    """JSON object from the first ``{`` to the last ``}``; ``has_json`` tells
    whether there is one that parses, ``parsed`` is null otherwise."""
    broken = "_broken"
    full = StructType(schema.fields).add(broken, StringType())
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}
    parsed = F.from_json(F.when(found != "", found), full, options)
    return (
        df.withColumn("_parsed", parsed)
        .withColumn("has_json", F.col("_parsed").isNotNull() & F.col(f"_parsed.{broken}").isNull())
        .withColumn(
            "parsed",
            F.when(
                F.col("has_json"),
                F.struct(*[F.col(f"_parsed.{f.name}").alias(f.name) for f in schema.fields]),
            ),
        )
        .drop("_parsed")
    )


def reroute(df: DataFrame) -> DataFrame:
    """A question of the security domain never keeps the route ``direto``."""
    question = F.col("question")
    guarded = (F.col("route") == "direto") & in_domain(question)
    return df.withColumn(
        "final_route",
        F.when(guarded & prediction_intent(question), "ml")
        .when(guarded, "rag")
        .otherwise(F.col("route")),
    )


def retry_summary(attempts: DataFrame, tries: int = 3) -> DataFrame:
    """Per query over its numbered attempts (query_id, attempt, ok, reason):
    the attempt that worked, whether it was a self-correction, whether all
    tries failed, the reasons in order, and the number of logged attempts, those
    after success and beyond ``tries`` included. The verdict looks at the first
    ``tries`` only, so each query folds into ``tries`` slots."""
    slots = [F.max(F.when((F.col("attempt") == i) & ~F.col("ok"), F.col("reason"))).alias(f"_r{i}")
             for i in range(1, tries + 1)]
    inside = F.col("attempt").between(1, tries)
    per_query = attempts.groupBy("query_id").agg(
        F.count("*").alias("logged"),
        F.min(F.when(inside & F.col("ok"), F.col("attempt"))).alias("solved_at"),
        F.max(F.when(inside, F.col("attempt"))).alias("_last"),
        *slots,
    )
    used = F.coalesce(F.col("solved_at"), F.col("_last"))
    reasons = F.array_compact(
        F.array(*[F.when(F.lit(i) <= used, F.col(f"_r{i}")) for i in range(1, tries + 1)])
    )
    return per_query.select(
        "query_id",
        used.alias("attempts"),
        "solved_at",
        F.coalesce(F.col("solved_at") > 1, F.lit(False)).alias("self_corrected"),
        (F.col("solved_at").isNull() & (F.coalesce("_last", F.lit(0)) >= tries)).alias("failed"),
        F.array_join(reasons, "; ").alias("reasons"),
        "logged",
    )

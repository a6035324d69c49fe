"""Analytics over execution traces.

A trace is stored as an ordered list of events. ``trace_events`` lays the lists
out as one row per event; everything else aggregates those rows by answer, so
an answer of any length folds map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: event fields as stored in the JSON text, and our column names
STORED_FIELDS = {
    "tipo": ("kind", "string"),
    "etapa": ("stage", "string"),
    "segundos": ("seconds", "double"),
    "sql": ("sql", "string"),
    "linhas": ("n_rows", "bigint"),
    "consulta": ("query", "string"),
    "fontes": ("sources", "array<string>"),
    "filtro": ("filter", "string"),
    "incidentes": ("n_incidents", "bigint"),
    "prob_media": ("mean_prob", "double"),
    "reescrita": ("rewrite", "string"),
    "papel": ("role", "string"),
    "acao": ("action", "string"),
    "detalhe": ("detail", "string"),
    "decisao": ("decision", "string"),
}
TRACE_DDL = "array<struct<" + ",".join(f"{k}:{t}" for k, (_, t) in STORED_FIELDS.items()) + ">>"
# fixed values: event kinds in display order
KINDS = ["tempo", "sql", "rag", "ml", "contexto", "agente", "retry", "erro", "direto"]
HIDDEN = "request"
TOOLS = ["sql", "rag"]


def parse_trace(text):
    """Events of a JSON trace; text that does not parse counts as no events."""
    return F.coalesce(
        F.filter(F.from_json(text, TRACE_DDL), lambda e: e["tipo"].isNotNull()),
        F.from_json(F.lit("[]"), TRACE_DDL),
    )


def trace_events(df: DataFrame, answer_id: str, trace: str) -> DataFrame:
    """One row per event: answer_id, pos and the event fields."""
    return df.select(
        F.col(answer_id).alias("answer_id"),
        F.posexplode(parse_trace(F.col(trace))).alias("pos", "event"),
    ).select(
        "answer_id",
        F.col("pos").cast("long").alias("pos"),
        *[F.col(f"event.{k}").alias(name) for k, (name, _) in STORED_FIELDS.items()],
    )


def _complete(events: DataFrame) -> DataFrame:
    for name, kind in STORED_FIELDS.values():
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    return events


def tools_used(events: DataFrame) -> DataFrame:
    used = [F.max(F.when(F.col("kind") == t, t)) for t in TOOLS]
    return events.groupBy("answer_id").agg(F.array_compact(F.array(*used)).alias("used"))


def routing_ok(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Did the answer use every expected tool? ``expected`` has one row per
    answer with an array ``tools``; only retrieval and SQL count as tools."""
    return (
        expected.join(tools_used(events), "answer_id", "left")
        .withColumn("used", F.coalesce("used", F.array().cast("array<string>")))
        .withColumn("routing_ok", F.size(F.array_except("tools", "used")) == 0)
    )


def cited(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Did any retrieval event name the expected document among its sources?
    ``expected`` has one row (answer_id, doc) per answer."""
    hit = (
        events.where(F.col("kind") == "rag")
        .join(expected, "answer_id")
        .groupBy("answer_id")
        .agg(
            F.bool_or(
                F.coalesce(F.exists("sources", lambda s: s.contains(F.col("doc"))), F.lit(False))
            ).alias("_cited")
        )
    )
    return expected.join(hit, "answer_id", "left").select(
        "answer_id", "doc", F.coalesce("_cited", F.lit(False)).alias("cited")
    )


def stage_timings(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind") == "tempo").groupBy("stage").agg(
        F.count("*").alias("n"),
        F.round(F.avg("seconds"), 3).alias("mean_s"),
        F.max("seconds").alias("max_s"),
    )


def answer_seconds(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind") == "tempo").groupBy("answer_id").agg(
        F.round(F.sum("seconds"), 3).alias("total_s")
    )


def event_table(events: DataFrame) -> DataFrame:
    """One readable line per event; request events are hidden and unknown kinds
    list the fields they carry."""
    e = _complete(events)
    kind = F.col("kind")

    def text(name, n):
        return F.substring(F.coalesce(F.col(name), F.lit("")), 1, n)

    def number(name):
        return F.coalesce(F.col(name), F.lit(0)).cast("string")

    other = F.concat_ws(
        " · ",
        *[
            F.when(
                F.col(name).isNotNull(),
                F.concat(F.lit(f"{name}="), F.substring(F.col(name).cast("string"), 1, 40)),
            )
            for name, _ in STORED_FIELDS.values()
            if name != "kind"
        ],
    )
    mean = F.when(
        F.col("mean_prob").isNotNull(),
        F.concat(F.round("mean_prob", 0).cast("long").cast("string"), F.lit("%")),
    ).otherwise("—")
    line = (
        F.when(
            kind == "tempo",
            F.concat(
                F.coalesce("stage", F.lit("etapa")), F.lit(" · "),
                F.round(F.coalesce("seconds", F.lit(0.0)), 1).cast("string"), F.lit("s"),
            ),
        )
        .when(kind == "sql", F.concat(text("sql", 130), F.lit(" · "), number("n_rows"), F.lit(" linha(s)")))
        .when(
            kind == "rag",
            F.concat(
                F.lit("consulta: "), text("query", 60), F.lit(" · "),
                F.coalesce(F.array_size("sources"), F.lit(0)).cast("string"), F.lit(" trechos"),
            ),
        )
        .when(
            kind == "ml",
            F.concat(
                F.lit("filtro: "), text("filter", 60), F.lit(" · "), number("n_incidents"),
                F.lit(" incidentes · FP médio "), mean,
            ),
        )
        .when(
            kind.isin("contexto", "ctx"),
            F.concat(F.lit("seguimento reformulado → "), text("rewrite", 90)),
        )
        .when(
            kind == "agente",
            F.concat(F.upper(F.coalesce("role", F.lit("agente"))), F.lit(" · "), text("action", 90)),
        )
        .when(kind.isin("retry", "erro"), text("detail", 120))
        .when(kind == "direto", text("decision", 90))
        .otherwise(other)
    )
    return e.where(kind != HIDDEN).select("answer_id", "pos", "kind", line.alias("line"))


def kinds_per_answer(events: DataFrame) -> DataFrame:
    """Number of events of each known kind per answer."""
    return events.groupBy("answer_id").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    )


def first_sql(events: DataFrame) -> DataFrame:
    return (
        events.where((F.col("kind") == "sql") & (F.coalesce("sql", F.lit("")) != ""))
        .groupBy("answer_id")
        .agg(F.min_by(F.struct("sql", "n_rows"), "pos").alias("_first"))
        .select("answer_id", "_first.sql", "_first.n_rows")
    )


def roles(events: DataFrame) -> DataFrame:
    """Roles of an answer in order of first appearance; repeats are folded
    before the few roles are joined."""
    return (
        events.where((F.col("kind") == "agente") & F.col("role").isNotNull())
        .groupBy("answer_id", "role")
        .agg(F.min("pos").alias("at"))
        .groupBy("answer_id")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("at", "role"))), lambda r: r["role"]),
                "+",
            ).alias("roles")
        )
    )

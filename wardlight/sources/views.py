"""Security views over the raw tables.

``Tables(spark, dir)`` reads the Parquet tables lazily and offers the engine's
own tables (assets, incidents, vulnerabilities, call journal, messages, trace
events, evaluation verdicts, query log) as DataFrames derived from them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.plans.sizing import spread

RAW = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# fixed values: incident kinds by id modulo 8, with their ATT&CK technique
KINDS = [
    ("Phishing", "T1566"),
    ("Brute Force", "T1110"),
    ("Malware", "T1204"),
    ("DDoS", "T1498"),
    ("Data Exfiltration", "T1041"),
    ("Anomalous Access", "T1078"),
    ("Exploited Vulnerability", "T1190"),
    ("Social Engineering", "T1598"),
]

SAID_FROM = 1_000_000_000_000  # query ids of conversation turns start here

# (template id, question, SQL or model text, route) of the logged requests
LOGGED_REQUESTS = [
    (0, "how many incidents", "SELECT COUNT(*) FROM incident;", "consultar"),
    (1, "erase all", "DELETE FROM incident", "consultar"),
    (2, "two at once", "SELECT 1; DROP TABLE asset", "consultar"),
    (3, "copy it", "WITH x AS (SELECT 1) SELECT * FROM read_csv(1)", "consultar"),
    (4, "qual a taxa de erro", "SELECT COUNT(*) FROM incident", "consultar"),
    (
        5,
        "percentual por tipo",
        "SELECT SUM(CASE WHEN a = 1 AND b = 2 THEN 1 ELSE 0 END) / COUNT(*) FROM incident",
        "consultar",
    ),
    (6, "status", "SELECT 1 FROM incident i WHERE i.status = 'open'", "consultar"),
    (
        7,
        "status near",
        "SELECT 1 FROM incident i JOIN asset a ON i.asset_id = a.asset_id "
        "WHERE i.status = 'Opem' AND a.criticality = 'high'",
        "consultar",
    ),
    (8, "como responder a phishing", "no sql", "direto"),
    (9, "qual a chance de falso positivo", "no sql", "direto"),
    (10, "oi tudo bem", "no sql", "direto"),
    (11, "open ones", "SELECT 1 FROM vulnerability AS v WHERE v.status = 'fixed'", "consultar"),
    (12, "which", "SELECT 1 FROM incident WHERE status = 'OPEN' AND kind = 'Malwar'", "consultar"),
    (13, "a file", "SELECT COUNT(*) FROM parquet.`/data/incident`", "consultar"),
    (14, "a class", "SELECT reflect('java.lang.System', 'exit')", "consultar"),
    (15, "a script", "SELECT TRANSFORM(kind) USING 'cat' AS kind FROM incident", "consultar"),
]

COMPOSED_FROM = 2_000_000_000_000  # query ids of composed requests start here

# Composed requests take one piece of each list, by the digits of the event's number; the last piece of a
# condition is followed by the event's type as a literal. 11 x 9 x 8 x 7 shapes.
QUESTION_PIECES = [
    "qual a taxa de resolvidos", "percentual por ambiente", "show me all", "porcentagem aberta ou fechada",
    "a proporção de críticos", "how many are open", "chance de falso positivo em phishing", "compare os tipos",
]
VERB_PIECES = [
    "SELECT COUNT(*)", "select severity, count(*) as n", "  SELECT DISTINCT kind",
    "SELECT 100.0 * SUM(CASE WHEN status = 'Open' AND severity = 'high' THEN 1 ELSE 0 END) / COUNT(*)",
    "SELECT SUM(CASE WHEN kind = 'ddos' THEN 1 ELSE 0 END) * 1.0 / NULLIF(COUNT(*), 0)",
    "SELECT SUM(CASE WHEN kind = 'DDoS' AND status = 'open' THEN 1 END) / SUM(CASE WHEN kind = 'DDoS' THEN 1 END)",
    "WITH late AS (SELECT * FROM incident) SELECT MAX(hours_to_resolve)", "EXPLAIN SELECT 1",
    "INSERT INTO copied SELECT *", "UPDATE incident SET status = 'open'", "Select avg(cvss), 'drop it'",
]
SOURCE_PIECES = [
    " FROM incident", " FROM incident AS inc", " FROM vulnerability vul", " from asset", " FROM late",
    " from incident i left join asset a using (asset_id)", " FROM read_csv('calls.csv')", " FROM glob('*') g",
    " FROM vulnerability LEFT JOIN asset host ON host.asset_id = vulnerability.asset_id",
]
CONDITION_PIECES = [
    "", " WHERE status = 'open'", " WHERE inc.status = 'In Progress' AND inc.kind = ''", " WHERE vul.status = 'Fixd' AND cvss >= 9",
    " WHERE criticality = 'HIGH' AND internet_exposed = 'Yes'", " WHERE a.environment = 'machinery'",
    " where host.os = 'os-1' or vulnerability.status = 'In fxi'", " WHERE kind = ",
]
TAIL_PIECES = ["", ";", " GROUP BY severity", " ORDER BY 1 DESC LIMIT 10", "; DELETE FROM asset", " ; ", " GROUP BY kind;;"]


def _case(column, pairs, otherwise):
    out = None
    for value, label in pairs:
        out = F.when(column == value, label) if out is None else out.when(column == value, label)
    return out.otherwise(otherwise)


class Tables:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        if name not in RAW:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.raw(name)
        raise AttributeError(name)

    @cached_property
    def asset(self) -> DataFrame:
        c, n = self.raw("customer"), self.raw("nation")
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            F.col("c_custkey").alias("asset_id"),
            F.col("c_name").alias("hostname"),
            F.col("c_mktsegment").alias("environment"),
            F.col("n_name").alias("department"),
            F.when(F.col("c_acctbal") >= 6000, "High")
            .when(F.col("c_acctbal") >= 2000, "Medium")
            .otherwise("Low")
            .alias("criticality"),
            F.concat(F.lit("OS-"), (F.col("c_custkey") % 5).cast("string")).alias("os"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "Yes")
            .otherwise("No")
            .alias("internet_exposed"),
        )

    @cached_property
    def incident(self) -> DataFrame:
        slot = F.col("o_orderkey") % 8
        false_rate = _case(
            F.col("o_orderpriority"), [("1-URGENT", 4), ("2-HIGH", 12), ("3-MEDIUM", 30)], 55
        )
        return self.raw("orders").select(
            F.col("o_orderkey").alias("incident_id"),
            F.col("o_custkey").alias("asset_id"),
            F.col("o_orderdate").cast("date").alias("opened_on"),
            _case(slot, [(i, k) for i, (k, _) in enumerate(KINDS[:-1])], KINDS[-1][0]).alias("kind"),
            _case(
                F.col("o_orderpriority"),
                [("1-URGENT", "Critical"), ("2-HIGH", "High"), ("3-MEDIUM", "Medium")],
                "Low",
            ).alias("severity"),
            _case(slot, [(i, t) for i, (_, t) in enumerate(KINDS[:-1])], KINDS[-1][1]).alias(
                "technique"
            ),
            _case(F.col("o_orderstatus"), [("O", "Open"), ("P", "In progress")], "Resolved").alias(
                "status"
            ),
            F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 5000).alias(
                "hours_to_resolve"
            ),
            F.when((F.col("o_orderkey") * 7919) % 100 < false_rate, "Yes")
            .otherwise("No")
            .alias("false_positive"),
        )

    @cached_property
    def vulnerability(self) -> DataFrame:
        owner = self.raw("orders").select("o_orderkey", "o_custkey")
        line = self.raw("lineitem")
        cvss = F.col("l_quantity") / 5
        return line.join(owner, line.l_orderkey == owner.o_orderkey).select(
            F.concat_ws(
                "-",
                *[
                    F.col(c).cast("string")
                    for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
                ],
            ).alias("vuln_id"),
            F.col("o_custkey").alias("asset_id"),
            F.concat(F.lit("CVE-"), (F.col("l_partkey") % 10).cast("string")).alias("cve"),
            cvss.alias("cvss"),
            F.col("l_shipdate").cast("date").alias("detected_on"),
            _case(F.col("l_returnflag"), [("A", "Open"), ("N", "In fix")], "Fixed").alias("status"),
            F.when(cvss >= 9, 7).when(cvss >= 7, 14).otherwise(30).alias("sla_days"),
        )

    @cached_property
    def llm_call(self) -> DataFrame:
        front = F.col("event_type").isin("click", "view")
        failed = (F.col("event_id") * 31) % 20 == 0
        return self.raw("events").select(
            F.col("event_id").alias("call_id"),
            F.col("ts").cast("timestamp").alias("created_at"),
            F.floor(F.col("event_id") / 4).alias("request_id"),
            F.when(front, "writer").otherwise("collector").alias("agent"),
            F.col("event_type").alias("stage"),
            F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"),
            F.col("value").alias("duration_ms"),
            F.when(failed, 0).otherwise(1).alias("success"),
            F.when(front, F.lit(None)).otherwise(F.col("event_id") % 500).alias("prompt_tokens"),
            F.when(front, F.lit(None)).otherwise(F.col("event_id") % 90).alias("completion_tokens"),
            F.when(
                failed,
                F.concat(
                    F.lit("ProviderError at stage "),
                    F.col("event_type"),
                    F.lit(": the upstream service gave no answer for user "),
                    F.col("user_id").cast("string"),
                ),
            ).alias("error"),
        )

    @cached_property
    def message(self) -> DataFrame:
        """User and assistant turns; ``msg_seq`` is their global order and the
        trace is JSON text, now and then broken."""
        return (
            self.raw("conversations")
            .where(F.col("role").isin("user", "assistant"))
            .select(
                "conv_id",
                (F.col("conv_id") * 100 + F.col("turn")).alias("msg_seq"),
                "role",
                "text",
                F.when(F.col("role") == "user", F.lit(None).cast("string"))
                .when(F.col("turn") % 3 == 0, F.lit("[{broken"))
                .otherwise(
                    F.concat(
                        F.lit('[{"tipo":"sql","sql":"SELECT '),
                        F.col("turn").cast("string"),
                        F.lit('","linhas":1},{"tipo":"agente","papel":"triador"}]'),
                    )
                )
                .alias("trace"),
            )
        )

    @cached_property
    def trace_event(self) -> DataFrame:
        user = F.col("user_id")
        kind = _case(
            F.col("event_type"),
            [("signup", "sql"), ("error", "rag"), ("click", "tempo"), ("view", "agente")],
            "ml",
        )
        source = F.concat(F.lit("doc-"), (user % 20).cast("string"))
        return (
            self.raw("events")
            .withColumn("kind", kind)
            .select(
                F.floor(F.col("event_id") / 4).alias("answer_id"),
                (F.col("event_id") % 4).alias("pos"),
                "kind",
                F.when(
                    F.col("kind") == "tempo",
                    F.concat(F.lit("stage-"), (user % 3).cast("string")),
                ).alias("stage"),
                F.when(F.col("kind") == "tempo", F.col("value")).alias("seconds"),
                F.when(
                    F.col("kind") == "sql",
                    F.concat(F.lit("SELECT COUNT(*) FROM incident WHERE asset_id = "),
                             user.cast("string")),
                ).alias("sql"),
                F.when(F.col("kind") == "sql", F.col("event_id") % 9).alias("n_rows"),
                F.when(
                    F.col("kind") == "rag", F.concat(F.lit("question "), user.cast("string"))
                ).alias("query"),
                F.when(F.col("kind") == "rag", F.array(source, F.lit("doc-0"))).alias("sources"),
                F.when(
                    F.col("kind") == "ml", F.concat(F.lit("kind="), (user % 8).cast("string"))
                ).alias("filter"),
                F.when(F.col("kind") == "ml", F.col("event_id") % 50).alias("n_incidents"),
                F.when(F.col("kind") == "ml", (user % 100).cast("double")).alias("mean_prob"),
                F.when(F.col("kind") == "agente", F.lit("handed over")).alias("action"),
                F.when(
                    F.col("kind") == "agente",
                    F.when(user % 2 == 0, "triador").otherwise("redator"),
                ).alias("role"),
            )
        )

    @cached_property
    def run_verdict(self) -> DataFrame:
        eid = F.col("event_id")
        return self.raw("events").select(
            F.floor(eid / 3).alias("case_id"),
            (eid % 3 + 1).alias("run"),
            (eid % 4).alias("n_facts"),
            ((eid * 7) % 5).alias("n_covered"),
            F.when(eid % 17 == 0, 1).otherwise(0).alias("hallucinated"),
            (eid % 5 + 1).alias("grade"),
            (F.col("value") / 50).alias("seconds"),
            F.when(eid % 11 == 0, F.lit(None)).otherwise(eid % 6).alias("claims"),
            ((eid * 3) % 6).alias("supported"),
            ((eid % 13).cast("double") / 10 - 0.1).alias("relevance"),
            F.when(eid % 7 == 0, "n/a")
            .otherwise(((eid % 13).cast("double") / 10 - 0.1).cast("string"))
            .alias("relevance_text"),
            F.when(eid % 3 == 0, F.lit(None)).otherwise((eid % 4 < 3).cast("int")).alias("cited"),
            (eid % 5 != 0).cast("int").alias("routed"),
            F.when(eid % 4 != 0, (eid % 9 != 0).cast("double")).alias("sql_correct"),
        )

    @cached_property
    def query_log(self) -> DataFrame:
        """Logged requests: one per event, a fixed form filled with the event's type and
        user, one per event composed of pieces, and one per turn of the conversations, whose text is the
        question and a literal of the statement."""
        forms = F.broadcast(  # fixed list above
            self.spark.createDataFrame(
                LOGGED_REQUESTS, "tid long, question string, sql_text string, route string"
            )
        )
        user = F.col("user_id").cast("string")
        asked = (
            spread(self.raw("events"), "event_id")
            .withColumn("tid", F.col("event_id") % len(LOGGED_REQUESTS))
            .join(forms, "tid")
            .select(
                F.col("event_id").alias("query_id"),
                F.concat_ws(" ", "question", "event_type", user).alias("question"),
                F.when(
                    F.col("sql_text").contains("WHERE"),
                    F.concat("sql_text", F.lit(" AND asset_id = "), user),
                ).otherwise(F.col("sql_text")).alias("sql_text"),
                "route",
            )
        )
        said = self.raw("conversations").select(
            (F.lit(SAID_FROM) + F.col("conv_id") * 100 + F.col("turn")).alias("query_id"),
            F.col("text").alias("question"),
            F.concat(
                F.lit("SELECT 1 FROM incident i WHERE i.kind = '"),
                F.replace("text", F.lit("'"), F.lit("")),
                F.lit("'"),
            ).alias("sql_text"),
            F.when(F.col("turn") % 2 == 0, "direto").otherwise("consultar").alias("route"),
        )
        return asked.unionByName(said).unionByName(self._composed_requests())

    def _composed_requests(self) -> DataFrame:
        number, left = F.col("event_id"), F.col("event_id")
        picked = {}
        for name, pieces in (
            ("verb", VERB_PIECES), ("source", SOURCE_PIECES), ("condition", CONDITION_PIECES), ("tail", TAIL_PIECES),
        ):
            picked[name] = F.get(F.array(*map(F.lit, pieces)), (left % len(pieces)).cast("int"))
            left = F.floor(left / len(pieces))
        literal = F.when(
            picked["condition"].endswith("= "), F.concat(F.lit("'"), "event_type", F.lit("'"))
        ).otherwise("")
        question = F.get(F.array(*map(F.lit, QUESTION_PIECES)), (number % len(QUESTION_PIECES)).cast("int"))
        return self.raw("events").select(
            (F.lit(COMPOSED_FROM) + number).alias("query_id"),
            F.concat_ws(" ", question, "event_type").alias("question"),
            F.concat(picked["verb"], picked["source"], picked["condition"], literal, picked["tail"]).alias("sql_text"),
            F.when(number % 3 == 0, "direto").otherwise("consultar").alias("route"),
        )

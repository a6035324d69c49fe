"""MEM-1..10."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.checks import check
from wardlight.checks.views_sql import over
from wardlight.operators import memory as m

NOW = "2030-01-01 00:00:00"
_AT = "to_timestamp(CAST(msg_seq AS DOUBLE))"
_STAMP = "make_timestamp(msg_seq * 1000000)"
_CONV = f"""conv AS (SELECT conv_id, arg_min(text, msg_seq) AS title, max({_STAMP}) AS updated_at
 FROM message GROUP BY conv_id)"""


def _conv(t):
    return t.message.groupBy("conv_id").agg(
        F.min_by("text", "msg_seq").alias("title"),
        F.max(F.timestamp_seconds("msg_seq").cast("timestamp_ntz")).alias("updated_at"),
    )


@check("mem_01_recent_conversations", over("message", f"""WITH {_CONV}
SELECT conv_id, substr(title, 1, 60) AS title, updated_at FROM conv ORDER BY updated_at DESC, conv_id LIMIT 8"""))
def _(t):
    return m.recent_conversations(_conv(t))


@check("mem_02_messages", over("message", """
SELECT conv_id, msg_seq, role, text, CASE WHEN role = 'user' OR NOT json_valid(trace) THEN 0 ELSE 2 END AS n_events,
 CASE WHEN role <> 'user' AND json_valid(trace) THEN json_extract_string(trace, '$[0].sql') END AS first_sql FROM message"""))
def _(t):
    return m.messages_of(t.message).select(
        "conv_id", "msg_seq", "role", "text",
        F.size("events").alias("n_events"),
        F.try_element_at("events", F.lit(1))["sql"].alias("first_sql"),
    )


@check("mem_02_messages_of_one", over("message", "SELECT conv_id, msg_seq, role, text FROM message WHERE conv_id = 3"))
def _(t):
    return m.messages_of(t.message, 3).drop("events")


@check("mem_03_exchanges", over("message", """
SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS exchanges FROM message GROUP BY 1"""))
def _(t):
    return m.exchanges(t.message)


def _later(t):
    """A follow-up to every conversation that ends with the assistant."""
    return t.message.where("role = 'assistant'").select(
        "conv_id", (F.col("msg_seq") + 50).alias("msg_seq"), F.lit("user").alias("role"),
        F.lit("and then?").alias("text"),
        F.timestamp_seconds(F.col("msg_seq") + 50).cast("timestamp_ntz").alias("created_at"),
    )


def _stamped(t):
    return t.message.select(
        "conv_id", "msg_seq", "role", "text",
        F.timestamp_seconds("msg_seq").cast("timestamp_ntz").alias("created_at"),
    )


@check("mem_04_append_conversations", over("message", f"""WITH {_CONV},
nw AS (SELECT conv_id, max(make_timestamp((msg_seq + 50) * 1000000)) AS newest FROM message WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id, title, greatest(updated_at, newest) AS updated_at FROM conv LEFT JOIN nw USING (conv_id)"""))
def _(t):
    return m.append_messages(_conv(t), _stamped(t), _later(t))[0]


@check("mem_04_append_messages", over("message", f"""
SELECT conv_id, msg_seq, role, text, {_STAMP} AS created_at FROM message UNION ALL
SELECT conv_id, msg_seq + 50, 'user', 'and then?', make_timestamp((msg_seq + 50) * 1000000) FROM message WHERE role = 'assistant'"""))
def _(t):
    return m.append_messages(_conv(t), _stamped(t), _later(t))[1]


_GONE = "SELECT conv_id FROM message WHERE role = 'assistant' AND length(text) > 900"


def _gone(t):
    return t.message.where("role = 'assistant' and char_length(text) > 900")


@check("mem_05_delete_conversations", over("message", f"""WITH {_CONV}
SELECT conv_id, title, updated_at FROM conv WHERE conv_id NOT IN ({_GONE})"""))
def _(t):
    return m.delete_conversations(_conv(t), t.message, _gone(t))[0]


@check("mem_05_delete_messages", over("message", f"""
SELECT conv_id, msg_seq, role FROM message WHERE conv_id NOT IN ({_GONE})"""))
def _(t):
    return m.delete_conversations(_conv(t), t.message, _gone(t))[1].select("conv_id", "msg_seq", "role")


# offered facts: the opening words of user turns, with dots, blanks and case variants;
# known facts: those of the assistant turns
_OFFER = """SELECT msg_seq AS seq, CASE msg_seq % 3 WHEN 0 THEN concat(' ', substr(text, 1, msg_seq % 11), '.. ')
 WHEN 1 THEN upper(substr(text, 1, 8)) ELSE substr(text, 1, 8) END AS fact FROM message WHERE role = 'user'"""
_KNOWN = f"""SELECT substr(text, 1, 8) AS fact, min({_STAMP}) AS created_at, max({_STAMP}) AS updated_at
 FROM message WHERE role = 'assistant' GROUP BY 1"""
_CLEAN = f"""offer AS ({_OFFER}), known AS ({_KNOWN}),
clean AS (SELECT seq, rtrim(regexp_replace(fact, '^\\s+|\\s+$', '', 'g'), '.') AS fact FROM offer),
one AS (SELECT lower(fact) AS low, arg_min(fact, seq) AS fact FROM clean WHERE length(fact) BETWEEN 4 AND 200 GROUP BY 1),
latest AS (SELECT lower(fact) AS low FROM known ORDER BY updated_at DESC, fact LIMIT 12),
added AS (SELECT fact FROM one WHERE low NOT IN (SELECT low FROM latest))"""


def _upsert(t):
    offer = t.message.where("role = 'user'").select(
        F.col("msg_seq").alias("seq"),
        F.expr("""CASE msg_seq % 3 WHEN 0 THEN concat(' ', substr(text, 1, CAST(msg_seq % 11 AS INT)), '.. ')
          WHEN 1 THEN upper(substr(text, 1, 8)) ELSE substr(text, 1, 8) END""").alias("fact"),
    )
    return m.upsert_facts(_known(t), offer, NOW)


def _known(t):
    at = F.timestamp_seconds("msg_seq")
    return t.message.where("role = 'assistant'").groupBy(F.substring("text", 1, 8).alias("fact")).agg(
        F.min(at).alias("created_at"), F.max(at).alias("updated_at")
    )


@check("mem_06_upsert_profile", over("message", f"""WITH {_CLEAN}
SELECT fact, coalesce(k.created_at, TIMESTAMP '{NOW}') AS created_at,
 CASE WHEN a.fact IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE k.updated_at END AS updated_at
FROM known k FULL JOIN added a USING (fact)"""))
def _(t):
    return _upsert(t)[0].select(
        "fact", F.col("created_at").cast("timestamp_ntz"), F.col("updated_at").cast("timestamp_ntz")
    )


@check("mem_06_upsert_added", over("message", f"WITH {_CLEAN} SELECT fact FROM added"))
def _(t):
    return _upsert(t)[1]


@check("mem_07_profile", over("message", f"WITH k AS ({_KNOWN}) SELECT fact FROM k ORDER BY updated_at DESC, fact LIMIT 12"))
def _(t):
    return m.profile(_known(t)).select("fact")


@check("mem_08_context_window", over("message", r"""
SELECT conv_id, string_agg(line, chr(10) ORDER BY msg_seq) AS context FROM (
 SELECT conv_id, msg_seq, CASE WHEN role = 'user' THEN 'analista' ELSE 'assistente' END || ': ' ||
  substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 300) AS line,
  row_number() OVER (PARTITION BY conv_id ORDER BY msg_seq DESC) AS back FROM message) WHERE back <= 6 GROUP BY 1"""))
def _(t):
    return m.context_window(t.message)


@check("mem_09_transcripts", over("message", """
SELECT conv_id, msg_seq AS block_no, CASE WHEN role = 'user' THEN '**Analista**' ELSE '**Assistente**' END || chr(10)
 || chr(10) || text || chr(10) AS block FROM message
UNION ALL SELECT conv_id, min(msg_seq) - 1, '# Conversa' || chr(10) FROM message GROUP BY 1"""))
def _(t):
    return m.transcripts(t.message)


@check("mem_10_due_for_facts", over("message", """
SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS exchanges FROM message GROUP BY 1
HAVING sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) % 2 = 0"""))
def _(t):
    return m.due_for_facts(t.message)

"""Conversation, message and profile-fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions.text import strip
from wardlight.operators.traces import parse_trace
from wardlight.plans.ordering import top_per_group

RECENT, TITLE_CHARS = 8, 60
FACTS, FACT_MIN, FACT_MAX = 12, 4, 200
TURNS, TURN_CHARS = 6, 300


def recent_conversations(conv: DataFrame, n: int = RECENT) -> DataFrame:
    return (
        conv.select("conv_id", F.substring("title", 1, TITLE_CHARS).alias("title"), "updated_at")
        .orderBy(F.desc("updated_at"), "conv_id")
        .limit(n)
    )


def messages_of(msgs: DataFrame, conv_id=None) -> DataFrame:
    """Messages of one conversation, or all, in order with their parsed trace;
    a trace that does not parse counts as empty."""
    chosen = msgs if conv_id is None else msgs.where(F.col("conv_id") == conv_id)
    return (
        chosen.withColumn("events", parse_trace(F.coalesce("trace", F.lit("[]"))))
        .drop("trace")
        .orderBy("conv_id", "msg_seq")
    )


def exchanges(msgs: DataFrame) -> DataFrame:
    return msgs.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("exchanges")
    )


def append_messages(
    conv: DataFrame, msgs: DataFrame, new: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Conversations with their update time advanced, and messages with the new
    ones added. New messages are reduced to one row per conversation first."""
    newest = new.groupBy("conv_id").agg(F.max("created_at").alias("_newest"))
    advanced = conv.join(newest, "conv_id", "left").withColumn(
        "updated_at", F.greatest("updated_at", "_newest")
    )
    return advanced.select(*conv.columns), msgs.unionByName(new)


def delete_conversations(
    conv: DataFrame, msgs: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("conv_id").distinct()
    return conv.join(gone, "conv_id", "left_anti"), msgs.join(gone, "conv_id", "left_anti")


def clear_profile(profile: DataFrame) -> DataFrame:
    return profile.where(F.lit(False))


def profile(facts: DataFrame, n: int = FACTS) -> DataFrame:
    return facts.orderBy(F.desc("updated_at"), "fact").limit(n)


def clean_facts(facts: DataFrame) -> DataFrame:
    """Candidate facts (seq, fact) trimmed, without trailing dots, of a length
    worth keeping, one per text ignoring case: the first offered."""
    text = F.regexp_replace(strip(F.col("fact")), r"\.+$", "")
    return (
        facts.withColumn("fact", text)
        .where(F.char_length("fact").between(FACT_MIN, FACT_MAX))
        .groupBy(F.lower("fact").alias("_low"))
        .agg(F.min_by("fact", "seq").alias("fact"))
    )


def upsert_facts(
    known: DataFrame, facts: DataFrame, now: str, recent: int = FACTS
) -> tuple[DataFrame, DataFrame]:
    """Add facts to the profile; returns the new profile and the added facts.

    Facts already among the latest ``recent`` (ignoring case) are skipped. An
    older fact offered again with the very same text gets a new update time and
    counts as added.
    """
    latest = profile(known, recent).select(F.lower("fact").alias("_low"))
    added = (
        clean_facts(facts)
        .join(F.broadcast(latest), "_low", "left_anti")
        .select("fact")
    )
    moment = F.lit(now).cast("timestamp")
    merged = (
        known.join(added.withColumn("_again", F.lit(True)), "fact", "full")
        .select(
            "fact",
            F.coalesce("created_at", moment).alias("created_at"),
            F.when(F.col("_again"), moment).otherwise(F.col("updated_at")).alias("updated_at"),
        )
    )
    return merged, added


def context_window(msgs: DataFrame, n: int = TURNS) -> DataFrame:
    """Last ``n`` turns of each conversation as ``role: text`` lines; the cut
    comes before empty turns are dropped, so at most n lines are gathered."""
    spoken = F.substring(strip(F.col("text")), 1, TURN_CHARS)
    who = F.when(F.col("role") == "user", "analista").otherwise("assistente")
    return (
        top_per_group(
            msgs.select("conv_id", "msg_seq", "role", "text"),
            ["conv_id"], [F.desc("msg_seq")], n, "_back",
        )
        .withColumn("_line", F.when(spoken != "", F.concat(who, F.lit(": "), spoken)))
        .groupBy("conv_id")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("msg_seq", "_line"))),
                    lambda m: m["_line"],
                ),
                "\n",
            ).alias("context")
        )
    )


def transcripts(msgs: DataFrame, heading: str = "# Conversa", assistant: str = "Assistente") -> DataFrame:
    """Markdown blocks (conv_id, block_no, block) that read in order make the
    transcript of a conversation: a heading block 0, then one block per
    message. Rows rather than one text, so a conversation has no size limit."""
    who = F.when(F.col("role") == "user", "**Analista**").otherwise(f"**{assistant}**")
    spoken = msgs.select(
        "conv_id",
        F.col("msg_seq").alias("block_no"),
        F.concat(who, F.lit("\n\n"), F.col("text"), F.lit("\n")).alias("block"),
    )
    heads = msgs.groupBy("conv_id").agg(
        (F.min("msg_seq") - 1).alias("block_no"), F.lit(heading + "\n").alias("block")
    )
    return heads.unionByName(spoken)


def write_transcripts(blocks: DataFrame, path: str, buckets: int | None = 256) -> None:
    """Files and lines in block order, conversations one after the other, in
    ``buckets`` folders by hashed conversation; with None one folder each, for small
    exports only."""
    by = ["conv_id"] if buckets is None else ["bucket"]
    placed = blocks if buckets is None else blocks.withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets)))
    (
        placed.repartitionByRange(*by, *([] if buckets is None else ["conv_id"]), "block_no")
        .sortWithinPartitions(*by, "conv_id", "block_no")
        .select(*by, "block")
        .write.mode("overwrite").partitionBy(*by).text(path)
    )


def due_for_facts(msgs: DataFrame, every: int = 2) -> DataFrame:
    """Conversations whose number of exchanges is a positive multiple of
    ``every``."""
    return exchanges(msgs).where((F.col("exchanges") > 0) & (F.col("exchanges") % every == 0))

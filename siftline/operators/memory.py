"""Conversations: recent turns, a transcript within a budget, stand-alone questions, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS, TRANSCRIPT_CHARS, TURN_CHARS, DAYS = 6, 2500, 600, 30


def recent(turns: DataFrame, n: int = TURNS, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    w = Window.partitionBy(conv).orderBy(F.desc(order))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def transcript(turns: DataFrame, budget: int = TRANSCRIPT_CHARS, each: int = TURN_CHARS, conv: str = "conv_id", order: str = "turn", names: tuple[str, str] | None = None) -> DataFrame:
    """Per conversation the newest turns that fit the budget (one at least), oldest first, a line for each.

    Spaces are collapsed; a turn of more than ``each`` characters ends in an ellipsis there. names: of the user and of
    all others (else their roles).
    """
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    text = F.concat(F.substring(text, 1, each), F.when(F.length(text) > each, "…").otherwise(""))
    who = F.when(F.col("role") == "user", names[0]).otherwise(names[1]) if names else F.col("role")
    line = turns.select(conv, order, F.concat(who, F.lit(": "), text).alias("line"))
    w = Window.partitionBy(conv).orderBy(F.desc(order))
    line = line.withColumn("back", F.row_number().over(w)).withColumn("used", F.sum(F.length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = line.where((F.col("back") == 1) | (F.col("used") <= budget))
    return kept.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("transcript"), F.count("*").alias("turns"))


def standalone(turns: DataFrame, dependent: Column, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """User turns with the question to search for: one that leans on what was said gets the user turn before it."""
    asked = turns.where("role = 'user'")
    before = F.lag("text").over(Window.partitionBy(conv).orderBy(order))
    return asked.withColumn("standalone", F.when(dependent & before.isNotNull(), F.concat(before, F.lit(" — "), "text")).otherwise(F.col("text")))


def purge(conversations: DataFrame, now: Column, days: int = DAYS, updated: str = "updated_at") -> DataFrame:
    """What stays: conversations touched within so many days."""
    return conversations.where(F.col(updated) >= now - F.make_dt_interval(F.lit(days)))


def append(conversations: DataFrame, messages: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) with new messages (conv_id, turn, role, text): their conversations are touched or begun."""
    told = new.groupBy("conv_id").agg(F.lit(1).alias("x")).select("conv_id", now.alias("now"))
    both = conversations.join(told, "conv_id", "full_outer").select("conv_id", F.coalesce("now", "updated_at").alias("updated_at"))
    return both, messages.unionByName(new.select(*messages.columns))


def purge_with_messages(conversations: DataFrame, messages: DataFrame, now: Column, days: int = DAYS) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) that stay: messages go with their conversation."""
    kept = purge(conversations, now, days)
    return kept, messages.join(kept.select("conv_id"), "conv_id", "left_semi")


def accept_rewrite(question: Column, rewrite: Column, fallback: Column) -> Column:
    """A model's stand-alone form of a question, if it is one: its first line, without quotes, of 3 to max(400, 3 times
    the question's) characters and no refusal; else the fallback."""
    first = F.trim(F.substring_index(F.regexp_replace(F.trim(F.coalesce(rewrite, F.lit(""))), "^[\"“”\\s]+|[\"“”\\s]+$", ""), "\n", 1))
    ok = F.length(first).between(3, F.greatest(F.lit(400), 3 * F.length(question))) & ~F.contains(first, F.lit("INSUFFICIENT"))
    return F.when(ok, first).otherwise(fallback)

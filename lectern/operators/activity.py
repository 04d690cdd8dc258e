"""Usage, history, threads and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import dates


def usage(events: DataFrame) -> DataFrame:
    """used by user, kind and month."""
    return events.groupBy("user_id", F.col("event_type").alias("kind"), dates.month(F.col("ts")).alias("period")).agg(F.count("*").alias("used"))


def budget(usage: DataFrame, limit: int, free: Column | None = None) -> DataFrame:
    """usage with what remains and whether more is allowed; free: who has no limit."""
    left = F.greatest(F.lit(0), F.lit(limit) - F.col("used"))
    always = free if free is not None else F.lit(False)
    return usage.withColumn("remaining", left.cast("bigint")).withColumn("allowed", always | (F.col("used") < limit))


def token_ledger(messages: DataFrame, key: list[str | Column], limit: int) -> DataFrame:
    """Estimated tokens (a quarter of the characters, rounded up) by key, and what remains of a limit."""
    return messages.groupBy(*key).agg(F.sum(F.ceil(F.length("text") / 4)).cast("bigint").alias("tokens"), F.count("*").alias("calls")).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("tokens")).cast("bigint"))


def keep_latest(history: DataFrame, n: int = 400, user: str = "user_id", at: str = "ts", key: str = "event_id") -> DataFrame:
    k = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(at), F.desc(key)))
    return history.withColumn("_k", k).filter(F.col("_k") <= n).drop("_k")


def by_day(history: DataFrame) -> DataFrame:
    """Counts by user, day and type."""
    return history.groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


def threads(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, last_turn, title (the first user turn's beginning)."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), F.substring(first, 1, 60).alias("title"))


def sessions(events: DataFrame, gap: str = "30 days") -> DataFrame:
    """user_id, start, end, n of runs of events with less than `gap` between them."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def projects(events: DataFrame, kind: str = "purchase", most: int = 1000) -> DataFrame:
    """A user's embedded list of items, by time; `most` bounds what one row holds."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events.filter(F.col("event_type") == kind).withColumn("_n", n).filter(F.col("_n") <= most)
    return rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: F.struct(x["event_id"].alias("id"), x["value"].alias("value"))).alias("cards"))


def prepend(cards: Column, item: Column) -> Column:
    return F.concat(F.array(item), cards)


def without(cards: Column, id_: Column) -> Column:
    return F.filter(cards, lambda x: x["id"] != id_)


def pack_paragraphs(paragraphs: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """Whole paragraphs from the start that fit in `budget` characters with two between them; if the first doesn't, its sentences' beginning."""
    size = F.sum(F.length("text") + 2).over(Window.partitionBy(key).orderBy("pos"))
    p = paragraphs.withColumn("_size", size)
    kept = p.groupBy(key).agg(F.count_if(F.col("_size") <= budget).alias("n_kept"), F.max(F.when(F.col("_size") <= budget, F.col("_size"))).alias("n_chars"), F.min_by("text", "pos").alias("_first"))
    start = F.substring("_first", 1, budget)
    stop = F.length(start) - F.length(F.substring_index(start, ". ", -1))
    return kept.withColumn("cut", F.when(F.col("n_kept") == 0, F.when(stop > 0, F.rtrim(F.substring(start, F.lit(1), stop))).otherwise(start))).drop("_first")

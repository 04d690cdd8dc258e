"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.scratch import shared_dir, written  # noqa: F401

#: Everything that separates words: space, tab, newline, vertical tab, form feed, carriage return.
WS = " \t\n\x0b\f\r"
WS_RE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RE))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashed_sample(df: DataFrame, key: Column, most: int, seed: str) -> DataFrame:
    """About `most` rows at most, chosen by a hash of key: the same rows whatever the partitioning."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def join_spread(rows: DataFrame, keyed: DataFrame, key: list[str], n: str = "n", share: int = 1000) -> DataFrame:
    """rows joined with keyed (one row for each key; n: how many of rows hold it), without a hot task.

    At most `share` keys can hold more than one in `share` of the rows, so those are broadcast; all other keys
    meet in a sort-merge join. Both should be written tables, since each is read twice.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot, others = keyed.filter(F.col(n) > total / share), keyed.filter(F.col(n) <= total / share)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(others.hint("merge"), key))

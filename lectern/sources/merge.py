"""Merging deltas into keyed tables, and writing slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of base whose key isn't in delta, and the last row of each key in delta (by `order`).

    base only meets delta's distinct keys, so an anti-join can broadcast a small delta, and base isn't sorted.
    """
    new = delta
    if order:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        new = delta.withColumn("_n", n).filter("_n = 1").drop("_n")
    return base.join(delta.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*base.columns))


def upsert_present(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """As upsert, but where delta has null the old value stays. delta has one row for each key."""
    rest = [c for c in base.columns if c not in keys]
    new = delta.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in rest))
    return base.join(new, keys, "full_outer").select(*keys, *(F.coalesce(f"_new_{c}", c).alias(c) for c in rest))


def insert_absent(base: DataFrame, delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """delta with duplicate: whether its key is in base already, or earlier in delta."""
    known = base.select(*keys).distinct().withColumn("_known", F.lit(True))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    return delta.withColumn("_first", first).join(known, keys, "left").withColumn("duplicate", F.coalesce("_known", F.lit(False)) | ~F.col("_first")).drop("_known", "_first")


def latest(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def with_defaults(meta: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """key, value: the defaults, with what meta says instead where it does, and all that it says besides."""
    base = meta.sparkSession.createDataFrame(list(defaults.items()), "key string, value string")
    return base.withColumnRenamed("value", "_default").join(meta, "key", "full_outer").select("key", F.coalesce("value", "_default").alias("value"))


def write_slices(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions of `by` that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def not_in(df: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(held.select(*keys).distinct(), keys, "left_anti")


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return not_in(children, deleted, [key])


def replace_slice(base: DataFrame, rebuilt: DataFrame, by: str) -> DataFrame:
    """base with all rows of the slices that rebuilt has replaced by rebuilt's."""
    return not_in(base, rebuilt, [by]).unionByName(rebuilt.select(*base.columns))

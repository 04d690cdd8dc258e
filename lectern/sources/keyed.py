"""Keyed tables whose batches rewrite only the parts that their keys fall into.

A table is cut into buckets by a hash of its key. Each batch writes the buckets that it touches anew, in a folder of its own
version, and then notes them in a log; the newest noted version of a bucket is what counts. So nothing that is being
read is overwritten, a batch that is run again replaces itself, a batch that died halfway isn't seen, and files of other buckets
stay as they are. `buckets` should let one bucket be one task's work.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from lectern.sources import merge
from lectern.sources.scratch import written

BUCKET, VERSION = "_bucket", "_version"


class KeyedTable:
    """Null keys share a bucket; a table without a batch has no rows."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def newest(self, before: int | None = None) -> dict[int, int]:
        """The version of each bucket that counts (before some version): one number for each bucket that has rows."""
        try:
            log = self.spark.read.parquet(f"{self.path}/log")
        except AnalysisException as e:  # the table's first batch
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return {}
        log = log if before is None else log.filter(F.col(VERSION) < before)
        return dict(map(tuple, log.groupBy(BUCKET).agg(F.max(VERSION)).collect()))

    def rows(self, only: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The table's rows, of some buckets (before some version); other folders aren't read."""
        by_version: dict[int, list[int]] = {}
        for bucket, version in sorted(self.newest(before).items()):
            if only is None or bucket in only:
                by_version.setdefault(version, []).append(bucket)
        if not by_version:
            return self.spark.createDataFrame([], self.schema)
        schema = StructType([*self.schema.fields]).add(VERSION, LongType()).add(BUCKET, IntegerType())
        wanted = reduce(lambda a, b: a | b, ((F.col(VERSION) == n) & F.col(BUCKET).isin(some) for n, some in by_version.items()))
        return self.spark.read.schema(schema).parquet(f"{self.path}/data").filter(wanted).select(*self.schema.names)

    def rewrite(self, delta: DataFrame, version: int, make: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the buckets of delta's keys by make(their rows, delta); versions go up."""
        delta = written(self.dealt(delta), "delta")
        touched = sorted(r[0] for r in delta.select(BUCKET).distinct().collect())
        new = self.dealt(make(self.rows(touched, version), delta.drop(BUCKET)).select(*self.schema.names))
        out = f"{self.path}/data/{VERSION}={version}"
        new.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(out)
        noted = self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int")
        noted.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{VERSION}={version}")

    def upsert(self, delta: DataFrame, version: int, order: str | None = None) -> None:
        """Rows of delta replace those of their keys; of several with one key the last by `order`."""
        self.rewrite(delta, version, lambda old, new: merge.upsert(old, new, self.keys, order))

"""Streams: incremental ingest, index upkeep, usage windows, quota admission, threads, ratings.

File sources run with Trigger.AvailableNow, so a batch scheduler and a service use the same code, and the
checkpoint is the point to resume from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lectern.operators import ratings as R
from lectern.operators import search as S
from lectern.sources import merge
from lectern.sources.keyed import KeyedTable


def files(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """All that is there now, in micro-batches, from where the checkpoint ends."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # the table's first batch
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "fingerprint") -> None:
    """Append rows whose key the target doesn't hold; twins within a batch both stay.

    A batch is written to a folder of its own number, so a batch that is run again replaces itself.
    """

    def batch(df: DataFrame, n: int) -> None:
        held = _table(df.sparkSession, target, StructType([*df.schema.fields])).filter(F.col("batch") != n) if n else df.limit(0)
        merge.not_in(df, held, [key]).write.mode("overwrite").parquet(f"{target}/batch={n}")

    run(stream, checkpoint, batch)


def import_with_progress(spark: SparkSession, path: str, schema: StructType | str, target: str, log: str, checkpoint: str, key: str = "fingerprint", per_trigger: int = 100, after: Callable[[int], None] | None = None) -> None:
    """As ingest, from files, with a row in `log` for each batch: files of the batch, files done, files known, percent.

    A run goes on where the one before ended, and so does the log; a batch that is run again replaces its row. Files that
    come later raise the number known. after: called with a batch's number when it is done.
    """

    def batch(df: DataFrame, n: int) -> None:
        new = df.drop("_file")
        held = _table(spark, target, new.schema).filter(F.col("batch") < n) if n else new.limit(0)
        merge.not_in(new, held, [key]).write.mode("overwrite").parquet(f"{target}/batch={n}")
        before = (_table(spark, log, spark.createDataFrame([], "files long").schema).filter(F.col("batch") < n).agg(F.sum("files")).first()[0] or 0) if n else 0
        count = df.agg(F.countDistinct("_file").alias("files"))
        done = count.select("files", (F.col("files") + before).alias("files_done"), F.lit(known).alias("files_known"))
        done.withColumn("percent", F.round(F.lit(100.0) * F.col("files_done") / F.greatest("files_known", "files_done"), 2)).coalesce(1).write.mode("overwrite").parquet(f"{log}/batch={n}")
        if after:
            after(n)

    known = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").count()
    stream = files(spark, path, schema, per_trigger).select("*", F.col("_metadata.file_path").alias("_file"))
    run(stream, checkpoint, batch)


def keep_index(stream: DataFrame, target: str, checkpoint: str, fields: list[str], key: str = "doc_id") -> None:
    """Postings of the latest text of each document: a batch's documents replace their older postings.

    Versions are told apart by batch, so nothing is rewritten; `latest_postings` reads the newest.
    """

    def batch(df: DataFrame, n: int) -> None:
        S.postings(df.dropDuplicates([key]), fields, key).withColumn("batch", F.lit(n)).drop("batch").write.mode("overwrite").parquet(f"{target}/batch={n}")

    run(stream, checkpoint, batch)


def latest_postings(spark: SparkSession, target: str, key: str = "doc_id") -> DataFrame:
    p = spark.read.parquet(target)
    newest = p.groupBy(key).agg(F.max("batch").alias("batch"))
    return p.join(newest, [key, "batch"], "left_semi").drop("batch")


def usage_by_day(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Counts by user, kind and day; what comes later than the watermark is left out. Months are sums of days."""
    return events.withWatermark("ts", lateness).groupBy("user_id", F.col("event_type").alias("kind"), F.window("ts", "1 day")).count().select("user_id", "kind", F.to_date("window.start").alias("day"), F.col("count").alias("used"))


def saves_once(saves: DataFrame, keys: list[str], within: str = "10 minutes") -> DataFrame:
    return saves.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def thread_activity(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n_turns"))


def follow_threads(messages: DataFrame, archived: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """A row for each thread in the table (conv_id, last_turn, n_turns), kept up to date; archived threads (conv_id) get none.

    In update mode a batch gives the whole new row of each thread that it touches, so a batch that is run again
    changes nothing.
    """

    def batch(df: DataFrame, n: int) -> None:
        table.upsert(merge.not_in(df, archived, ["conv_id"]), n)

    query = thread_activity(messages).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()


class Admission(StatefulProcessor):
    """Admits a user's events of a month until the limit, in the order of their time within a batch.

    A late event of a month gone by counts towards that month's own total; it doesn't reopen it.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "period string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            f = f.sort_values(["ts", "event_id"])
            out = []
            for r in f.itertuples(index=False):
                period = r.ts.strftime("%Y-%m")
                n = self.used.getValue((period,))[0] if self.used.containsKey((period,)) else 0
                if n < self.limit:
                    self.used.updateValue((period,), (n + 1,))
                out.append((int(r.user_id), int(r.event_id), period, n < self.limit))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "period", "admitted"])

    def close(self) -> None:
        pass


def admit(events: DataFrame, limit: int) -> DataFrame:
    """user_id, event_id, period, admitted. Needs the RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Admission(limit), outputStructType="user_id long, event_id long, period string, admitted boolean", outputMode="append", timeMode="none")


def follow_ratings(rounds: DataFrame, checkpoint: str, target: str) -> None:
    """Histories of newly indexed matches, each batch going on from the ratings that the last one left.

    rounds: matches as `ratings.rated_matches` gives them, in chronological files.
    """

    def batch(df: DataFrame, n: int) -> None:
        old = None
        if n:
            h = df.sparkSession.read.parquet(target).filter(F.col("batch") < n)
            old = h.groupBy("season", "event_abbr", "team_key").agg(F.max_by("rating_after", F.struct("batch", "seq")).alias("rating"))
        R.history(df, old).write.mode("overwrite").parquet(f"{target}/batch={n}")

    run(rounds, checkpoint, batch)

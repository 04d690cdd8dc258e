"""Queries that keep state: entries that expire, threads and cards in tables that batches update in part."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators import cards as C
from lectern.plans.registry import query
from lectern.sources import scratch
from lectern.sources.keyed import KeyedTable
from lectern.streaming import entries, jobs

HOUR = 3_600_000


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful processors need, for a while."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


def _in_parts(parts: list[DataFrame]) -> Iterator[DataFrame]:
    """A stream of files, once for each part that has arrived."""
    files, spark = scratch.fresh(parts[0].sparkSession, "files"), parts[0].sparkSession
    for part in parts:
        part.write.mode("append").parquet(files)
        yield jobs.files(spark, files, part.schema, per_trigger=1_000_000)


#: A fold over the events of each user: what an event ends, and the entry after it.
LIFETIMES = """WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'drop' ELSE 'touch' END AS kind, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
f AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS opened, NULL::BIGINT AS seen, NULL::BIGINT AS due, 0::BIGINT AS n, NULL::BIGINT AS o, NULL::BIGINT AS s, NULL::BIGINT AS ended, 0::BIGINT AS m, NULL::VARCHAR AS reason FROM (SELECT DISTINCT user_id FROM e) u
 UNION ALL SELECT f.user_id, e.k,
  CASE WHEN kind = 'drop' THEN NULL WHEN t <= due THEN opened WHEN kind = 'put' THEN t END, CASE WHEN kind <> 'drop' AND (t <= due OR kind = 'put') THEN t END,
  CASE WHEN kind = 'drop' THEN NULL WHEN kind = 'put' THEN t + {ttl} WHEN t <= due THEN {renewed} END, CASE WHEN kind = 'drop' THEN 0 WHEN t <= due THEN n + 1 WHEN kind = 'put' THEN 1 ELSE 0 END,
  CASE WHEN due IS NOT NULL AND (t > due OR kind = 'drop') THEN opened END, CASE WHEN due IS NOT NULL AND (t > due OR kind = 'drop') THEN seen END, CASE WHEN t > due THEN due WHEN kind = 'drop' AND due IS NOT NULL THEN t END,
  CASE WHEN due IS NOT NULL AND (t > due OR kind = 'drop') THEN n ELSE 0 END, CASE WHEN t > due THEN 'expired' WHEN kind = 'drop' AND due IS NOT NULL THEN 'dropped' END
 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1),
ends AS (SELECT user_id, o, s, ended, m, reason FROM f WHERE reason IS NOT NULL UNION ALL SELECT f.user_id, opened, seen, due, n, 'expired' FROM f JOIN (SELECT user_id, max(k) AS k FROM e GROUP BY user_id) l USING (user_id, k) WHERE due IS NOT NULL)
SELECT user_id::BIGINT AS user_id, make_timestamp(o * 1000) AS opened, make_timestamp(s * 1000) AS seen, make_timestamp(ended * 1000) AS ended, m AS n, reason FROM ends"""


def _lifetimes(v, hours: int, renew: bool) -> DataFrame:
    """Events arrive in three parts, in order of time; two hands of a clock, long after, let the last timers fire."""
    kind = F.when(F.col("event_type") == "signup", entries.PUT).when(F.col("event_type") == "error", entries.DROP).otherwise(entries.TOUCH)
    e = v.events.select(F.col("user_id").cast("string").alias("key"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("n"))
    hand = lambda day: v._spark.createDataFrame([("clock", "tick", 0)], "key string, kind string, n long").select("key", "kind", F.to_timestamp(F.lit(day)).alias("ts"), "n")
    parts = [e.filter("ts < '2024-01-11'"), e.filter("ts >= '2024-01-11' and ts < '2024-01-21'"), e.filter("ts >= '2024-01-21'"), hand("2100-01-01"), hand("2100-01-02")]
    out, checkpoint = scratch.fresh(v._spark, "lifetimes"), scratch.fresh(v._spark, "checkpoint")
    with rocksdb(v._spark):
        for stream in _in_parts(parts):
            done = entries.lifetimes(stream, hours * HOUR, renew)
            jobs.run(done, checkpoint, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    ended = v._spark.read.schema(done.schema).parquet(out)
    return ended.select(F.col("key").cast("bigint").alias("user_id"), *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("opened", "seen", "ended")), "n", "reason")


@query(LIFETIMES.format(ttl=12 * HOUR, renewed=f"t + {12 * HOUR}"))
def stm_06_lifetimes(v):
    return _lifetimes(v, 12, renew=True)


@query(LIFETIMES.format(ttl=48 * HOUR, renewed="due"))
def stm_06_fixed_lifetimes(v):
    return _lifetimes(v, 48, renew=False)


@query("SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn FROM conversations WHERE conv_id % 7 <> 3 GROUP BY conv_id")
def stm_08_thread_updates(v):
    """Turns arrive in three parts; threads that are archived get no row."""
    m = v.conversations.select("conv_id", "turn")
    archived = m.filter("conv_id % 7 = 3").select("conv_id").distinct()
    spark = v._spark
    schema = m.select("conv_id", F.col("turn").alias("last_turn"), F.lit(1).cast("long").alias("n_turns")).schema
    table = KeyedTable(spark, scratch.fresh(spark, "threads"), StructType.fromJson(schema.jsonValue()), ["conv_id"])
    checkpoint = scratch.fresh(spark, "checkpoint")
    for stream in _in_parts([m.filter("turn < 1"), m.filter("turn between 1 and 2"), m.filter("turn > 2")]):
        jobs.follow_threads(stream, archived, table, checkpoint)
    return table.rows().select("conv_id", "n_turns", "last_turn")


@query("""WITH k AS (SELECT id, source_entry, warrant_density, concat('unknown::', fingerprint) AS group_key FROM cards)
SELECT id, group_key, count(*) OVER (PARTITION BY group_key) AS variant_count, row_number() OVER (PARTITION BY group_key ORDER BY warrant_density DESC NULLS LAST, source_entry, id) = 1 AS is_canonical FROM k""", "cards")  # fmt: skip
def src_16_reelected_import(v):
    """Uncited cards arrive in three batches; cards with one text are a group, whose winner later batches can change."""
    c = C.derived(v.fx_cards.withColumn("cite", F.lit(""))).select("id", "doc_id", "source_entry", "warrant_density", "fingerprint", "group_key")
    schema = c.withColumns({"variant_count": F.lit(1).cast("long"), "is_canonical": F.lit(True)}).schema
    table = KeyedTable(v._spark, scratch.fresh(v._spark, "cards"), schema, ["group_key"])
    for n, part in enumerate(("doc_id % 3 = 1", "doc_id % 3 = 0", "doc_id % 3 = 2")):
        C.import_batch(table, c.filter(part), n, known_by="id")
    return table.rows().select("id", "group_key", "variant_count", "is_canonical")

"""Queries that run a stream over a table's files to its end, and archives that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import ratings as R
from lectern.plans.registry import query
from lectern.plans.tournament_queries import HISTORY_SQL, _matches, _shown
from lectern.sources import archive, scratch
from lectern.streaming import jobs


def _stream(v, df: DataFrame) -> DataFrame:
    """df as a stream of files."""
    path = scratch.fresh(v._spark, "files")
    df.write.parquet(path)
    return jobs.files(v._spark, path, df.schema)


def _ended(v, stream: DataFrame, mode: str) -> DataFrame:
    """The last state of a stream's output, kept by a table in the shared folder."""
    path = scratch.fresh(v._spark, "out")

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("append" if mode == "append" else "overwrite").parquet(path)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch.fresh(v._spark, "checkpoint")).trigger(availableNow=True).foreachBatch(batch).start()
    q.awaitTermination()
    return v._spark.read.schema(stream.schema).parquet(path)


@query("SELECT doc_id, sha1(text) AS fingerprint FROM documents")
def stm_01_ingest(v):
    docs = v.documents.select("doc_id", F.sha1(F.col("text").cast("binary")).alias("fingerprint"))
    out = scratch.fresh(v._spark, "ingested")
    jobs.ingest(_stream(v, docs), out, scratch.fresh(v._spark, "checkpoint"))
    return v._spark.read.parquet(out).select("doc_id", "fingerprint")


@query("SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+')) AS term FROM documents) x GROUP BY ALL")
def stm_02_index_upkeep(v):
    out = scratch.fresh(v._spark, "postings")
    jobs.keep_index(_stream(v, v.documents.select("doc_id", "text")), out, scratch.fresh(v._spark, "checkpoint"), ["text"])
    return jobs.latest_postings(v._spark, out).select("doc_id", "term", "tf")


@query("SELECT user_id, event_type AS kind, ts::DATE AS day, count(*) AS used FROM events GROUP BY ALL")
def stm_03_usage_by_day(v):
    e = v.events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _ended(v, jobs.usage_by_day(_stream(v, e), "365 days"), "complete")


@query("SELECT user_id, fingerprint FROM (SELECT DISTINCT CAST(conv_id % 50 AS VARCHAR) AS user_id, sha1(text) AS fingerprint FROM conversations WHERE role = 'user') x")
def stm_05_saves_once(v):
    s = v.conversations.filter("role = 'user'").select((F.col("conv_id") % 50).cast("string").alias("user_id"), F.sha1(F.col("text").cast("binary")).alias("fingerprint"), F.timestamp_seconds(F.col("conv_id") + 1_700_000_000).alias("ts"))
    return _ended(v, jobs.saves_once(_stream(v, s), ["user_id", "fingerprint"], "365 days"), "append").select("user_id", "fingerprint")


@query("SELECT user_id::BIGINT AS user_id, event_id::BIGINT AS event_id, strftime(ts, '%Y-%m') AS period, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) <= 5 AS admitted FROM events")
def stm_04_admission(v):
    """Five events of a user's month are admitted. The state needs RocksDB, for this query alone."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = v._spark.conf.get(provider)
    v._spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        e = v.events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
        return _ended(v, jobs.admit(_stream(v, e), 5), "append")
    finally:
        v._spark.conf.set(provider, before)


@query(HISTORY_SQL, "fx_ballots", "fx_entries", "fx_tournaments", "fx_events")
def stm_09_follow_ratings(v):
    """Matches arrive in three parts, in order of time; each goes on from the ratings that the ones before left."""
    m = _matches(v)
    files, out, checkpoint = scratch.fresh(v._spark, "files"), scratch.fresh(v._spark, "history"), scratch.fresh(v._spark, "checkpoint")
    for part in ("start_date < '1994-07-01'", "start_date >= '1994-07-01' and start_date < '1996-01-01'", "start_date >= '1996-01-01'"):
        m.filter(part).write.mode("append").parquet(files)
        jobs.follow_ratings(jobs.files(v._spark, files, m.schema, per_trigger=1_000_000), checkpoint, out)
    return _shown(v._spark.read.parquet(out).drop("batch"))


@query("SELECT DISTINCT entry FROM fx_paragraphs", "fx_paragraphs")
def src_01_archive_entries(v):
    return archive.entries(archive.as_archives(v.fx_paragraphs)).select("entry")


@query(r"SELECT entry, (row_number() OVER (PARTITION BY entry ORDER BY pos) - 1)::INT AS pos, style, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM fx_paragraphs", "fx_paragraphs")
def src_03_paragraphs(v):
    return archive.paragraphs(archive.as_archives(v.fx_paragraphs)).select("entry", "pos", "style", "text")


@query("SELECT doc_id, text FROM documents")
def src_19_resumable_import(v):
    out = scratch.fresh(v._spark, "imported")
    stream = _stream(v, v.documents.select("doc_id", "text", F.col("doc_id").alias("key")).repartition(4))
    jobs.ingest(stream, out, scratch.fresh(v._spark, "checkpoint"), "key")
    return v._spark.read.parquet(out).select("doc_id", "text")


@query("SELECT tourn_id, event_abbr, CASE bid_level WHEN 'Triples' THEN 1.0 WHEN 'Doubles' THEN 0.9 WHEN 'Octos' THEN 0.75 WHEN 'Quarters' THEN 0.6 WHEN 'Semis' THEN 0.45 WHEN 'Finals' THEN 0.3 ELSE 0.2 END::DOUBLE AS mult, CASE bid_level WHEN 'Triples' THEN 35 WHEN 'Doubles' THEN 45 WHEN 'Octos' THEN 60 WHEN 'Quarters' THEN 75 WHEN 'Semis' THEN 90 WHEN 'Finals' THEN 120 ELSE 60 END::DOUBLE AS base FROM fx_events", "fx_events")
def mth_02_k_tables(v):
    return v.fx_events.select("tourn_id", "event_abbr", R.k_mult(F.col("bid_level")).alias("mult"), R.k_base(F.lit("elim"), F.col("bid_level")).alias("base"))



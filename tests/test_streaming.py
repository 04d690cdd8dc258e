"""Streams over files must end where the batch operators end."""

from pyspark.sql import functions as F

from lectern.operators import activity, search
from lectern.streaming import jobs


def split(df, path, n=3):
    for k in range(n):
        df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == k).coalesce(1).write.mode("append").parquet(path)


def test_ingest_resumes_and_dedups(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    a = spark.createDataFrame([(n, f"f{n % 7}") for n in range(20)], "id int, fingerprint string")
    a.coalesce(1).write.parquet(src)
    jobs.ingest(jobs.files(spark, src, a.schema, 1), out, ck)
    a.unionByName(spark.createDataFrame([(99, "new")], a.schema)).coalesce(1).write.mode("append").parquet(src)
    jobs.ingest(jobs.files(spark, src, a.schema, 1), out, ck)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [*range(20), 99]


def test_index_keeps_the_latest_text(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    old = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id int, text string")
    old.coalesce(1).write.parquet(src)
    jobs.keep_index(jobs.files(spark, src, old.schema), out, ck, ["text"])
    spark.createDataFrame([(1, "delta")], old.schema).coalesce(1).write.mode("append").parquet(src)
    jobs.keep_index(jobs.files(spark, src, old.schema), out, ck, ["text"])
    assert {(r["doc_id"], r["term"]) for r in jobs.latest_postings(spark, out).collect()} == {(1, "delta"), (2, "gamma")}
    assert search.prefix_match(jobs.latest_postings(spark, out), "del").count() == 1


def memory(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_usage_threads_admission(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [(n, f"2024-0{1 + n % 2}-{1 + n % 27:02d} 10:00:00", n % 3, "click") for n in range(60)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    e.coalesce(1).write.parquet(src)
    stream = lambda: jobs.files(spark, src, e.schema)
    memory(jobs.usage_by_day(stream(), "90 days"), "usage", "complete", tmp_path)
    months = spark.table("usage").groupBy("user_id", "kind", F.date_format("day", "yyyy-MM").alias("period")).agg(F.sum("used").alias("used"))
    assert {tuple(r) for r in months.collect()} == {tuple(r) for r in activity.usage(e).select("user_id", "kind", "period", "used").collect()}
    memory(jobs.admit(stream(), 4), "admitted", "append", tmp_path)
    got = spark.table("admitted").toPandas()
    assert len(got) == 60 and (got[got["admitted"]].groupby(["user_id", "period"]).size() == 4).all()
    for _, g in got.merge(e.toPandas()[["event_id", "ts"]], on="event_id").groupby(["user_id", "period"]):
        assert g.sort_values(["ts", "event_id"])["admitted"].tolist() == [True] * 4 + [False] * (len(g) - 4)


def test_saves_once(spark, tmp_path):
    src = str(tmp_path / "saves")
    s = spark.createDataFrame([("u", "a", "2024-01-01 00:00:00"), ("u", "a", "2024-01-01 00:01:00"), ("u", "b", "2024-01-01 00:02:00"), ("v", "a", "2024-01-01 00:00:30")], "user_id string, fingerprint string, ts string").withColumn("ts", F.to_timestamp("ts"))
    s.coalesce(1).write.parquet(src)
    memory(jobs.saves_once(jobs.files(spark, src, s.schema), ["user_id", "fingerprint"]), "saves", "append", tmp_path)
    assert sorted((r["user_id"], r["fingerprint"]) for r in spark.table("saves").collect()) == [("u", "a"), ("u", "b"), ("v", "a")]
    memory(jobs.thread_activity(jobs.files(spark, src, s.schema).select(F.col("user_id").alias("conv_id"), F.length("fingerprint").alias("turn"))), "threads", "complete", tmp_path)
    assert spark.table("threads").count() == 2

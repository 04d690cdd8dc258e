"""Entries that expire, and keyed tables that batches rewrite in part."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import cards as C
from lectern.sources.keyed import KeyedTable
from lectern.streaming import entries, jobs


@pytest.fixture
def parts(spark, tmp_path):
    """Runs a job over files that arrive one after the other, and gives all that it wrote."""

    def run(make, frames, name="x", trigger={"availableNow": True}):
        src, out, ck = (str(tmp_path / f"{name}-{x}") for x in ("src", "out", "ck"))
        for frame in frames:
            frame.coalesce(1).write.mode("append").parquet(src)
            done = make(jobs.files(spark, src, frame.schema))
            write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
            done.writeStream.option("checkpointLocation", ck).outputMode("update" if "once" in trigger else "append").trigger(**trigger).foreachBatch(write).start().awaitTermination(100)
        return [tuple(r) for r in spark.read.schema(done.schema).parquet(out).select(*done.columns).collect()]

    return run


def events(spark, rows):
    df = spark.createDataFrame([(k, kind, at, n) for n, (k, kind, at) in enumerate(rows)], "key string, kind string, at long, n long")
    return df.select("key", "kind", F.timestamp_seconds(F.col("at")).alias("ts"), "n")


BATCHES = [
    [("a", "put", 10), ("b", "put", 11), ("c", "touch", 12), ("d", "put", 12), ("d", "drop", 13), ("d", "put", 14), ("d", "drop", 14)],
    [("a", "touch", 70), ("b", "drop", 72), ("b", "drop", 73), ("e", "put", 90)],  # a lives until 110 or 170
    [("a", "touch", 171), ("a", "put", 172), ("e", "touch", 190), ("e", "touch", 191)],  # e lives until 190, that moment included
    [("clock", "tick", 9000)],
    [("clock", "tick", 9001)],
]


@pytest.mark.parametrize(
    "renew, want",
    [
        (True, {("a", 10, 70, 170, 2, "expired"), ("b", 11, 11, 72, 1, "dropped"), ("d", 12, 12, 13, 1, "dropped"), ("d", 14, 14, 14, 1, "dropped"), ("a", 172, 172, 272, 1, "expired"), ("e", 90, 191, 291, 3, "expired")}),
        (False, {("a", 10, 70, 110, 2, "expired"), ("b", 11, 11, 72, 1, "dropped"), ("d", 12, 12, 13, 1, "dropped"), ("d", 14, 14, 14, 1, "dropped"), ("a", 172, 172, 272, 1, "expired"), ("e", 90, 190, 190, 2, "expired")}),
    ],
)
def test_entries_are_touched_expire_and_come_back(spark, parts, renew, want):
    got = parts(lambda s: entries.lifetimes(s, 100_000, renew), [events(spark, b) for b in BATCHES])
    assert sorted((k, int(o.timestamp()), int(s.timestamp()), int(e.timestamp()), n, why) for k, o, s, e, n, why in got) == sorted(want)


def test_one_batch_ends_as_many_do(spark, parts):
    whole = [events(spark, sum(BATCHES[:3], [])), *(events(spark, b) for b in BATCHES[3:])]
    many = parts(lambda s: entries.lifetimes(s, 100_000), [events(spark, b) for b in BATCHES], "many")
    one = parts(lambda s: entries.lifetimes(s, 100_000), whole, "one")
    assert sorted(many) == sorted(one)


def test_a_cache_forgets_by_the_clock(spark, parts):
    rows = lambda *r: spark.createDataFrame(r, "key string, seq long")

    def frames():
        yield rows(("a", 1), ("b", 2), ("a", 3))
        yield rows(("a", 4))
        time.sleep(21)
        yield rows(("a", 5), ("c", 6))

    got = {seq: held for _, seq, held in parts(lambda s: entries.held(s, 20_000), frames(), trigger={"once": True})}
    assert got[1] is False and got[2] is False and got[3] is True and got[5] is False and got[6] is False
    assert got[4] is True


def files_of(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_keyed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *r: spark.createDataFrame(r, "k string, v int")
    table = KeyedTable(spark, path, df(("x", 1)).schema, ["k"], buckets=16)
    assert table.rows().count() == 0 and table.newest() == {}
    table.upsert(df(*((f"k{n}", n) for n in range(200)), (None, 1)), 0)
    before = files_of(path)
    table.upsert(df(("k7", 70), ("new", 5), (None, 2)), 1)
    after = files_of(path)
    assert before.items() <= after.items()
    rows = {r["k"]: r["v"] for r in table.rows().filter("k is not null").collect()}
    assert rows == {f"k{n}": n for n in range(200)} | {"k7": 70, "new": 5}
    # only the buckets of the batch were written
    assert len({os.path.dirname(f) for f in after.keys() - before.keys()}) <= 3
    # a batch that is run again replaces itself; one that died before its log isn't seen
    table.upsert(df(("k7", 71)), 1)
    assert {r["v"] for r in table.rows().filter("k = 'k7'").collect()} == {71} and table.rows().filter("k = 'k8'").count() == 1
    df(("k9", 99)).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{path}/data/_version=2")
    assert table.rows().filter("k = 'k9'").collect()[0]["v"] == 9
    plan = table.rows(only=[3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1]


def card(id_, group, density, entry="f"):
    return (id_, f"{group}-{id_}", f"c::{group}" if group else "", density, entry)


def test_import_elects_touched_groups_anew(spark, tmp_path):
    path = str(tmp_path / "cards")
    new = lambda *r: spark.createDataFrame(r, "id string, fingerprint string, group_key string, warrant_density double, source_entry string")
    first = new(card("a", "g", 0.1), card("b", "h", 0.5), card("c", "", 0.0), *(card(f"o{n}", f"other{n}", 0.2) for n in range(60)))
    schema = first.withColumns({"variant_count": F.lit(1).cast("long"), "is_canonical": F.lit(True)}).schema
    table = KeyedTable(spark, path, schema, ["group_key"], buckets=32)
    C.import_batch(table, first, 0)
    before = files_of(path)
    # a is there already; d beats it; e joins h and loses; f is alone
    C.import_batch(table, new(card("a", "g", 0.9), card("d", "g", 0.4), card("e", "h", 0.2), card("f", "", 0.0)), 1)
    got = {r["id"]: (r["variant_count"], r["is_canonical"]) for r in table.rows().collect()}
    assert got["a"] == (2, False) and got["d"] == (2, True) and got["b"] == (2, True) and got["e"] == (2, False)
    assert got["c"] == (1, True) and got["f"] == (1, True) and len(got) == 66
    after = files_of(path)
    assert before.items() <= after.items() and len(after) - len(before) <= 4
    C.import_batch(table, new(card("a", "g", 0.9), card("d", "g", 0.4), card("e", "h", 0.2), card("f", "", 0.0)), 1)
    assert {r["id"]: (r["variant_count"], r["is_canonical"]) for r in table.rows().collect()} == got
    whole = C.elect_canonical(table.rows().select("id", "fingerprint", "group_key", "warrant_density", "source_entry"))
    assert {r["id"]: (r["variant_count"], r["is_canonical"]) for r in whole.collect()} == got


def test_threads_have_one_row_with_the_later_turn(spark, tmp_path):
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    df = lambda *r: spark.createDataFrame(r, "conv_id long, turn int")
    table = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "conv_id long, last_turn int, n_turns long").schema, ["conv_id"])
    archived = spark.createDataFrame([(3,)], "conv_id long")
    for part in (df((1, 0), (2, 0), (3, 0)), df((1, 1), (1, 2))):
        part.coalesce(1).write.mode("append").parquet(src)
        jobs.follow_threads(jobs.files(spark, src, part.schema), archived, table, ck)
    assert {tuple(r) for r in table.rows().collect()} == {(1, 2, 3), (2, 0, 1)}

"""The bodies that cuts are checked on are those of the SQL, short ones too."""

import duckdb

from lectern.plans.index_queries import FX_CUTS, FX_CUTS_SPARK


def test_short_texts_are_cut_as_in_the_sql(spark):
    letters = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJ"
    rows = [(4 * n + 3, letters[:n]) for n in (0, 1, 3, 5, 6, 8, 25, 28, 29, 30, 31, 46)]
    spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, body_plain string, body_markdown string").createOrReplaceTempView("fx_cards")
    got = {r["doc_id"]: r["body_markdown"] for r in spark.sql(f"WITH {FX_CUTS_SPARK} SELECT * FROM fx_cuts").collect()}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE fx_cards (doc_id BIGINT, body_plain VARCHAR, body_markdown VARCHAR)")
    duck.executemany("INSERT INTO fx_cards VALUES (?, ?, ?)", [(i, t, t) for i, t in rows])
    assert got == dict(duck.execute(f"WITH {FX_CUTS} SELECT doc_id, body_markdown FROM fx_cuts").fetchall())

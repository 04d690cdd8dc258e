"""Literal cases and invariants."""

import io
import os
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import dates, labels, text
from lectern.operators import activity, cards, entities, quality, ratings, search, tournaments
from lectern.plans.fixtures import Views
from lectern.sources import archive, classify, embedding, html, merge, results

SF = "/root/testdata/sf0.001"


def values(spark, column, rows, kind="string"):
    return [r["v"] for r in spark.createDataFrame([(n, x) for n, x in enumerate(rows)], f"n int, x {kind}").orderBy("n").select(column(F.col("x")).alias("v")).collect()]


def test_elo_values(spark):
    one = spark.range(1)

    def get(*cols):
        return tuple(round(float(x), 3) for x in one.select(*cols).first())

    e = lambda a, b: ratings.expected(F.lit(float(a)), F.lit(float(b)))
    assert get(e(1500, 1500), e(1900, 1500)) == (0.5, 0.909)
    k = lambda kind, depth, level: ratings.k_base(F.lit(kind), F.lit(depth)) * ratings.k_mult(F.lit(level))
    assert get(k("prelim", None, "Triples"), k("elim", "Finals", "Octos"), k("elim", "?", None)) == (20.0, 90.0, 12.0)
    d = lambda kind, k, won: ratings.deltas(F.lit(1500.0), F.lit(1500.0), F.lit(won), F.lit(kind), F.lit(k))
    assert get(*d("prelim", 15.0, True)) == (7.5, -7.5)
    assert get(*d("elim", 45.0, True)) == (22.5, 0.0)
    assert get(*d("elim", 81.0, False)) == (0.0, 40.5)


def test_majority_depth_and_season(spark):
    rows = [("WWL",), ("LLW",), ("W",), ("WL",), ("",)]
    n = lambda c: F.length("v") - F.length(F.replace(F.col("v"), F.lit(c), F.lit("")))
    assert [r[0] for r in spark.createDataFrame(rows, "v string").select(tournaments.majority(n("W"), n("L"))).collect()] == ["W", "L", "W", None, None]
    assert values(spark, lambda c: ratings.depth_of(F.lit("5"), c), [16, 8, 2, 7], "int") == ["Octos", "Quarters", "Finals", None]
    assert values(spark, lambda c: dates.season(c.cast("date")), ["2025-08-15", "2026-02-10", "2026-06-01", "2026-07-01"]) == ["2025-26", "2025-26", "2025-26", "2026-27"]


def test_text_forms(spark):
    assert values(spark, text.short_cite, ["Smith '24 [x]", "Smith 2024 says", "Smith 24", "Smith 6-13-2025", "smith 24", "De-Witt ’09", None]) == ["Smith '24", "Smith '24", "Smith '24", "Smith '25", "", "De-Witt '09", ""]
    assert values(spark, text.normal_place, ["3rd", "4", "11TH", "semifinalist", "QF", "prelim 4", "", "odd"]) == ["Semis", "4th", "11th", "Semis", "Quarters", "—", "", "odd"]
    assert values(spark, labels.normal_tag, ["1. the plan works", "A] foo bar", "T: limits good", "* bullet", "word , more", "foo -- bar", "2)"]) == ["The plan works", "Foo bar", "Limits good", "Bullet", "Word, more", "Foo— bar", "2)"]
    assert values(spark, text.title_case, ["o'neil-smith co"]) == ["O'Neil-Smith Co"]
    assert values(spark, text.fnv1a, ["", "a", "foobar"]) == ["811c9dc5", "e40c292c", "bf9cf968"]
    assert values(spark, lambda c: text.command(c)[0], ["/explain this", "/block", "no", "/ x"]) == ["explain", "block", None, None]
    assert values(spark, text.highlight_words, ["==a b== <u>c</u> d", "<u>a ==b== c</u>", None]) == [3, 3, 0]
    assert values(spark, text.highlight_words_nested, ["==a b== <u>c</u> d", "<u>a ==b== c</u>", None]) == [3, 4, 0]
    assert values(spark, lambda c: text.shorten_name(c, F.lit("Millard North")), ["Millard North Kyson Bloom", "Millard North SU", "Other AB"]) == ["Millard North KB", "Millard North SU", "Other AB"]
    assert values(spark, labels.argument_types, ["a kritik of capitalism", "the plan has solvency", "nothing"]) == [["kritik"], ["policy"], ["none"]]
    assert values(spark, lambda c: text.keyword_score("nuclear war", c), ["nuclear nuclear war", "peace", None]) == [19, 0, 0]


def test_limits_and_projects(spark):
    e = spark.createDataFrame([("u", "click", f"2024-01-0{d}", d) for d in range(1, 6)] + [("v", "click", "2024-01-01", 9)] * 3, "user_id string, event_type string, ts string, event_id int").withColumn("ts", F.to_timestamp("ts"))
    got = {r["user_id"]: (r["used"], r["remaining"], r["allowed"]) for r in activity.budget(activity.usage(e), 5).collect()}
    assert got == {"u": (5, 0, False), "v": (3, 2, True)}
    assert activity.keep_latest(e, 2).filter("user_id = 'u'").count() == 2


@pytest.fixture(scope="module")
def v(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    return Views(spark, SF)


def test_rating_history_invariants(spark, v):
    m = ratings.rated_matches(v.fx_ballots, v.fx_tournaments, v.fx_entries, v.fx_events).cache()
    h = ratings.history(m).toPandas().sort_values("seq")
    assert len(h) == 2 * m.count()
    for _, g in h.groupby(["season", "event_abbr", "team_key"]):
        before = [1500.0, *g["rating_after"][:-1]]
        assert max(abs(a - b) for a, b in zip(before, g["rating_before"])) < 1e-9
    pair = h.groupby(["season", "event_abbr", h["seq"] // 2]).agg(change=("change", "sum"), kind=("round_type", "first"))
    assert pair[pair["kind"] == "prelim"]["change"].abs().max() < 1e-9
    assert (h[(h["round_type"] == "elim") & (h["result"] == "L")]["change"] == 0).all()
    again = ratings.history(m.repartition(13)).toPandas().sort_values("seq")
    key = ["season", "event_abbr", "seq"]
    pd.testing.assert_frame_equal(h.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))
    cut = F.col("start_date") < "1995-03-01"
    early = ratings.history(m.filter(cut))
    both = early.unionByName(ratings.history(m.filter(~cut), ratings.ratings(early)))
    keyed = lambda df: sorted((r["season"], r["event_abbr"], r["round_id"], r["team_key"], round(r["rating_after"], 6)) for r in df.collect())
    assert keyed(both) == keyed(ratings.history(m))


def test_merged_pages_keep_sums(spark):
    rows = [("s", "LD", f"t{n}", f"School X {c}", "School X", 1600.0 - n, 12, 8, 4, 1650.0) for n, c in enumerate(["SUM", "SU", "SUX", "AB"])] + [("s", "LD", "z", "Other AB", "Other", 1500.0, 10, 5, 5, 1500.0)]
    r = spark.createDataFrame(rows, "season string, event_abbr string, team_key string, display_name string, school_name string, rating double, round_count long, wins long, losses long, peak_rating double")
    out = ratings.merge_pairs(ratings.all_pages(r)).orderBy("rank").toPandas()
    assert list(out["rank"]) == [1, 2, 3, 4] and list(out["code"]) == ["SUM", "SUX", "AB", "AB"]
    assert out["wins"].sum() == 8 * 4 + 5 and out["wins"].iloc[0] == 16


def test_windows_cover_and_overlap(v):
    sizes = {(r["doc_id"], r["pos"]): r["n"] for r in v.fx_paragraphs.select("doc_id", "pos", text.n_words(F.col("text")).alias("n")).collect()}
    w = search.windows(v.fx_paragraphs).toPandas()
    for doc, g in w.groupby("doc_id"):
        g = g.sort_values("window")
        pos = sorted(p for d, p in sizes if d == doc)
        assert g["first"].iloc[0] == pos[0] and g["last"].iloc[-1] == pos[-1]
        assert list(g["first"])[1:] == list(g["last"])[:-1]
        assert all(sum(sizes[doc, p] for p in pos if a <= p <= b) >= 400 for a, b in list(zip(g["first"], g["last"]))[:-1])


def test_entities_are_connected_and_keep_the_better_source(spark):
    rows = [(1, "http://a/x/", "One  title!", None, "Web"), (2, "http://a/x#frag", "Other", None, "OpenAlex"), (3, "http://b/y", "one title", None, "Web"), (4, "http://doi.org/10.1/q", "Q", None, "Web"), (5, "http://c", "R", "https://doi.org/10.1/Q", "Crossref"), (6, "", "S", None, "Web"), (7, "http://d", "alone", None, "Web")]
    got = {(r["cluster"], r["id"], r["n"]) for r in entities.resolve(spark.createDataFrame(rows, "page_id long, url string, title string, doi string, adapter string").repartition(3), "page_id").collect()}
    assert got == {(1, 2, 3), (4, 5, 2), (7, 7, 1)}


def test_knn_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = df.filter("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {}
    for r in search.knn(df, q, 5, "l2").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {i: list(np.argsort(((x - x[i]) ** 2).sum(1))[:5]) for i in range(3)}
    near = [r["vec_id"] for r in search.knn_lsh(df, list(map(float, x[0])), 5).collect()]
    assert 0 in near


def docx(paras):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr>' + "".join(f"<w:r><w:rPr>{f}</w:rPr><w:t>{t}</w:t></w:r>" for t, f in runs) + "</w:p>" for s, runs in paras)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_archive_to_cards(spark, tmp_path):
    paras = [("Heading4", [("Plan is good", "")]), ("", [("Smith '24", "")]), ("", [("marked words", '<w:u w:val="single"/><w:b/><w:highlight w:val="cyan"/>'), (" plain", "")]), ("", [("more", '<w:u w:val="single"/>')]), ("Heading4", [("No cite", "")]), ("", [("text", "")])]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("hs/School/Team/one.docx", docx(paras))
        z.writestr("hs/readme.txt", "no")
    a = archive.read_archives(spark, str(tmp_path))
    assert [(r["entry"]) for r in archive.entries(a).collect()] == ["hs/School/Team/one.docx"]
    p = archive.paragraphs(a)
    assert [r["markdown"] for r in p.orderBy("pos").collect()][2:4] == ["==**<u>marked words</u>**== plain", "<u>more</u>"]
    got = archive.cards_from_paragraphs(p).collect()
    assert [(r["tag"], r["cite"], r["body"]) for r in got] == [("Plan is good", "Smith '24", "marked words plain more")]
    assert archive.analytics_from_paragraphs(p, 3).collect()[0]["title"] == "Plan is good"


def test_html_results_and_classifier(spark):
    page = '<html><head><title>T &amp; U</title><meta property="og:site_name" content="S"><script type="application/ld+json">{"author": {"name": "Ann"}, "datePublished": "2024-01-02"}</script></head><body><nav>menu</nav><p>One</p><img src=x><div>Two</div><script>var t="</p>";</script></body></html>'
    a = html.read(page)
    assert (a["title"], a["author"], a["date"], a["source"], a["body"]) == ("T & U", "Ann", "2024-01-02", "S", "One\n\nTwo") and html.FIGURE in a["paragraphs"]
    raw = spark.createDataFrame([("Crossref", '{"URL": "u", "title": ["A"], "DOI": "10.1/x", "author": [{"given": "B", "family": "C"}]}'), ("Tavily", '{"url": "v", "title": "D", "content": "E", "score": 0.5}'), ("Exa", "not json")], "adapter string, raw string")
    assert {(r["url"], r["title"], r["author"], r["excerpt"]) for r in results.normalise(raw).collect()} == {("u", "A", "B C", None), ("v", "D", None, "E")}
    c = spark.createDataFrame([("1", "t", "b"), ("2", "boom", "b")], "id string, tag string, body_plain string")

    def model(f):
        if (f["tag"] == "boom").any():
            raise ValueError
        return f.assign(types=[["K ", "odd"]] * len(f), topics=[["X", "x", ""]] * len(f))

    out = classify.apply_classifier(c, classify.classify(c, model, lambda f: f.assign(types=[[]] * len(f), topics=[[]] * len(f)), batch=1))
    assert {(r["id"], tuple(r["argument_types"]), tuple(r["argument_tags"])) for r in out.collect()} == {("1", ("k",), ("x",)), ("2", ("none",), ())}
    vecs = embedding.embed(c, "tag").collect()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in vecs)


def test_merges(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    delta = spark.createDataFrame([(2, "B", None, 1), (2, "C", None, 2), (3, "D", "z", 1)], "k int, v string, w string, n int")
    assert {tuple(r) for r in merge.upsert(base, delta, ["k"], "n").collect()} == {(1, "a", "x"), (2, "C", None), (3, "D", "z")}
    assert {tuple(r) for r in merge.upsert_present(base, delta.filter("n = 1").drop("n"), ["k"]).collect()} == {(1, "a", "x"), (2, "B", "y"), (3, "D", "z")}
    path = str(tmp_path / "t")
    merge.write_slices(base, path, "k")
    merge.write_slices(base.filter("k = 2").withColumn("v", F.lit("new")), path, "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "new")}


def test_canonical_election_is_stable_and_partial(spark):
    rows = [(f"c{n}", f"g{n % 3}", [0.5, 0.9, 0.9][n % 3], "e" if n % 2 else "f") for n in range(12)]
    c = spark.createDataFrame(rows, "id string, group_key string, warrant_density double, source_entry string")
    a = {(r["id"], r["is_canonical"], r["variant_count"]) for r in cards.elect_canonical(c).collect()}
    assert a == {(r["id"], r["is_canonical"], r["variant_count"]) for r in cards.elect_canonical(c.repartition(5)).collect()}
    assert sum(x for _, x, _ in a) == 3
    done = cards.elect_canonical(c)
    again = cards.recanonicalise(done, spark.createDataFrame([("g1",)], "group_key string"))
    assert {(r["id"], r["is_canonical"]) for r in again.collect()} == {(i, x) for i, x, _ in a}


def test_pages_join_to_the_whole_order(v):
    c = v.cards.cache()
    whole = [r["id"] for r in c.orderBy(*cards.order("random", 123456789)).collect()]
    pages = [r["id"] for n in range(1, 7) for r in cards.page(c, cards.order("random", 123456789), n, 40).collect()]
    assert pages == whole and whole != [r["id"] for r in c.orderBy(*cards.order("random", 987654321)).collect()]


def test_snapping_and_cut_checks(spark):
    d = spark.createDataFrame([(1, "one two  three")], "doc_id int, text string")
    snap = lambda a, b: [(r["start"], r["stop"]) for r in quality.snap_spans(d, spark.createDataFrame([(1, a, b)], "doc_id int, start int, stop int")).collect()]
    assert snap(1, 5) == [(0, 7)] and snap(3, 4) == [] and snap(3, 6) == [(4, 7)] and snap(7, 10) == [(9, 14)] and snap(4, 8) == [(4, 7)]
    c = spark.createDataFrame([("a", "plain ==x y z a b c d== text", "plain x y z a b c d text"), ("b", "words that are not there", "other")], "id string, body_markdown string, source string")
    got = {r["id"]: r["issues"] for r in quality.validate_cut(c).collect()}
    assert got == {"a": ["long marked run", "marked too densely"], "b": ["not in source"]}


def test_uncited_cards_are_grouped_by_text_and_blank_keys_stand_alone(spark):
    rows = [("a", "", "same words", 0.1), ("b", None, "same words", 0.2), ("c", "", "other words", 0.3), ("d", "Smith '24", "same words", 0.4)]
    c = spark.createDataFrame([(i, t, cite, "t", t, t, "[]", "[]", "wiki", None, "open", "z", f"{i}.docx") for i, cite, t, _ in rows], "id string, body_plain string, cite string, tag string, body_markdown string, source string, argument_types string, argument_tags string, source_kind string, topic_bucket string, division string, zip_path string, source_entry string")
    got = {r["id"]: (r["group_key"].split("::")[0], r["variant_count"], r["is_canonical"]) for r in cards.stored(c).collect()}
    assert got == {"a": ("unknown", 2, True), "b": ("unknown", 2, False), "c": ("unknown", 1, True), "d": ("Smith '24", 1, True)}
    blank = spark.createDataFrame([(str(n), "", 0.1, "e") for n in range(5)], "id string, group_key string, warrant_density double, source_entry string")
    assert all(r["is_canonical"] and r["variant_count"] == 1 for r in cards.elect_canonical(blank).collect())


def test_long_chains_of_entities_are_one_cluster(spark):
    pairs = spark.createDataFrame([(n, f"k{n}") for n in range(70)] + [(n + 1, f"k{n}") for n in range(70)] + [(500, "alone")], "id long, key string")
    got = {r["id"]: r["cluster"] for r in entities.clusters(pairs).collect()}
    assert got == {n: 0 for n in range(71)} | {500: 500}


def test_knn_beyond_the_broadcast(spark):
    rows = [(n, [float(n % 7), float(n % 5), 1.0]) for n in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    few, many = (sorted(map(tuple, search.knn(v, q, 5, most=most).collect())) for most in (10_000, 6))
    assert few == many and len(few) == 100


def test_kept_index_reads_only_the_terms(spark, tmp_path):
    posts = search.postings(spark.createDataFrame([(1, "red fish blue fish"), (2, "one fish")], "doc_id long, text string"), ["text"])
    search.bucketed(posts).write.partitionBy("bucket").parquet(str(tmp_path / "index"))
    got = search.of_terms(spark.read.parquet(str(tmp_path / "index")), ["fish", "blue"])
    assert sorted((r["doc_id"], r["term"], r["tf"]) for r in got.collect()) == [(1, "blue", 1), (1, "fish", 2), (2, "fish", 1)]
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString()


def test_knn_by_blocks_is_that_of_pairs_on_odd_vectors(spark, monkeypatch):
    import random

    r, nan = random.Random(3), float("nan")
    rows = [(n, [r.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for n in range(90)]
    rows += [(90, None), (91, [1.0, None, 2.0]), (92, [nan, 1.0, 1.0]), (93, [0.0, 0.0, 0.0]), (94, [1.0]), (95, []), (96, [1e300, 1e300, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 9 < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = v.select(F.col("vec_id").alias("id"), "embedding").crossJoin(q).select("query_id", "id", F.round(search.cosine_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))
    want = search.list_rank(pairs, "distance", "id").filter("rank <= 7")
    monkeypatch.setattr(search, "BLOCK", 20)
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    got = search.knn(v, q, 7)
    shown = lambda df: sorted(map(str, df.select("query_id", "id", "distance", "rank").collect()))
    assert shown(got) == shown(want)
    assert "MapInArrow" in got._jdf.queryExecution().logical().toString()
    assert search.knn(v.limit(0), q, 7).count() == 0 and search.knn(v, q.limit(0), 7).count() == 0


def test_the_ranking_index_has_counts_only(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "One fish"), (2, "one fish")], "doc_id long, text string")
    got = search.bucketed(search.counts(docs, ["text"]))
    want = search.postings(docs, ["text"])
    assert sorted(map(tuple, got.select("doc_id", "field", "term", "tf").collect())) == sorted(map(tuple, want.select("doc_id", "field", "term", "tf").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "REBALANCE" in plan.upper()

"""What a task holds, and what is exchanged, doesn't grow faster than the tables."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import profiles, ratings, tournaments
from lectern.plans.fixtures import Views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_a_round_is_seated_without_a_join_and_is_what_the_sql_for_both_engines_says(spark):
    from lectern.plans import fixtures

    v = Views(spark, SF)
    v.lineitem.createOrReplaceTempView("lineitem")
    got, want = spark.sql(v._dealt("fx_ballots")), spark.sql(fixtures.FX_BALLOTS)
    assert "Join" not in plan(got) and plan(got).count("Exchange") == plan(got).count("REPARTITION_BY_NUM") == 2
    assert got.schema == want.schema and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_ratings_of_the_view_are_those_of_the_sql_for_both_engines(spark):
    from lectern.plans import fixtures

    got = Views(spark, SF).fx_ratings
    want = spark.sql(fixtures.FX_RATINGS)
    assert got.columns == want.columns and got.exceptAll(want.select(*(F.col(f.name).cast(f.dataType) for f in got.schema))).isEmpty() and got.count() == want.count()


def test_ballots_are_dealt_once(spark, monkeypatch):
    b = Views(spark, SF).fx_ballots
    assert plan(tournaments.records(b)).count("Exchange") == 1
    monkeypatch.setattr(tournaments, "TASK_ROWS", 100)
    assert tournaments.parts(b) > b.count() // 100


def test_names_of_a_round_are_gathered_once(spark):
    v = Views(spark, SF)
    found = plan(tournaments.bracket(v.fx_ballots, v.fx_entries))
    at = found.index("collect_list(")
    assert "Exchange" not in found[at : found.index("partial_collect_list(", at)]


def test_a_season_is_cut_into_blocks(spark):
    one = spark.range(1050).select(F.lit("s").alias("season"), F.lit("e").alias("event_abbr"), F.col("id").alias("first_ballot"), *(F.lit(1).alias(c) for c in ratings.CHRONOLOGICAL[:-1]))
    got = ratings.numbered(one, 100)
    assert sorted(r["count"] for r in got.groupBy("block").count().collect()) == [50] + [100] * 10
    assert got.filter("seq <> first_ballot or block <> seq div 100").isEmpty()


def test_users_of_one_code_get_its_first_entries_only(spark):
    links = spark.range(300).select(F.concat(F.lit("u"), "id").alias("user_id"), F.lit("A B").alias("team_code"))
    codes = spark.range(400).select((F.col("id") % 40).alias("tourn_id"), F.lit("n").alias("name"), F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias("start_date"), F.lit("2024-02-01").alias("end_date"), F.lit("A B").alias("team_code"), F.lit("A").alias("school_name"), F.lit("LD").alias("event_abbr"), F.col("id").alias("entry_id"))
    found = profiles.upcoming_of(links, codes.union(codes), "2024-01-01", 3)
    want = [tuple(r) for r in codes.orderBy("start_date", "tourn_id", "event_abbr", "team_code", "entry_id").limit(3).select("entry_id").collect()]
    assert found.count() == 900 and sorted(r[0] for r in found.filter("user_id = 'u7'").select("entry_id").collect()) == sorted(x for x, in want)
    assert plan(found).index("team_code#") >= 0 and plan(found).count("WindowGroupLimit") >= 2


def test_archives_are_made_many_at_a_time(spark):
    from lectern.sources import archive

    rows = [(f"d/{n}.docx", pos, "", f"text {n} & {pos}") for n in range(30) for pos in (1, 0)]
    made = archive.as_archives(spark.createDataFrame(rows, "entry string, pos int, style string, text string"))
    assert "InPandas" not in plan(made) and "MapInArrow" in plan(made)
    got = archive.paragraphs(made).select("entry", "pos", "style", "text").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_whole_cards_are_not_sorted_to_learn_their_winners(spark):
    """What is too large to be broadcast meets the table of winners by hash, so wide rows don't spill in a sort."""
    from lectern.operators import cards

    rows = [(f"c{n}", f"k{n % 7}" if n % 3 else "", n / 10, f"e{n % 4}", "body " * 50) for n in range(60)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        elected = cards.elect_canonical(spark.createDataFrame(rows, "id string, group_key string, warrant_density double, source_entry string, body string"))
        plan = elected._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: (r["variant_count"], r["is_canonical"]) for r in elected.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    groups = {}
    for i, key, density, entry, _ in rows:
        groups.setdefault(key or f"alone {i}", []).append((-density, entry, i))
    assert got == {i: (len(g), i == min(g)[2]) for g in groups.values() for _, _, i in g}


def test_names_and_codes_meet_by_equality_once_each(spark):
    """Of 300 entries with 5 names and 300 teams with 5 codes of one school, no pair of an entry and a team is made."""
    entry = "tourn_id int, event_abbr string, entry_id int, school_name string, display_name string"
    entries = spark.createDataFrame([(1, "LD", n, "Elm", f"Elm Hill A{n % 5}") for n in range(300)], entry)
    teams = spark.createDataFrame([(n, "ELM", f"a{n % 5}") for n in range(300)], "id int, school string, code string")
    linked = tournaments.linked_team(entries, teams)
    assert {(r["display_name"], r["wiki_team_id"]) for r in linked.collect()} == {(f"Elm Hill A{k}", k) for k in range(5)}
    assert linked.count() == 300 and linked.columns == [*entries.columns, "wiki_team_id"] and "contains(" not in plan(linked).lower()


def test_codes_are_runs_of_a_name_as_in_the_sql(spark):
    names = [None, "", " ", "A", "A B", "a b c", "A  B", " A", "B ", "AB C", "A-B", "É A", "x A B C y", "A A", "B C A"]
    codes = [None, "", " ", "a", "A B", "b c", "a  b", "ab", "c a", "É", "a b c", "-"]
    entries = spark.createDataFrame([(1, "LD", n, school, name) for n, (school, name) in enumerate((s, x) for s in ("S", "t", None) for x in names)], "tourn_id int, event_abbr string, entry_id int, school_name string, display_name string")
    teams = spark.createDataFrame([(7 * n % 23, school, code) for n, (school, code) in enumerate((s, x) for s in ("s", "T") for x in codes)], "id int, school string, code string")
    got = {r["entry_id"]: r["wiki_team_id"] for r in tournaments.linked_team(entries.repartition(3), teams).collect()}
    fits = lambda e, t: None not in (e[3], e[4], t[1], t[2]) and e[3].lower() == t[1].lower() and f" {t[2].lower()} " in f" {e[4].lower()} "
    rows = teams.collect()
    assert got == {e[2]: min((t[0] for t in rows if fits(e, t)), default=None) for e in entries.collect()}
    assert [r["wiki_team_id"] for r in tournaments.linked_team(entries.limit(2), teams.limit(0)).collect()] == [None, None]


@pytest.mark.parametrize("name", ["sea_05_keyword_page", "sea_11_hybrid"])
def test_a_search_writes_less_than_it_reads(spark, monkeypatch, tmp_path, name):
    """Neither the bodies of the cards nor an index of all terms."""
    from lectern.plans import fixtures
    from lectern.plans.all_queries import QUERIES
    from lectern.sources import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(fixtures, "_KEPT", {})
    assert QUERIES[name](spark, SF).count() > 0
    size = lambda path: sum(p.stat().st_size for p in path.rglob("*.parquet") if p.is_file())
    assert 0 < size(tmp_path) < (tmp_path.__class__(SF) / "documents.parquet").stat().st_size


def test_terms_are_found_in_the_texts_as_in_the_index(spark):
    from lectern.operators import search

    docs = spark.createDataFrame([(1, "Fish, fish & chips", "blue"), (2, None, "Blué FISH"), (3, "", None), (4, "chips", "x fish-fish")], "doc_id long, a string, b string")
    found, sizes = search.searched(docs, ["a", "b"], ["fish", "blue"])
    rows = lambda df: sorted(map(tuple, df.collect()))
    in_index = search.counts(docs, ["a", "b"]).filter("term in ('fish', 'blue')").groupBy("doc_id", "term").agg(F.sum("tf"))
    assert rows(found.groupBy("doc_id", "term").agg(F.sum("tf"))) == rows(in_index) and rows(in_index)
    assert rows(sizes) == rows(search.lengths(docs, ["a", "b"]))


def test_listed_cards_are_the_stored_ones_without_bodies(spark):
    from lectern.operators import cards

    v = Views(spark, SF)
    whole, listed = v.cards.drop("body_markdown", "body_plain"), cards.listed(v.fx_cards)
    assert listed.dtypes == whole.dtypes and listed.exceptAll(whole).isEmpty() and whole.exceptAll(listed).isEmpty()

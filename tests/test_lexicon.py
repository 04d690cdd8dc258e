"""Indexes in order of their terms read only what a search needs; owners' searches keep apart."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import lexicon as L
from lectern.operators import quality


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "xyz"]
    docs = [(n, f"{words[n]} {words[(n * 7) % 120]} common Élan") for n in range(120)] + [(500, None), (501, ""), (502, "common")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return docs, L.Lexicon(spark, str(tmp_path_factory.mktemp("lexicon") / "x")).write(df, ["text"], 12)


def holding(docs, prefixes):
    return {i for i, t in docs if all(any(w.startswith(p) for w in (t or "").lower().replace("é", "e").split()) for p in prefixes)}


def test_prefixes_of_many_queries(index):
    docs, lex = index
    queries = {1: "a", 2: "ba com", 3: "gux", 4: "none", 5: "ELAN hi"}
    got = lex.matching({i: L.prefix_tokens(q) if i != 2 else [("ba", True), ("com", True)] for i, q in queries.items()} | {1: [("a", True)]}).collect()
    for i, prefixes in ((1, ["a"]), (2, ["ba", "com"]), (3, ["gux"]), (4, ["none"]), (5, ["elan", "hi"])):
        assert {r["doc_id"] for r in got if r["query_id"] == i} == holding(docs, prefixes)
    assert lex.matching({}).count() == 0


def test_only_parts_of_the_range_are_read(index):
    _, lex = index
    posts = lex.postings(set(), {"ga"})
    assert 1 <= len(lex.parts(set(), {"ga"})) <= 3 and lex.parts({"zzz"}, set()) == []
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_part" in plan.split("PartitionFilters")[1]
    read = lambda df: df.select(F.input_file_name()).distinct().count()
    assert 1 <= read(posts) <= 3 and read(lex._postings()) == 12
    # "common" is in every document and may lie in several parts, all of which are found
    assert lex.postings({"common"}).filter("term = 'common'").count() == 121


def test_a_shuffle_gives_the_same(index, monkeypatch):
    _, lex = index
    queries = {n: [(p, n % 2 == 0)] for n, p in enumerate(["common", "co", "abx", "elan"])}
    want = sorted(map(tuple, lex.matching(queries).collect()))
    monkeypatch.setattr(L, "SMALL", 0)
    assert sorted(map(tuple, lex.matching(queries).collect())) == want and want


@pytest.fixture(scope="module")
def teams(spark):
    rows = [(1, "Lake High", "AB", "Lake High AB"), (2, "Lake High", "CD", "Lake High CD"), (3, "Lakeside Prep", "AB", "Lakeside Prep AB"), (4, "North", "LK", "North LK"), (5, None, None, None), (6, "St. Mary-Ann", "QQ", "St. Mary-Ann QQ")]
    return spark.createDataFrame(rows, "id long, school string, code string, full_name string")


def test_team_search(spark, teams, tmp_path):
    index = L.Lexicon(spark, str(tmp_path / "teams"), "id").write(teams, ["school", "code", "full_name"], 3)
    queries = {1: "lake", 2: "lake a", 3: "lak hi", 4: "", 5: "'\"", 6: "lake h", 7: "mary-a", 8: "ab lake", 9: "???"}
    got = {}
    for r in sorted(L.team_search(index, teams, queries, 3).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    assert set(got[1]) == {1, 2, 3} and got[2] == [1] and 3 not in got and got[4] == got[5] == got[9] == [5, 1, 2]
    assert set(got[6]) == {1, 2} and got[7] == [6] and set(got[8]) == {1, 3}


def test_owners_keep_apart(spark, tmp_path):
    docs = [("u", 1, "red apple"), ("u", 2, "green apple apple"), ("v", 1, "red brick"), ("v", 3, "apple " * 9), ("w", 4, None), (None, 5, "red")]
    index = L.ScopedIndex(spark, str(tmp_path / "own"), "owner", "id", 8).write(spark.createDataFrame(docs, "owner string, id long, text string"), "text")
    got = {(r["query_id"], r["owner"], r["id"]) for r in index.search({1: ("u", "Apple red"), 2: ("v", "red"), 3: ("w", "red"), 4: ("x", "red")}).collect()}
    assert got == {(1, "u", 1), (1, "u", 2), (2, "v", 1)}
    # a document of another owner changes nothing of an owner's scores
    more = L.ScopedIndex(spark, str(tmp_path / "more"), "owner", "id", 8).write(spark.createDataFrame([*docs, ("v", 9, "apple red")], "owner string, id long, text string"), "text")
    ask = {1: ("u", "Apple red")}
    assert sorted(map(tuple, index.search(ask).collect())) == sorted(map(tuple, more.search(ask).collect()))
    plan = index.of("postings", ["u"])._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan.split("PartitionFilters")[1]


SOURCE = "One two three four five six seven eight nine ten.\n\nSecond “paragraph” — here it is.\n\n[FIGURE OMITTED]"
CUTS = {
    "whole": ("One two three four five six seven eight nine ten.\n \nsecond \"paragraph\" - here it is.", []),
    "dense": ("<u>==One two three four==</u> five six seven eight nine ten.", [(1, "highlighted too densely")]),
    "lines": ("<u>One two three four five six seven eight</u> nine ten.", [(1, "underlined too densely")]),
    "run": ("<u>One ==two three four five six seven== eight</u> nine ten.", [(1, "highlighted too densely"), (1, "long highlight"), (1, "underlined too densely")]),
    "light": ("One ==two== three four <U>five</U> six seven eight nine ten.", [(1, "highlight outside underline")]),
    "bold": ("One **two** three <u>**four**</u> five six seven eight nine ten.", [(1, "bold outside underline")]),
    "inside": ("<u>One t==wo== th**re**e</u> four five six seven eight nine ten.", []),
    "trimmed": ("two three four five six\n\n\nSecond “paragraph” — here it is.", [(1, "trimmed")]),
    "joined": ("nine ten.\n\nnine ten. Second paragraph", [(1, "trimmed"), (2, "not verbatim")]),
    "empty": ("", []), "null": (None, []), "marks": ("== **\n\n[FIGURE OMITTED]", []),
}


def test_cut_issues(spark):
    cards = spark.createDataFrame([(k, body, SOURCE) for k, (body, _) in CUTS.items()], "id string, body_markdown string, source string")
    got = {}
    for r in quality.cut_issues(cards).collect():
        got.setdefault(r["id"], []).append((r["paragraph"], r["issue"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: want for k, (_, want) in CUTS.items() if want}
    # tighter modes find more, and without a source nothing is compared with it
    lines = spark.createDataFrame([("x", "<u>One two three four five</u> six seven eight nine ten.", None)], cards.schema)
    assert quality.cut_issues(lines).count() == 0 and [r["value"] for r in quality.cut_issues(lines, "minimal").collect()] == [0.5]
    assert quality.cut_issues(cards.limit(0)).count() == 0

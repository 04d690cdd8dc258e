"""Ratings by groups of teams and levels of matches are those of a fold one match at a time; components of any shape."""

import random

import pandas as pd
import pytest

from lectern.operators import ratings as R
from lectern.operators.components import components

MATCHES = "season string, event_abbr string, a_key string, b_key string, a_result string, k double, round_type string, start_date string, late int, round_no long, round_name string, tourn_id int, round_id int, first_ballot long"


def plain(rows, held=None):
    """One match after the other."""
    held, out, seq = dict(held or {}), [], {}
    for r in sorted(rows, key=lambda r: r[7:14]):
        season, event, a, b, result, k, kind = r[:7]
        n = seq[season, event] = seq.get((season, event), -1) + 1
        ra, rb, won = held.get((season, event, a), 1500.0), held.get((season, event, b), 1500.0), result == "W"
        p = 1 / (1 + 10 ** ((rb - ra) / 400))
        da, db = k * (won - p), k * ((not won) - (1 - p))
        if kind == "elim":
            da, db = (da, 0.0) if won else (0.0, db)
        held[season, event, a], held[season, event, b] = ra + da, rb + db
        out.append((season, event, 2 * n, a, "W" if won else "L", ra, ra + da, da, b, rb))
        out.append((season, event, 2 * n + 1, b, "L" if won else "W", rb, rb + db, db, a, ra))
    return out


def season(seed, n, teams, event="LD", name="2024-25", begin=0):
    r, out = random.Random(seed), []
    for i in range(begin, begin + n):
        group = r.randrange(teams // 10)
        a, b = r.sample(range(10), 2)
        kind = r.choice(["prelim", "elim"])
        out.append((name, event, f"{group}-{a}", f"{group}-{b}", r.choice("WL"), r.choice([4.0, 20.0, 54.0]), kind, f"2024-{1 + i * 12 // (begin + n):02d}-01", int(kind == "elim"), 1 + i % 6, f"R{i % 6}", i % 50, i // 7, i))
    return out


def shown(df):
    cols = ["season", "event_abbr", "seq", "team_key", "result", "rating_before", "rating_after", "change", "opponent_key", "opponent_rating"]
    return sorted(map(tuple, df.select(*cols).collect()))


@pytest.mark.parametrize("whole", [0, 500, R.WHOLE])
def test_history_is_that_of_a_plain_fold(spark, whole):
    rows = season(1, 900, 60) + season(2, 300, 10, "PF") + season(3, 40, 30, "CX")
    df = spark.createDataFrame(rows, MATCHES).repartition(5)
    assert shown(R.history(df, whole=whole)) == sorted(plain(rows))
    assert R.history(df.limit(0), whole=whole).count() == 0


@pytest.mark.parametrize("whole", [0, R.WHOLE])
def test_history_goes_on_from_ratings(spark, whole):
    rows, more = season(4, 400, 40), season(5, 200, 60, begin=5000)
    early = R.history(spark.createDataFrame(rows, MATCHES), whole=whole)
    held = {(s, e, t): x for s, e, _, t, _, _, x, *_ in plain(rows)}
    got = R.history(spark.createDataFrame(more, MATCHES), R.ratings(early), whole=whole)
    assert shown(got) == sorted(plain(more, held))


def test_a_hundred_thousand_matches_of_one_group():
    """The largest unit that one task folds, as a frame in this process."""
    r = random.Random(6)
    n, teams = 100_000, 2_000
    rows = [("s", "e", *map(str, r.sample(range(teams), 2)), r.choice("WL"), 20.0, "prelim", "d", 0, 1, "R", 1, 1, i) for i in range(n)]
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in MATCHES.split(", ")]).assign(seq=range(n))
    got = R._fold(pdf.sample(frac=1, random_state=1), {})
    cols = ["season", "event_abbr", "seq", "team_key", "result", "rating_before", "rating_after", "change", "opponent_key", "opponent_rating"]
    assert list(got[cols].itertuples(index=False, name=None)) == plain(rows)
    level = R._levels(*(pd.factorize(pd.concat([pdf["a_key"], pdf["b_key"]]))[0].reshape(2, -1).tolist()), teams)
    assert level.max() < n / 200  # some hundred matches a step


def test_components(spark):
    edges = [(f"p{n:03d}", f"p{n + 1:03d}") for n in range(120)] + [("hub", f"x{n}") for n in range(300)] + [("a", "a"), ("b", "c"), ("c", "b"), (None, "b"), ("q", None)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a string, b string").repartition(3)).collect()))
    assert {got[f"p{n:03d}"] for n in range(121)} == {"p000"} and {got[f"x{n}"] for n in range(300)} | {got["hub"]} == {"hub"}
    assert got["b"] == got["c"] == "b" and "a" not in got and len(got) == 121 + 301 + 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

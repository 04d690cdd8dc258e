"""Chronological Elo ratings, leaderboards and profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import tournaments as T
from lectern.sources.scratch import written

START = 1500.0
MIN_ROUNDS = 10
PAGE = 50
#: Fixed values.
K_BASE = {"Triples": 35.0, "Doubles": 45.0, "Octos": 60.0, "Quarters": 75.0, "Semis": 90.0, "Finals": 120.0}
K_MULT = {"Triples": 1.0, "Doubles": 0.9, "Octos": 0.75, "Quarters": 0.6, "Semis": 0.45, "Finals": 0.3}


def expected(a: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (b - a) / 400.0))


def k_base(round_type: Column, depth: Column) -> Column:
    return F.when(round_type == "elim", F.coalesce(text.lookup(K_BASE, depth), F.lit(60.0))).otherwise(20.0)


def k_mult(bid_level: Column) -> Column:
    return F.coalesce(text.lookup(K_MULT, bid_level), F.lit(0.2))


def deltas(a: Column, b: Column, a_won: Column, round_type: Column, k: Column) -> tuple[Column, Column]:
    """Changes of both ratings; who loses in the bracket loses nothing."""
    raw_a = k * (F.when(a_won, 1.0).otherwise(0.0) - expected(a, b))
    raw_b = k * (F.when(a_won, 0.0).otherwise(1.0) - (F.lit(1.0) - expected(a, b)))
    elim = round_type == "elim"
    return F.when(elim & ~a_won, 0.0).otherwise(raw_a), F.when(elim & a_won, 0.0).otherwise(raw_b)


def depth_of(round_name: Column, n_entries: Column) -> Column:
    return F.when(round_name.isin(*K_BASE), round_name).otherwise(text.lookup(T.RATED_DEPTH_OF_ENTRIES, n_entries.cast("string")))


def rated_matches(ballots: DataFrame, tournaments: DataFrame, entries: DataFrame, events: DataFrame, kinds: tuple[str, ...] = ("LD", "PF", "CX")) -> DataFrame:
    """Decided matches with season, team keys, K factor and the fields that order them."""
    known = ballots.filter(F.col("event_abbr").isin(*kinds)).join(entries.select("tourn_id", "entry_id").distinct(), ["tourn_id", "entry_id"], "left_semi")
    m = T.matches(known, T.parts(ballots))
    n = known.select(*T.ROUND, "entry_id").distinct().groupBy(*T.ROUND).agg(F.count("*").alias("n_entries"))
    team = entries.select("tourn_id", "entry_id", "team_key").distinct()
    m = m.join(n, T.ROUND).join(tournaments.select("tourn_id", "season", "start_date"), "tourn_id").join(events.select("tourn_id", "event_abbr", "bid_level"), ["tourn_id", "event_abbr"], "left")
    m = m.join(team.select("tourn_id", F.col("entry_id").alias("a"), F.col("team_key").alias("a_key")), ["tourn_id", "a"]).join(team.select("tourn_id", F.col("entry_id").alias("b"), F.col("team_key").alias("b_key")), ["tourn_id", "b"])
    name_no = F.when(F.col("round_name").rlike("^[0-9]"), T.number_in(F.col("round_name"))).otherwise(9999)
    depth = F.when(F.col("round_type") == "elim", depth_of(F.col("round_name"), F.col("n_entries")))
    return m.withColumns({"depth": depth, "k": k_base(F.col("round_type"), depth) * k_mult(F.col("bid_level")), "late": (F.col("round_type") != "prelim").cast("int"), "round_no": name_no.cast("bigint")})


CHRONOLOGICAL = ["start_date", "late", "round_no", "round_name", "tourn_id", "round_id", "first_ballot"]
HISTORY = "season string, event_abbr string, seq long, team_key string, tourn_id int, round_id int, round_name string, round_type string, result string, rating_before double, rating_after double, change double, opponent_key string, opponent_rating double, occurred_at string"


#: A season of an event of more matches than that is folded in blocks of so many.
WHOLE = 100_000
#: A block has no fewer.
LEAST = 100


def _levels(a: list[int], b: list[int], n: int) -> np.ndarray:
    """A match's level is one more than the larger level of its two teams' matches before."""
    last, out = [0] * n, []
    for x, y in zip(a, b):
        level = max(last[x], last[y]) + 1
        last[x] = last[y] = level
        out.append(level)
    return np.array(out, np.int64)


def _fold(pdf: pd.DataFrame, held: dict[str, float]) -> pd.DataFrame:
    """The history of matches in order of seq. Matches of one level have no team in common, and are one step."""
    f = pdf.sort_values("seq", kind="stable").reset_index(drop=True)
    m = len(f)
    codes, teams = pd.factorize(pd.concat([f["a_key"], f["b_key"]]))
    a, b = codes[:m], codes[m:]
    rating = np.array([held.get(t, START) for t in teams], np.float64)
    won, elim, k = (f["a_result"] == "W").to_numpy(), (f["round_type"] == "elim").to_numpy(), f["k"].to_numpy(np.float64)
    before, after, change = (np.empty((m, 2)) for _ in range(3))
    level = _levels(a.tolist(), b.tolist(), len(teams))
    order = np.argsort(level, kind="stable")
    for now in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        ra, rb = rating[a[now]], rating[b[now]]
        # powers one by one: a vector's may differ from them in the last bit
        p = 1 / (1 + np.array([10.0**x for x in ((rb - ra) / 400).tolist()]))
        da, db = k[now] * (won[now] - p), k[now] * (~won[now] - (1 - p))
        da, db = np.where(elim[now] & ~won[now], 0.0, da), np.where(elim[now] & won[now], 0.0, db)
        rating[a[now]] = ra + da
        rating[b[now]] = rb + db
        before[now], after[now], change[now] = np.stack([ra, rb], 1), np.stack([ra + da, rb + db], 1), np.stack([da, db], 1)
    both = lambda x, y: np.stack([np.asarray(x, object), np.asarray(y, object)], 1).ravel()
    twice = {c: np.repeat(f[c].to_numpy(), 2) for c in ("season", "event_abbr", "tourn_id", "round_id", "round_name", "round_type")}
    seq = np.stack([2 * f["seq"], 2 * f["seq"] + 1], 1).ravel()
    letters = np.where(won, "W", "L"), np.where(won, "L", "W")
    return pd.DataFrame(twice | {
        "seq": seq, "team_key": both(f["a_key"], f["b_key"]), "result": both(*letters), "rating_before": before.ravel(), "rating_after": after.ravel(), "change": change.ravel(),
        "opponent_key": both(f["b_key"], f["a_key"]), "opponent_rating": before[:, ::-1].ravel(), "occurred_at": np.repeat(f["start_date"].to_numpy(), 2),
    })[[c.split()[0] for c in HISTORY.split(", ")]]


UNIT = ["season", "event_abbr"]


def numbered(matches: DataFrame, size: int) -> DataFrame:
    """matches with seq, their places from 0 in the order of their season and event, and their block of so many; written by block.

    They are sorted in ranges, and a range begins where the counts of those before it end, so no season is sorted in one task.
    """
    dealt = written(matches.repartitionByRange(*UNIT, *CHRONOLOGICAL).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*UNIT, "_range").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy(*UNIT).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy(*UNIT, "_range").orderBy(*CHRONOLOGICAL))
    placed = dealt.withColumn("_nth", nth).join(sizes.select(*UNIT, "_range", first.alias("_first")), [*UNIT, "_range"])
    placed = placed.withColumn("seq", F.col("_first") + F.col("_nth") - 1).withColumn("block", F.floor(F.col("seq") / size).cast("int"))
    return written(placed.drop("_first", "_nth", "_range"), "numbered", "block")


def history(matches: DataFrame, seed: DataFrame | None = None, whole: int = WHOLE) -> DataFrame:
    """Two rows for each match with the ratings before and after, folded in order within (season, event); written.

    Ratings couple all who met, and a season's teams are soon one group of those that met. So a season of an event is folded in
    blocks of at most `whole` matches (LEAST, if that is more), in order: each goes on from the ratings that the blocks before
    left to its own teams. All seasons' blocks of one number are one job, and no task holds more than a block and its teams.
    seed: (season, event_abbr, team_key, rating) to go on from.
    """
    cols = [*UNIT, "a_key", "b_key", "a_result", "k", "round_type", *CHRONOLOGICAL]
    m = numbered(matches.select(*cols), max(whole, LEAST))
    n_blocks = (m.agg(F.max("block")).first()[0] or 0) + 1
    held, out = None if seed is None else seed.select(*UNIT, "team_key", "rating"), None
    for n in range(n_blocks):
        now = m.filter(F.col("block") == n).drop("block")
        if held is None:
            folded = now.groupBy(*UNIT).applyInPandas(lambda pdf: _fold(pdf, {}), HISTORY)
        else:
            teams = now.select(*UNIT, F.explode(F.array("a_key", "b_key")).alias("team_key")).distinct()
            folded = now.groupBy(*UNIT).cogroup(held.join(teams, [*UNIT, "team_key"], "left_semi").groupBy(*UNIT)).applyInPandas(_go_on, HISTORY)
        folded = written(folded, "history")
        out = folded if out is None else out.unionByName(folded)
        if n + 1 < n_blocks:
            last = folded.groupBy(*UNIT, "team_key").agg(F.max_by("rating_after", "seq").alias("rating"))
            held = written(last if held is None else held.join(last, [*UNIT, "team_key"], "left_anti").unionByName(last), "held")
    return out


def _go_on(pdf: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    return _fold(pdf, dict(zip(old["team_key"], old["rating"])))


def ratings(history: DataFrame) -> DataFrame:
    """The table of ratings from a history."""
    return history.groupBy("season", "event_abbr", "team_key").agg(
        F.max_by("rating_after", "seq").alias("rating"), F.count("*").alias("round_count"), F.count_if(F.col("result") == "W").alias("wins"), F.count_if(F.col("result") == "L").alias("losses"), F.greatest(F.max("rating_after"), F.lit(START)).alias("peak_rating")
    )


def with_peak(history: DataFrame) -> DataFrame:
    w = Window.partitionBy("season", "event_abbr", "team_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("peak", F.greatest(F.max("rating_after").over(w), F.lit(START)))


BOARD = ["season", "event_abbr"]


def board(ratings: DataFrame, least: int = MIN_ROUNDS) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*BOARD).orderBy(F.desc("rating"), "team_key"))
    return ratings.filter(F.col("round_count") >= least).withColumn("board_rank", n)


def competition_rank(ratings: DataFrame, least: int = MIN_ROUNDS) -> DataFrame:
    """1 + how many of the board are rated higher, also for teams below the floor; and the board's size.

    Teams of one board are counted by a running sum over distinct ratings, not by pairs.
    """
    on = ratings.groupBy(*BOARD, "rating").agg(F.count_if(F.col("round_count") >= least).alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy(*BOARD).orderBy(F.desc("rating")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = on.withColumn("competition_rank", above + 1).withColumn("out_of", F.sum("n").over(Window.partitionBy(*BOARD))).drop("n")
    return ratings.join(counted, [*BOARD, "rating"])


def leaderboard(ratings: DataFrame, season: str, event: str, page: int = 1, query: str = "", sort: str = "rating") -> DataFrame:
    """One page of the board; names are looked for after ranking."""
    rows = board(ratings.filter((F.col("season") == season) & (F.col("event_abbr") == event)))
    q = query.strip().lower()
    rows = rows.filter(F.lower("display_name").contains(q) | F.lower("school_name").contains(q)) if q else rows
    orders = {"wins": [F.desc("wins")], "peak": [F.desc("peak_rating")], "rounds": [F.desc("round_count")]}.get(sort, [])
    return rows.orderBy(*orders, "board_rank").offset((page - 1) * PAGE).limit(PAGE)


def merge_pairs(page: DataFrame) -> DataFrame:
    """Rows of a page of one school whose trailing codes begin alike become one, in the page's order.

    The fold is greedy and not transitive, and a page is at most PAGE rows of (season, event_abbr, page).
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("board_rank").to_dict("records")
        out, used = [], set()
        for i, a in enumerate(rows):
            if i in used:
                continue
            for j in range(i + 1, len(rows)):
                b = rows[j]
                if j in used or not a["school_name"] or b["school_name"] != a["school_name"] or not a["code"] or not b["code"]:
                    continue
                if a["code"].startswith(b["code"]) or b["code"].startswith(a["code"]):
                    for c in ("wins", "losses", "round_count"):
                        a[c] += b[c]
                    a["peak_rating"] = max(a["peak_rating"], b["peak_rating"])
                    used.add(j)
            out.append(a)
        return pd.DataFrame([{**a, "rank": (a["page"] - 1) * PAGE + n + 1} for n, a in enumerate(out)])

    kept = page.withColumn("code", text.code_of(F.col("display_name"))).select("season", "event_abbr", "page", "board_rank", "team_key", "display_name", "school_name", "code", "rating", "wins", "losses", "round_count", "peak_rating")
    kept = kept.withColumns({c: F.col(c).cast("bigint") for c in ("page", "board_rank", "wins", "losses", "round_count")}).withColumns({c: F.col(c).cast("double") for c in ("rating", "peak_rating")})
    return kept.groupBy("season", "event_abbr", "page").applyInPandas(fold, "season string, event_abbr string, page long, board_rank long, team_key string, display_name string, school_name string, code string, rating double, wins long, losses long, round_count long, peak_rating double, rank long")


def all_pages(ratings: DataFrame) -> DataFrame:
    return board(ratings).withColumn("page", F.floor((F.col("board_rank") - 1) / PAGE) + 1)


def speaker_points(ballots: DataFrame, entries: DataFrame, tournaments: DataFrame) -> DataFrame:
    b = ballots.filter("speaker_points is not null").join(entries.select(*T.ENTRY, "team_key"), T.ENTRY).join(tournaments.select("tourn_id", "season"), "tourn_id")
    return b.groupBy("season", "event_abbr", "team_key").agg(F.round(F.avg("speaker_points"), 6).alias("avg_points"), F.count("*").alias("n_points"))


def win_percentage(wins: Column, losses: Column) -> Column:
    return F.coalesce(F.try_divide(wins, wins + losses), F.lit(0.0))


def profiles(ratings: DataFrame, ballots: DataFrame, entries: DataFrame, tournaments: DataFrame) -> DataFrame:
    """All teams' profiles at once: rank, percentage, early and bracket rounds, bids, points and number of tournaments."""
    key = ["season", "event_abbr", "team_key"]
    season = tournaments.select("tourn_id", "season")
    rec = T.records(ballots).join(entries.select(*T.ENTRY, "team_key"), T.ENTRY).join(season, "tourn_id").groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("prelim_wins", "prelim_losses", "elim_wins", "elim_losses")))
    n = entries.join(season, "tourn_id").groupBy(*key).agg(F.countDistinct("tourn_id").alias("n_tournaments"))
    bids = T.season_bids(entries, tournaments).select(*key, "full_bids", "partial_bids")
    out = competition_rank(ratings).join(rec, key, "left").join(n, key, "left").join(bids, key, "left").join(speaker_points(ballots, entries, tournaments), key, "left")
    return out.withColumn("win_pct", F.round(win_percentage(F.col("wins"), F.col("losses")), 6)).fillna(0, ["full_bids", "partial_bids", "prelim_wins", "prelim_losses", "elim_wins", "elim_losses"])

"""What a profile shows besides its numbers, and what linked users see: tournaments, arguments, entries to come and gone by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import tournaments as T

RECORD = ("prelim_wins", "prelim_losses", "elim_wins", "elim_losses")


def team_tournaments(entries: DataFrame, tournaments: DataFrame, results: DataFrame, ballots: DataFrame) -> DataFrame:
    """season, event_abbr, team_key and each tournament that the team entered, with dates, bid, place, rank and records.

    nth counts a team's tournaments of a season by date. An entry without a result has null place and rank, one without ballots
    zero records.
    """
    when = tournaments.select("tourn_id", "season", "name", "start_date", "end_date")
    rows = entries.select(*T.ENTRY, "team_key", "earned_bid").join(when, "tourn_id").join(results.select(*T.ENTRY, "place", "final_rank"), T.ENTRY, "left")
    rows = rows.join(T.records(ballots), T.ENTRY, "left").fillna(0, list(RECORD))
    nth = F.row_number().over(Window.partitionBy("season", "event_abbr", "team_key").orderBy("start_date", "tourn_id", "entry_id"))
    return rows.select("season", "event_abbr", "team_key", nth.alias("nth"), "tourn_id", "name", "start_date", "end_date", "entry_id", "earned_bid", "place", "final_rank", *RECORD)


def top_arguments(ratings: DataFrame, teams: DataFrame, arguments: DataFrame, most: int = 5) -> DataFrame:
    """season, event_abbr, team_key, nth and the most read arguments of the team that the profile's names lead to.

    The team is the first of the same school whose code is a word of the displayed name; profiles without one have no rows.
    """
    rated = ratings.select("season", "event_abbr", "team_key", F.lower("school_name").alias("_school"), F.concat(F.lit(" "), F.lower("display_name"), F.lit(" ")).alias("_name"))
    known = teams.select(F.lower("school").alias("_school"), F.concat(F.lit(" "), F.lower("code"), F.lit(" ")).alias("_code"), F.col("id").alias("team_id"))
    linked = rated.join(known, "_school").filter(F.contains("_name", "_code")).groupBy("season", "event_abbr", "team_key").agg(F.min("team_id").alias("team_id"))
    nth = F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("read_count"), "id"))
    read = arguments.select("team_id", F.col("id").alias("argument_id"), "name", "side", "read_count", nth.alias("nth")).filter(F.col("nth") <= most)
    return linked.join(read, "team_id")


def _of_users(links: DataFrame, codes: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first entries of each user's linked codes in an order.

    The first of each code come before the users: many users can share a code, and each would have all of its entries.
    """
    by = [*order, "tourn_id", "event_abbr", "team_code", "entry_id"]
    first = lambda df, key: df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter(F.col("nth") <= most)
    of_code = first(codes.select("tourn_id", "name", "start_date", "end_date", "team_code", "school_name", "event_abbr", "entry_id").distinct(), "team_code").drop("nth")
    mine = of_code.join(links.select("user_id", "team_code").distinct(), "team_code")
    return first(mine.select("user_id", "tourn_id", "name", "start_date", "end_date", "team_code", "school_name", "event_abbr", "entry_id"), "user_id")


def upcoming_of(links: DataFrame, codes: DataFrame, as_of: str, most: int = 20) -> DataFrame:
    """user_id, nth and entries to come of each user's linked codes: the next `most` of every user, by date."""
    return _of_users(links, codes.filter(F.col("start_date") >= as_of), most, F.asc("start_date"))


def past_of(links: DataFrame, codes: DataFrame, ballots: DataFrame, as_of: str, most: int = 10) -> DataFrame:
    """user_id, nth and entries gone by of each user's linked codes, the last `most` of every user, with their records."""
    over = codes.filter(F.col("end_date").isNull() | (F.col("end_date") < as_of))
    return _of_users(links, over, most, F.desc("start_date")).join(T.records(ballots), T.ENTRY, "left").fillna(0, list(RECORD))

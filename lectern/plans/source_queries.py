"""Queries over nested tournament documents: flat tables are nested, parsed and must come out as they were."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.sources import tournament_json as J

ALL = ("fx_tournaments", "fx_entries", "fx_ballots", "fx_results")


def _docs(v):
    """The flat tables are nested once, as a document a line, since a reader then holds one document; each query parses them."""
    return J.parse(v.kept("nested", lambda: J.nested(v.fx_tournaments, v.fx_ballots, v.fx_entries, v.fx_results).select("raw"), form="text", compression="gzip"))


@query("SELECT tourn_id::BIGINT AS tourn_id, event_abbr, round_id::BIGINT AS round_id, round_name, round_type, ballot_id::BIGINT AS ballot_id, entry_id, opponent_entry_id, side, judge_name, result, speaker_points::DOUBLE AS speaker_points FROM fx_ballots", "fx_ballots")
def src_06_ballots_from_json(v):
    return J.ballots(_docs(v))


@query("SELECT tourn_id::BIGINT AS tourn_id, school_name, display_name AS team_code, event_abbr, entry_id, false AS dropped FROM fx_entries", "fx_entries")
def src_07_entry_index(v):
    return J.entry_index(_docs(v)).select("tourn_id", "school_name", "team_code", "event_abbr", "entry_id", "dropped")


@query("SELECT tourn_id::BIGINT AS tourn_id, name, city, country, start_date, end_date FROM fx_tournaments", "fx_tournaments")
def src_08_tournaments_from_json(v):
    return J.tournaments(_docs(v)).select("tourn_id", "name", "city", "country", "start_date", "end_date")


@query("SELECT tourn_id::BIGINT AS tourn_id, event_abbr, entry_id, team_key, school_name FROM fx_entries", "fx_entries")
def fil_13_rated_entries(v):
    return J.entries(_docs(v)).select("tourn_id", "event_abbr", "entry_id", "team_key", "school_name")


@query("SELECT tourn_id::BIGINT AS tourn_id, event_abbr, CASE full_bids WHEN 128 THEN 'Triples' WHEN 64 THEN 'Triples' WHEN 32 THEN 'Doubles' WHEN 16 THEN 'Octos' WHEN 8 THEN 'Quarters' WHEN 4 THEN 'Semis' WHEN 2 THEN 'Finals' END AS bid_level, full_bids, partial_bids FROM (SELECT tourn_id, event_abbr, count(*) FILTER (earned_bid = 'Full') AS full_bids, count(*) FILTER (earned_bid <> 'Full') AS partial_bids FROM fx_entries WHERE earned_bid IS NOT NULL GROUP BY ALL) x", "fx_entries")
def agg_16_bid_levels(v):
    return J.bid_levels(_docs(v))


@query("SELECT tourn_id::BIGINT AS tourn_id, event_abbr, entry_id, earned_bid FROM fx_entries WHERE earned_bid IS NOT NULL", "fx_entries")
def agg_17_earned_bids(v):
    return J.earned_bids(_docs(v))


@query("SELECT tourn_id::BIGINT AS tourn_id, event_abbr, entry_id, place, final_rank::INT AS final_rank, speaker_rank::INT AS speaker_rank, speaker_rank::DOUBLE AS speaker_points FROM fx_results WHERE place IS NOT NULL OR final_rank IS NOT NULL OR speaker_rank IS NOT NULL", "fx_results")
def agg_18_results(v):
    return J.results(_docs(v))


@query("SELECT tourn_id::BIGINT AS tourn_id, event_abbr, count(DISTINCT round_id) AS n_rounds, count(*) AS n_ballots FROM fx_ballots GROUP BY ALL", "fx_ballots")
def agg_32_document_profile(v):
    return J.profile(_docs(v))


@query("SELECT b.tourn_id::BIGINT AS tourn_id, b.entry_id, b.ballot_id::BIGINT AS ballot_id, e.display_name AS team_code, b.result FROM fx_ballots b JOIN fx_entries e USING (tourn_id, entry_id) WHERE lower(e.display_name) IN (SELECT lower(team_code) FROM fx_links)", "fx_ballots", "fx_links")
def join_13_linked_records(v):
    return J.linked_records(_docs(v), v.fx_links.select(F.upper("team_code").alias("team_code"))).select("tourn_id", "entry_id", "ballot_id", "team_code", "result")


@query("SELECT ballot_id::BIGINT AS ballot_id, result, speaker_points::DOUBLE AS points FROM fx_ballots WHERE round_type = 'prelim'", "fx_ballots")
def arr_02_first_match(v):
    return J.ballots(_docs(v)).filter("round_type = 'prelim'").select("ballot_id", "result", F.col("speaker_points").alias("points"))


@query("SELECT ballot_id::BIGINT AS ballot_id, opponent_entry_id, judge_name, side FROM fx_ballots", "fx_ballots")
def arr_03_section_opponent(v):
    return J.ballots(_docs(v)).select("ballot_id", "opponent_entry_id", "judge_name", "side")

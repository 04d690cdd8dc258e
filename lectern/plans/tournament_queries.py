"""Queries over tournaments and ratings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import ratings as R
from lectern.operators import tournaments as T
from lectern.plans.registry import query
from lectern.sources import merge

SEASON = "1995-96"

#: Results of entries by round, in DuckDB's SQL: a panel is one round.
ROUND_RESULTS = """rr AS (SELECT tourn_id, event_abbr, entry_id, round_id, min(round_name) AS round_name, min(round_type) AS round_type, count(*) FILTER (result = 'W') AS w, count(*) FILTER (result = 'L') AS l,
  arg_min(opponent_entry_id, ballot_id) FILTER (opponent_entry_id IS NOT NULL) AS opponent_entry_id, min(ballot_id) AS first_ballot FROM fx_ballots GROUP BY ALL)"""
REC = """rec AS (SELECT tourn_id, event_abbr, entry_id, count_if(round_type IN ('prelim', 'highlow') AND w >= l)::BIGINT AS prelim_wins, count_if(round_type IN ('prelim', 'highlow') AND w < l)::BIGINT AS prelim_losses,
  count_if(round_type NOT IN ('prelim', 'highlow') AND w >= l)::BIGINT AS elim_wins, count_if(round_type NOT IN ('prelim', 'highlow') AND w < l)::BIGINT AS elim_losses FROM rr GROUP BY tourn_id, event_abbr, entry_id)"""
DEPTH = "CASE n_entries WHEN 256 THEN 'Doubles' WHEN 128 THEN 'Doubles' WHEN 64 THEN 'Triples' WHEN 32 THEN 'Doubles' WHEN 16 THEN 'Octos' WHEN 8 THEN 'Quarters' WHEN 4 THEN 'Semis' WHEN 2 THEN 'Finals' END"
SIZES = "sz AS (SELECT tourn_id, event_abbr, round_id, count(DISTINCT entry_id) AS n_entries FROM fx_ballots WHERE round_type <> 'prelim' GROUP BY ALL)"
B = ("fx_ballots",)
BE = ("fx_ballots", "fx_entries")
BET = ("fx_ballots", "fx_entries", "fx_tournaments")


@query("""SELECT tourn_id, name, start_date FROM fx_tournaments t WHERE season = '1995-96' AND (country IS NULL OR upper(country) IN ('US', 'USA', 'UNITED STATES'))
 AND (EXISTS (SELECT 1 FROM fx_events e WHERE e.tourn_id = t.tourn_id AND bid_level IS NOT NULL) OR (name ILIKE '%Tournament of Champions%' AND NOT name ILIKE '%Middle School%')) AND NOT name ILIKE '%International Initiative TOC Test%'""", "fx_tournaments", "fx_events")  # fmt: skip
def fil_05_tournament_list(v):
    return T.listed(v.fx_tournaments, v.fx_events, SEASON).select("tourn_id", "name", "start_date")


@query("""SELECT tourn_id, end_date FROM fx_tournaments t WHERE season = '1995-96' AND (country IS NULL OR upper(country) IN ('US', 'USA', 'UNITED STATES')) AND end_date >= '1996-01-01'
 AND (EXISTS (SELECT 1 FROM fx_events e WHERE e.tourn_id = t.tourn_id AND bid_level IS NOT NULL) OR (name ILIKE '%Tournament of Champions%' AND NOT name ILIKE '%Middle School%'))""", "fx_tournaments", "fx_events")  # fmt: skip
def fil_06_upcoming(v):
    return T.listed(v.fx_tournaments, v.fx_events, SEASON, "upcoming", "1996-01-01").select("tourn_id", "end_date")


@query("SELECT id, school, code FROM fx_wiki_teams WHERE event = 'LD' AND (contains(lower(school), 'nation_1') OR contains(lower(code), 'nation_1') OR contains(lower(full_name), 'nation_1')) ORDER BY lower(school), lower(code), id LIMIT 20", "fx_wiki_teams")
def fil_07_team_list(v):
    return T.teams_of_event(v.fx_wiki_teams, "ld", "NATION_1", 20).select("id", "school", "code")


@query("SELECT tourn_id, name FROM fx_tournaments WHERE contains(lower(name), 'city 3') OR contains(lower(city), 'city 3') OR contains(lower(state), 'city 3')", "fx_tournaments")
def fil_09_tournament_text(v):
    return T.free_text(v.fx_tournaments, " City 3").select("tourn_id", "name")


NAMES = "CASE entry_id % 6 WHEN 0 THEN 'Novice LD' WHEN 1 THEN 'Varsity Policy' WHEN 2 THEN 'PF Round Robin' WHEN 3 THEN 'Lincoln-Douglas' WHEN 4 THEN 'Public Forum' ELSE 'Extemp' END"
ABBRS = "CASE entry_id % 5 WHEN 0 THEN 'JVLD' WHEN 1 THEN 'VPF' WHEN 2 THEN 'CX-CA' WHEN 3 THEN 'EXT' ELSE 'LD' END"


@query(f"SELECT tourn_id, entry_id, name, abbr FROM (SELECT tourn_id, entry_id, {NAMES} AS name, {ABBRS} AS abbr FROM fx_entries) x WHERE name NOT IN ('Novice LD', 'PF Round Robin') AND abbr NOT IN ('JVLD', 'CX-CA')", "fx_entries")
def fil_12_varsity_only(v):
    e = v.fx_entries.select("tourn_id", "entry_id", F.expr(NAMES).alias("name"), F.expr(ABBRS).alias("abbr"))
    return e.filter(~T.non_varsity(F.col("name"), F.col("abbr")))


@query(f"""SELECT tourn_id, entry_id, CASE abbr WHEN 'JVLD' THEN CASE name WHEN 'Varsity Policy' THEN 'CX' WHEN 'PF Round Robin' THEN 'PF' WHEN 'Lincoln-Douglas' THEN 'LD' WHEN 'Public Forum' THEN 'PF' END WHEN 'VPF' THEN 'PF'
 WHEN 'CX-CA' THEN CASE name WHEN 'Varsity Policy' THEN 'CX' WHEN 'PF Round Robin' THEN 'PF' WHEN 'Lincoln-Douglas' THEN 'LD' WHEN 'Public Forum' THEN 'PF' END WHEN 'EXT' THEN CASE name WHEN 'Varsity Policy' THEN 'CX' WHEN 'PF Round Robin' THEN 'PF' WHEN 'Lincoln-Douglas' THEN 'LD' WHEN 'Public Forum' THEN 'PF' END ELSE 'LD' END AS kind
 FROM (SELECT tourn_id, entry_id, {NAMES} AS name, {ABBRS} AS abbr FROM fx_entries) x""", "fx_entries")  # fmt: skip
def txt_18_canonical_abbr(v):
    e = v.fx_entries.select("tourn_id", "entry_id", F.expr(NAMES).alias("name"), F.expr(ABBRS).alias("abbr"))
    return e.select("tourn_id", "entry_id", T.canonical_abbr(F.col("abbr"), F.col("name")).alias("kind"))


THREATS = "th AS (SELECT e.*, t.season, coalesce(b.full_bids, 0)::BIGINT AS season_full_bids, coalesce(b.partial_bids, 0)::BIGINT AS season_partial_bids FROM fx_entries e JOIN fx_tournaments t USING (tourn_id) LEFT JOIN fx_season_bids b ON b.season = t.season AND b.team_key = e.team_key AND b.event_abbr = e.event_abbr)"
PLACED = """pl AS (SELECT t.season, r.event_abbr, e.team_key, r.place, ev.bid_level, CASE WHEN r.place = '1st' THEN 1 WHEN r.place = '2nd' THEN 2 WHEN r.place = 'Semis' THEN 4 WHEN r.place = 'QF' THEN 8 ELSE 16 END AS place_number
 FROM fx_results r JOIN fx_entries e USING (tourn_id, event_abbr, entry_id) JOIN fx_tournaments t USING (tourn_id) JOIN fx_events ev ON ev.tourn_id = r.tourn_id AND ev.event_abbr = r.event_abbr WHERE r.place IS NOT NULL)"""
BIDS_VIEWS = ("fx_entries", "fx_tournaments", "fx_season_bids")


def _threats(v):
    return T.threats(v.fx_entries, v.fx_season_bids, v.fx_tournaments)


def _placed(v):
    return T.team_placements(v.fx_results, v.fx_entries, v.fx_tournaments, v.fx_events)


@query(f"WITH {THREATS}, {PLACED} SELECT tourn_id, entry_id, event_abbr FROM th WHERE season_full_bids > 0 OR season_partial_bids > 0 OR (season, event_abbr, team_key) IN (SELECT season, event_abbr, team_key FROM pl)", *BIDS_VIEWS, "fx_results", "fx_events")
def fil_14_qualified_threats(v):
    placed = _placed(v).select("season", "event_abbr", "team_key").distinct().withColumn("_p", F.lit(True))
    return _threats(v).join(placed, ["season", "event_abbr", "team_key"], "left").filter("season_full_bids > 0 or season_partial_bids > 0 or _p").select("tourn_id", "entry_id", "event_abbr")


@query("""SELECT *, CASE WHEN place = '1st' OR final_rank = 1 THEN '1st' WHEN final_rank = 2 THEN '2nd' WHEN final_rank = 3 THEN 'Semis' WHEN place = 'Semis' THEN 'Semis' WHEN place = 'QF' THEN 'Quarters' WHEN place = 'octafinals' THEN 'Octos' END AS shown FROM
 (SELECT tourn_id, event_abbr, entry_id, place, final_rank::INT AS final_rank, row_number() OVER (PARTITION BY tourn_id, event_abbr ORDER BY final_rank, entry_id)::INT AS position FROM fx_results WHERE place IS NOT NULL OR final_rank IS NOT NULL) x""", "fx_results")  # fmt: skip
def fil_20_finished_places(v):
    return T.shown_places(v.fx_results).select("tourn_id", "event_abbr", "entry_id", "place", F.col("final_rank").cast("int").alias("final_rank"), "position", "shown")


@query("SELECT tourn_id, event_abbr, entry_id, place, CASE place WHEN '1st' THEN '1st' WHEN '2nd' THEN '2nd' WHEN 'Semis' THEN 'Semis' WHEN 'QF' THEN 'Quarters' WHEN 'octafinals' THEN 'Octos' ELSE '' END AS norm FROM fx_results", "fx_results")
def txt_20_normal_place(v):
    return v.fx_results.select("tourn_id", "event_abbr", "entry_id", "place", text.normal_place(F.col("place")).alias("norm"))


@query("SELECT tourn_id, event_abbr, entry_id, place, CASE WHEN place = '1st' OR final_rank = 1 THEN '1st' WHEN final_rank = 2 THEN '2nd' WHEN final_rank = 3 THEN 'Semis' WHEN place = 'Semis' THEN 'Semis' WHEN place = 'QF' THEN 'Quarters' WHEN place = 'octafinals' THEN 'Octos' END AS shown FROM fx_results WHERE place IS NOT NULL", "fx_results")
def win_11_place_display(v):
    return T.shown_places(v.fx_results.filter("place is not null")).select("tourn_id", "event_abbr", "entry_id", "place", "shown")


@query("SELECT event_abbr, entry_id, display_name FROM fx_entries WHERE tourn_id = 199506 AND event_abbr = 'LD' ORDER BY display_name, entry_id", "fx_entries")
def fil_21_entries_of_event(v):
    return v.fx_entries.filter("tourn_id = 199506 and event_abbr = 'LD'").select("event_abbr", "entry_id", "display_name").orderBy("display_name", "entry_id")


@query("SELECT b.ballot_id, b.result, e.team_key, t.start_date, ev.bid_level FROM fx_ballots b JOIN fx_tournaments t USING (tourn_id) JOIN fx_entries e ON e.tourn_id = b.tourn_id AND e.entry_id = b.entry_id LEFT JOIN fx_events ev ON ev.tourn_id = b.tourn_id AND ev.event_abbr = b.event_abbr WHERE t.season = '1995-96'", *BET, "fx_events")
def join_01_season_ballots(v):
    b = v.fx_ballots.join(v.fx_tournaments.filter(F.col("season") == SEASON).select("tourn_id", "start_date"), "tourn_id").join(v.fx_entries.select("tourn_id", "entry_id", "team_key"), ["tourn_id", "entry_id"])
    return b.join(v.fx_events.select("tourn_id", "event_abbr", "bid_level"), ["tourn_id", "event_abbr"], "left").select("ballot_id", "result", "team_key", "start_date", "bid_level")


@query("SELECT e.tourn_id, e.event_abbr, e.entry_id, e.earned_bid, r.place, r.final_rank::INT AS final_rank FROM fx_entries e JOIN fx_tournaments t USING (tourn_id) LEFT JOIN fx_results r ON r.tourn_id = e.tourn_id AND r.event_abbr = e.event_abbr AND r.entry_id = e.entry_id WHERE e.team_key = 's:3'", "fx_entries", "fx_tournaments", "fx_results")
def join_02_team_tournaments(v):
    e = v.fx_entries.filter("team_key = 's:3'").join(v.fx_tournaments.select("tourn_id"), "tourn_id")
    return e.join(v.fx_results, T.ENTRY, "left").select("tourn_id", "event_abbr", "entry_id", "earned_bid", "place", F.col("final_rank").cast("int").alias("final_rank"))


@query("SELECT b.ballot_id, o.display_name AS opponent_name FROM fx_ballots b LEFT JOIN fx_entries o ON o.tourn_id = b.tourn_id AND o.entry_id = b.opponent_entry_id AND o.event_abbr = b.event_abbr", *BE)
def join_03_opponents(v):
    o = v.fx_entries.select("tourn_id", "event_abbr", F.col("entry_id").alias("opponent_entry_id"), F.col("display_name").alias("opponent_name"))
    return v.fx_ballots.join(o, ["tourn_id", "event_abbr", "opponent_entry_id"], "left").select("ballot_id", "opponent_name")


MATCHES = f"{ROUND_RESULTS}, d AS (SELECT *, CASE WHEN w > l THEN 'W' WHEN l > w THEN 'L' END AS result FROM rr), m AS (SELECT x.tourn_id, x.event_abbr, x.round_id, x.round_name, x.round_type, x.entry_id AS a, x.opponent_entry_id AS b, x.result AS a_result, x.first_ballot FROM d x JOIN d y ON y.tourn_id = x.tourn_id AND y.event_abbr = x.event_abbr AND y.round_id = x.round_id AND y.entry_id = x.opponent_entry_id WHERE x.result IS NOT NULL AND y.result IS NOT NULL AND y.opponent_entry_id IS NOT NULL AND x.first_ballot < y.first_ballot)"


@query(f"WITH {MATCHES} SELECT * FROM m", *B)
def join_04_matches(v):
    return T.matches(v.fx_ballots)


@query(f"WITH {ROUND_RESULTS} SELECT tourn_id, event_abbr, entry_id, round_id, CASE WHEN w > l THEN 'W' WHEN l > w THEN 'L' END AS result, opponent_entry_id FROM rr", *B)
def rat_01_round_results(v):
    return T.round_results(v.fx_ballots).select(*T.ENTRY, "round_id", "result", "opponent_entry_id")


@query(f"WITH {ROUND_RESULTS} SELECT tourn_id, event_abbr, entry_id, round_id, CASE WHEN w > l THEN 'W' WHEN l > w THEN 'L' END AS result FROM rr WHERE round_type = 'elim'", *B)
def agg_09_majority(v):
    return T.round_results(v.fx_ballots.filter("round_type = 'elim'")).select(*T.ENTRY, "round_id", "result")


@query("SELECT e.tourn_id, e.event_abbr, e.entry_id, min(w.id) AS wiki_team_id FROM fx_entries e LEFT JOIN fx_wiki_teams w ON lower(w.school) = lower(e.school_name) AND contains(concat(' ', lower(e.display_name), ' '), concat(' ', lower(w.code), ' ')) GROUP BY ALL", "fx_entries", "fx_wiki_teams")
def join_05_fuzzy_link(v):
    return T.linked_team(v.fx_entries, v.fx_wiki_teams).groupBy(*T.ENTRY).agg(F.min("wiki_team_id").alias("wiki_team_id"))


@query(f"WITH {THREATS} SELECT tourn_id, event_abbr, entry_id, season_full_bids, season_partial_bids FROM th", *BIDS_VIEWS)
def join_06_threat_bids(v):
    return _threats(v).select(*T.ENTRY, F.col("season_full_bids").cast("bigint").alias("season_full_bids"), F.col("season_partial_bids").cast("bigint").alias("season_partial_bids"))


@query(f"WITH {THREATS}, {PLACED} SELECT tourn_id, event_abbr, entry_id, coalesce((SELECT count(*) FROM pl WHERE pl.season = th.season AND pl.event_abbr = th.event_abbr AND pl.team_key = th.team_key), 0) AS n_places, coalesce((SELECT string_agg(concat(place, '/', coalesce(bid_level, '-')), ',' ORDER BY place, coalesce(bid_level, '-')) FROM pl WHERE pl.season = th.season AND pl.event_abbr = th.event_abbr AND pl.team_key = th.team_key), '') AS places FROM th", *BIDS_VIEWS, "fx_results", "fx_events")
def join_07_team_placements(v):
    key = ["season", "event_abbr", "team_key"]
    t = _threats(v)
    level = F.coalesce("bid_level", F.lit("-"))
    gathered = _placed(v).join(t.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count("*").alias("n_places"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", level.alias("level")))), lambda x: F.concat_ws("/", x["place"], x["level"])), ",").alias("places"))
    return t.join(gathered, key, "left").select(*T.ENTRY, F.coalesce("n_places", F.lit(0)).alias("n_places"), F.coalesce("places", F.lit("")).alias("places"))


@query("SELECT r.tourn_id, r.event_abbr, r.entry_id, r.place, r.final_rank::INT AS final_rank, e.display_name, e.earned_bid FROM fx_results r JOIN fx_entries e USING (tourn_id, event_abbr, entry_id)", "fx_results")
def join_08_results_entries(v):
    return v.fx_results.join(v.fx_entries, T.ENTRY).select(*T.ENTRY, "place", F.col("final_rank").cast("int").alias("final_rank"), "display_name", "earned_bid")


@query(f"WITH {ROUND_RESULTS}, {REC} SELECT r.tourn_id, r.event_abbr, r.entry_id, r.place, coalesce(prelim_wins, 0) AS prelim_wins, coalesce(elim_losses, 0) AS elim_losses FROM fx_results r LEFT JOIN rec USING (tourn_id, event_abbr, entry_id)", "fx_ballots", "fx_results")
def join_09_results_records(v):
    return v.fx_results.join(T.records(v.fx_ballots), T.ENTRY, "left").fillna(0, ["prelim_wins", "elim_losses"]).select(*T.ENTRY, "place", "prelim_wins", "elim_losses")


@query("SELECT b.ballot_id, b.round_id, b.entry_id, b.result, e.display_name FROM fx_ballots b LEFT JOIN fx_entries e USING (tourn_id, event_abbr, entry_id) WHERE b.round_type = 'elim'", *BE)
def join_10_elim_ballots(v):
    return v.fx_ballots.filter("round_type = 'elim'").join(v.fx_entries, T.ENTRY, "left").select("ballot_id", "round_id", "entry_id", "result", "display_name")


READS = """reads AS (SELECT r.team_id, r.round_id, c.n, r.created_at, r.tournament, r.opensource, c.round_id IS NOT NULL AS cited,
  CASE WHEN c.round_id IS NULL THEN concat(r.tournament, ' ', r.round) ELSE trim(regexp_replace(coalesce(nullif(c.title, ''), concat(r.tournament, ' ', r.round)), '^[A-Z0-9]{1,4}---', '')) END AS name,
  CASE WHEN c.round_id IS NULL THEN CASE r.side WHEN 'A' THEN 'aff' WHEN 'N' THEN 'neg' END
       WHEN regexp_matches(lower(c.title), '(^|[^a-z])(aff|1ac|2ac)([^a-z]|$)') THEN 'aff' WHEN regexp_matches(lower(c.title), '(^|[^a-z])(neg|1nc|2nr|nc|cp|da|k|t|pik|th|phil)([^a-z]|$)') THEN 'neg' WHEN r.side = 'A' THEN 'aff' WHEN r.side = 'N' THEN 'neg' ELSE 'aff' END AS arg_side,
  CASE WHEN c.round_id IS NULL THEN coalesce(concat('Open-source docx: ', nullif(r.opensource, '')), '') ELSE c.cites END AS full_text FROM fx_rounds r LEFT JOIN fx_round_cites c ON c.round_id = r.round_id)""".replace("coalesce(concat('Open-source docx: ', nullif(r.opensource, '')), '')", "CASE WHEN r.opensource IS NOT NULL THEN concat('Open-source docx: ', r.opensource) ELSE '' END")


def _reads(v):
    return T.argument_reads(v.fx_rounds, v.fx_round_cites)


@query(f"WITH {READS} SELECT team_id, round_id, n, name, arg_side, full_text FROM reads", "fx_rounds", "fx_round_cites")
def join_11_rounds_cites(v):
    return _reads(v).select("team_id", "round_id", "n", "name", "arg_side", "full_text")


ARGS = "args AS (SELECT team_id, arg_side, lower(name) AS name_key, count(*) AS read_count, first(name ORDER BY created_at, round_id, n NULLS FIRST, full_text) AS name, coalesce(first(full_text ORDER BY created_at, round_id, n NULLS FIRST, full_text) FILTER (full_text <> ''), '') AS full_text, first(opensource ORDER BY created_at, round_id, n NULLS FIRST, full_text) AS opensource, first(tournament ORDER BY created_at, round_id, n NULLS FIRST, full_text) AS tournament FROM reads GROUP BY team_id, arg_side, lower(name))"


@query(f"WITH {READS}, {ARGS} SELECT team_id, arg_side, name_key, read_count, name, full_text FROM args", "fx_rounds", "fx_round_cites")
def agg_19_arguments(v):
    return T.arguments(_reads(v)).select("team_id", "arg_side", "name_key", "read_count", "name", "full_text")


@query(f"WITH {READS}, {ARGS} SELECT team_id, arg_side, name_key FROM args WHERE NOT (coalesce(opensource, '') = '' AND length(trim(regexp_replace(regexp_replace(full_text, '[#>*_`|~-]', ' ', 'g'), '\\s+', ' ', 'g'))) < 30)", "fx_rounds", "fx_round_cites")
def fil_11_real_arguments(v):
    a = T.arguments(_reads(v))
    return a.filter(~T.is_junk(F.col("name"), F.col("full_text"), F.col("opensource"), F.col("tournament"))).select("team_id", "arg_side", "name_key")


@query("SELECT round_id, n, title, trim(regexp_replace(title, '^[A-Z0-9]{1,4}---', '')) AS name, CASE WHEN regexp_matches(lower(title), '(^|[^a-z])(aff|1ac|2ac)([^a-z]|$)') THEN 'aff' WHEN regexp_matches(lower(title), '(^|[^a-z])(neg|1nc|2nr|nc|cp|da|k|t|pik|th|phil)([^a-z]|$)') THEN 'neg' ELSE 'aff' END AS side FROM fx_round_cites", "fx_round_cites")
def txt_17_infer_side(v):
    return v.fx_round_cites.select("round_id", "n", "title", text.strip_tournament_prefix(F.col("title")).alias("name"), text.infer_side(F.col("title"), F.lit(None).cast("string")).alias("side"))


@query("""SELECT user_id, tourn_id, string_agg(DISTINCT concat(event_abbr, ':', team_code), ', ' ORDER BY concat(event_abbr, ':', team_code)) AS entered FROM (SELECT DISTINCT l.user_id, c.tourn_id, c.event_abbr, c.team_code, c.start_date FROM fx_links l JOIN fx_codes c ON c.team_code = l.team_code AND c.school_name = l.school_name
 WHERE c.end_date >= '1996-01-01' ORDER BY c.start_date, l.user_id, c.tourn_id, c.event_abbr, c.team_code LIMIT 200) x GROUP BY user_id, tourn_id""", "fx_links", "fx_codes")  # fmt: skip
def join_12_linked_upcoming(v):
    rows = v.fx_codes.filter("end_date >= '1996-01-01'").join(F.broadcast(v.fx_links), ["team_code", "school_name"]).select("user_id", "tourn_id", "event_abbr", "team_code", "start_date").distinct()
    top = rows.orderBy("start_date", "user_id", "tourn_id", "event_abbr", "team_code").limit(200)
    return top.groupBy("user_id", "tourn_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "event_abbr", "team_code"))), ", ").alias("entered"))


@query("SELECT t.tourn_id, t.name, string_agg(concat(e.event_abbr, ' ', coalesce(e.bid_level, '-')), ', ' ORDER BY e.event_abbr) AS events FROM fx_tournaments t LEFT JOIN fx_events e USING (tourn_id) GROUP BY t.tourn_id, t.name", "fx_tournaments", "fx_events")
def join_17_nested_events(v):
    e = v.fx_events.groupBy("tourn_id").agg(F.array_sort(F.collect_list(F.struct("event_abbr", F.coalesce("bid_level", F.lit("-")).alias("level")))).alias("events"))
    return v.fx_tournaments.join(e, "tourn_id", "left").select("tourn_id", "name", F.array_join(F.transform("events", lambda x: F.concat_ws(" ", x["event_abbr"], x["level"])), ", ").alias("events"))


@query("SELECT season, team_key, event_abbr, full_bids::BIGINT AS full_bids, partial_bids::BIGINT AS partial_bids, display_name, school_code FROM fx_season_bids", "fx_season_bids")
def agg_08_season_bids(v):
    return T.season_bids(v.fx_entries, v.fx_tournaments)


@query(f"WITH {ROUND_RESULTS}, {REC} SELECT * FROM rec", *B)
def agg_10_records(v):
    return T.records(v.fx_ballots)


@query(f"WITH {SIZES} SELECT tourn_id, event_abbr, round_id, n_entries, {DEPTH} AS depth FROM sz", *B)
def agg_11_bracket_depths(v):
    return T.bracket_depths(v.fx_ballots)


@query(f"""WITH {ROUND_RESULTS}, {REC}, {SIZES}, dp AS (SELECT tourn_id, event_abbr, entry_id, round_id, round_name, w, l, n_entries, row_number() OVER (PARTITION BY tourn_id, event_abbr, entry_id ORDER BY n_entries, round_id) AS k FROM rr JOIN sz USING (tourn_id, event_abbr, round_id) WHERE round_type = 'elim')
SELECT rec.tourn_id, rec.event_abbr, rec.entry_id, prelim_wins, elim_wins, CASE WHEN dp.k IS NULL THEN 'Prelim' WHEN n_entries = 2 THEN CASE WHEN w > l THEN '1st' ELSE '2nd' END ELSE coalesce({DEPTH}, concat('Round ', round_name)) END AS place
FROM rec LEFT JOIN dp ON dp.tourn_id = rec.tourn_id AND dp.event_abbr = rec.event_abbr AND dp.entry_id = rec.entry_id AND dp.k = 1""", *B)  # fmt: skip
def agg_12_placements(v):
    return T.placements(v.fx_ballots, v.fx_entries).select(*T.ENTRY, "prelim_wins", "elim_wins", "place")


@query(f"""WITH {SIZES}, bb AS (SELECT b.*, o.display_name AS opponent_name FROM fx_ballots b LEFT JOIN fx_entries o ON o.tourn_id = b.tourn_id AND o.event_abbr = b.event_abbr AND o.entry_id = b.opponent_entry_id),
p AS (SELECT tourn_id, event_abbr, entry_id, round_id, min(round_type) AS round_type, min(round_name) AS round_name, first(side ORDER BY ballot_id) AS side, first(opponent_name ORDER BY ballot_id) AS opponent_name, coalesce(string_agg(result, '' ORDER BY ballot_id) FILTER (result IN ('W', 'L')), '') AS votes,
 count(*) FILTER (result = 'W') AS w, count(*) FILTER (result = 'L') AS l, round(avg(speaker_points), 6) AS speaker_points FROM bb GROUP BY ALL),
jn AS (SELECT tourn_id, event_abbr, entry_id, round_id, string_agg(judge_name, ', ' ORDER BY f) AS judges FROM (SELECT tourn_id, event_abbr, entry_id, round_id, judge_name, min(ballot_id) AS f FROM bb GROUP BY ALL) x GROUP BY ALL)
SELECT p.tourn_id, p.event_abbr, p.entry_id, p.round_id, round_type, round_name, side, opponent_name, judges, votes, speaker_points, {DEPTH} AS depth, CASE WHEN w > l THEN 'W' WHEN l > w THEN 'L' END AS result, (w + l)::BIGINT AS ballot_count
FROM p JOIN jn USING (tourn_id, event_abbr, entry_id, round_id) LEFT JOIN sz USING (tourn_id, event_abbr, round_id)""", *BE)  # fmt: skip
def agg_13_pairings(v):
    return T.pairings(v.fx_ballots, v.fx_entries)


@query("SELECT t.season, b.event_abbr, e.team_key, round(avg(b.speaker_points), 6) AS avg_points, count(b.speaker_points) AS n_points FROM fx_ballots b JOIN fx_entries e USING (tourn_id, event_abbr, entry_id) JOIN fx_tournaments t USING (tourn_id) WHERE b.speaker_points IS NOT NULL GROUP BY ALL", *BET)
def agg_14_speaker_points(v):
    return R.speaker_points(v.fx_ballots, v.fx_entries, v.fx_tournaments)


@query("SELECT season, count(DISTINCT concat(team_key, ':', event_abbr)) AS rated FROM fx_ratings GROUP BY season", "fx_ratings")
def agg_15_seasons(v):
    return v.fx_ratings.groupBy("season").agg(F.countDistinct("team_key", "event_abbr").alias("rated"))


@query("SELECT tourn_id, event_abbr, bid_level, CASE event_abbr WHEN 'LD' THEN 0 WHEN 'PF' THEN 1 ELSE 2 END AS event_order FROM fx_events", "fx_events")
def agg_23_dedupe_events(v):
    lower = v.fx_events.withColumn("bid_level", F.lit(None).cast("string"))
    return T.dedupe_events(v.fx_events.unionByName(lower)).select("tourn_id", "event_abbr", "bid_level", "event_order")


@query("SELECT school, count(*) AS n, string_agg(code, ', ' ORDER BY code, id) AS codes FROM fx_wiki_teams GROUP BY school", "fx_wiki_teams")
def agg_26_roster(v):
    return v.fx_wiki_teams.groupBy("school").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "id"))), lambda x: x["code"]), ", ").alias("codes"))


@query("SELECT team_code, school_name, string_agg(event_abbr, ', ' ORDER BY event_abbr) AS events FROM (SELECT DISTINCT team_code, school_name, event_abbr FROM fx_codes WHERE team_code ILIKE '%nation_9 a%' OR team_code ILIKE '%nation_3 b%') x GROUP BY ALL ORDER BY team_code, school_name LIMIT 50", "fx_codes")
def agg_27_code_search(v):
    rows = v.fx_codes.filter(F.col("team_code").ilike("%nation_9 a%") | F.col("team_code").ilike("%nation_3 b%")).select("team_code", "school_name", "event_abbr").distinct()
    return rows.groupBy("team_code", "school_name").agg(F.array_join(F.array_sort(F.collect_set("event_abbr")), ", ").alias("events")).orderBy("team_code", "school_name").limit(50)


SCORE = f"""{PLACED}, wt AS (SELECT *, CASE bid_level WHEN 'Triples' THEN 1.0 WHEN 'Doubles' THEN 0.9 WHEN 'Octos' THEN 0.75 WHEN 'Quarters' THEN 0.6 WHEN 'Semis' THEN 0.45 WHEN 'Finals' THEN 0.3 ELSE 0.2 END::DOUBLE AS weight FROM pl),
ps AS (SELECT season, event_abbr, team_key, sum(greatest(0, 17 - place_number) * weight) AS score FROM (SELECT *, row_number() OVER (PARTITION BY season, event_abbr, team_key ORDER BY place_number, weight DESC) AS k FROM wt) x WHERE k <= 3 GROUP BY ALL)"""


@query(f"WITH {SCORE} SELECT season, event_abbr, team_key, round(score, 6) AS score FROM ps", "fx_results", "fx_tournaments", "fx_events")
def win_09_placement_score(v):
    return T.placement_score(_placed(v)).withColumn("score", F.round("score", 6))


@query(f"""WITH {THREATS}, {SCORE}, a AS (SELECT th.*, coalesce(ps.score, 0.0) AS p, season_full_bids + season_partial_bids AS bids FROM th LEFT JOIN ps USING (season, event_abbr, team_key)),
s AS (SELECT *, round(0.6 * CASE WHEN max(bids) OVER f = min(bids) OVER f THEN 1.0::DOUBLE ELSE (bids - min(bids) OVER f)::DOUBLE / (max(bids) OVER f - min(bids) OVER f) END + 0.4 * CASE WHEN max(p) OVER f = min(p) OVER f THEN 1.0::DOUBLE ELSE (p - min(p) OVER f) / (max(p) OVER f - min(p) OVER f) END, 6) AS score FROM a WINDOW f AS (PARTITION BY tourn_id, event_abbr))
SELECT tourn_id, event_abbr, entry_id, score, nth FROM (SELECT *, row_number() OVER (PARTITION BY tourn_id, event_abbr ORDER BY score DESC, entry_id)::INT AS nth FROM s) x WHERE nth <= 30""", *BIDS_VIEWS, "fx_results", "fx_events")  # fmt: skip
def agg_28_threat_scores(v):
    return T.scored_threats(_threats(v), T.placement_score(_placed(v))).select(*T.ENTRY, "score", "nth")


@query("SELECT season, event_abbr, team_key, round(CASE WHEN max(wins) OVER f = min(wins) OVER f THEN 1.0::DOUBLE ELSE (wins - min(wins) OVER f)::DOUBLE / (max(wins) OVER f - min(wins) OVER f) END, 6) AS scaled FROM fx_ratings WINDOW f AS (PARTITION BY season, event_abbr)", "fx_ratings")
def mth_04_min_max(v):
    return v.fx_ratings.select("season", "event_abbr", "team_key", F.round(T.min_max("wins", ["season", "event_abbr"]), 6).alias("scaled"))


@query("SELECT season, event_abbr, team_key, round(CASE WHEN wins + losses = 0 THEN 0.0::DOUBLE ELSE wins::DOUBLE / (wins + losses)::DOUBLE END, 6) AS win_pct FROM fx_ratings", "fx_ratings")
def mth_05_win_percentage(v):
    return v.fx_ratings.select("season", "event_abbr", "team_key", F.round(R.win_percentage(F.col("wins"), F.col("losses")), 6).alias("win_pct"))


@query("SELECT season, event_abbr, team_key, rating::DOUBLE AS rating, row_number() OVER (PARTITION BY season, event_abbr ORDER BY rating DESC, team_key)::INT AS board_rank FROM fx_ratings WHERE round_count >= 10", "fx_ratings")
def win_01_board(v):
    return R.board(v.fx_ratings).select("season", "event_abbr", "team_key", F.col("rating").cast("double").alias("rating"), "board_rank")


RANKED = "SELECT r.season, r.event_abbr, r.team_key, 1 + (SELECT count(*) FROM fx_ratings o WHERE o.season = r.season AND o.event_abbr = r.event_abbr AND o.round_count >= 10 AND o.rating > r.rating) AS competition_rank FROM fx_ratings r"


@query(RANKED, "fx_ratings")
def win_02_competition_rank(v):
    return R.competition_rank(v.fx_ratings).select("season", "event_abbr", "team_key", "competition_rank")


@query(RANKED + " WHERE r.team_key IN ('s:1', 's:2', 's:3')", "fx_ratings")
def join_18_rank_of_teams(v):
    return R.competition_rank(v.fx_ratings).filter(F.col("team_key").isin("s:1", "s:2", "s:3")).select("season", "event_abbr", "team_key", "competition_rank")


@query("SELECT season, event_abbr, team_key, n AS board_rank FROM (SELECT *, row_number() OVER (ORDER BY rating DESC, team_key)::INT AS n FROM fx_ratings WHERE season = '1995-96' AND event_abbr = 'LD' AND round_count >= 10) x WHERE contains(lower(display_name), 'school') ORDER BY wins DESC, n LIMIT 50 OFFSET 50", "fx_ratings")
def sort_05_leaderboard(v):
    return R.leaderboard(v.fx_ratings, SEASON, "LD", 2, "School", "wins").select("season", "event_abbr", "team_key", "board_rank")


@query(None)
def win_04_merged_pages(v):
    return R.merge_pairs(R.all_pages(v.fx_ratings))


def _matches(v):
    return v.kept("matches", lambda: R.rated_matches(v.fx_ballots, v.fx_tournaments, v.fx_entries, v.fx_events))


@query(f"""WITH {MATCHES}, ne AS (SELECT tourn_id, event_abbr, round_id, count(DISTINCT entry_id) AS n_entries FROM fx_ballots GROUP BY ALL),
q AS (SELECT m.*, t.season, e.bid_level, CASE WHEN round_type = 'elim' THEN CASE WHEN round_name IN ('Triples', 'Doubles', 'Octos', 'Quarters', 'Semis', 'Finals') THEN round_name ELSE CASE n_entries WHEN 64 THEN 'Triples' WHEN 32 THEN 'Doubles' WHEN 16 THEN 'Octos' WHEN 8 THEN 'Quarters' WHEN 4 THEN 'Semis' WHEN 2 THEN 'Finals' END END END AS depth
 FROM m JOIN ne USING (tourn_id, event_abbr, round_id) JOIN fx_tournaments t USING (tourn_id) LEFT JOIN fx_events e ON e.tourn_id = m.tourn_id AND e.event_abbr = m.event_abbr)
SELECT season, event_abbr, round_id, a, b, depth, (CASE WHEN round_type = 'elim' THEN CASE depth WHEN 'Triples' THEN 35 WHEN 'Doubles' THEN 45 WHEN 'Octos' THEN 60 WHEN 'Quarters' THEN 75 WHEN 'Semis' THEN 90 WHEN 'Finals' THEN 120 ELSE 60 END ELSE 20 END::DOUBLE
 * CASE bid_level WHEN 'Triples' THEN 1.0 WHEN 'Doubles' THEN 0.9 WHEN 'Octos' THEN 0.75 WHEN 'Quarters' THEN 0.6 WHEN 'Semis' THEN 0.45 WHEN 'Finals' THEN 0.3 ELSE 0.2 END::DOUBLE)::DOUBLE AS k FROM q""", *BET, "fx_events")  # fmt: skip
def rat_02_k_factors(v):
    return _matches(v).select("season", "event_abbr", "round_id", "a", "b", "depth", "k")


#: The fold in DuckDB's SQL: one match of each season and event at a time, with the ratings so far in a map.
ELO = f"""{MATCHES}, ne AS (SELECT tourn_id, event_abbr, round_id, count(DISTINCT entry_id) AS n_entries FROM fx_ballots GROUP BY ALL),
km AS (SELECT m.*, t.season, t.start_date, ea.team_key AS a_key, eb.team_key AS b_key, e.bid_level, CASE WHEN round_type = 'elim' THEN CASE WHEN round_name IN ('Triples', 'Doubles', 'Octos', 'Quarters', 'Semis', 'Finals') THEN round_name ELSE CASE n_entries WHEN 64 THEN 'Triples' WHEN 32 THEN 'Doubles' WHEN 16 THEN 'Octos' WHEN 8 THEN 'Quarters' WHEN 4 THEN 'Semis' WHEN 2 THEN 'Finals' END END END AS depth
 FROM m JOIN ne USING (tourn_id, event_abbr, round_id) JOIN fx_tournaments t USING (tourn_id) LEFT JOIN fx_events e ON e.tourn_id = m.tourn_id AND e.event_abbr = m.event_abbr JOIN fx_entries ea ON ea.tourn_id = m.tourn_id AND ea.entry_id = m.a JOIN fx_entries eb ON eb.tourn_id = m.tourn_id AND eb.entry_id = m.b),
om AS (SELECT *, (CASE WHEN round_type = 'elim' THEN CASE depth WHEN 'Triples' THEN 35 WHEN 'Doubles' THEN 45 WHEN 'Octos' THEN 60 WHEN 'Quarters' THEN 75 WHEN 'Semis' THEN 90 WHEN 'Finals' THEN 120 ELSE 60 END ELSE 20 END::DOUBLE
 * CASE bid_level WHEN 'Triples' THEN 1.0 WHEN 'Doubles' THEN 0.9 WHEN 'Octos' THEN 0.75 WHEN 'Quarters' THEN 0.6 WHEN 'Semis' THEN 0.45 WHEN 'Finals' THEN 0.3 ELSE 0.2 END::DOUBLE)::DOUBLE AS k,
 row_number() OVER (PARTITION BY season, event_abbr ORDER BY start_date, CASE WHEN round_type = 'prelim' THEN 0 ELSE 1 END, CASE WHEN regexp_matches(round_name, '^[0-9]') THEN CAST(regexp_extract(round_name, '^[0-9]+') AS INT) ELSE 9999 END, round_name, tourn_id, round_id, first_ballot) AS nth FROM km),
fo AS (SELECT season, event_abbr, 0::BIGINT AS nth, MAP([''], [0.0::DOUBLE]) AS held, 0.0::DOUBLE AS ra, 0.0::DOUBLE AS rb, 0.0::DOUBLE AS da, 0.0::DOUBLE AS db FROM (SELECT DISTINCT season, event_abbr FROM om) x
 UNION ALL SELECT season, event_abbr, nth, map_concat(held, MAP([a_key, b_key], [ra + da, rb + db])), ra, rb, da, db FROM
  (SELECT *, CASE WHEN round_type = 'elim' AND a_result = 'L' THEN 0.0 ELSE k * (CASE WHEN a_result = 'W' THEN 1.0 ELSE 0.0 END - p) END AS da, CASE WHEN round_type = 'elim' AND a_result = 'W' THEN 0.0 ELSE k * (CASE WHEN a_result = 'W' THEN 0.0 ELSE 1.0 END - (1.0 - p)) END AS db FROM
   (SELECT *, 1.0::DOUBLE / (1.0 + power(10.0::DOUBLE, (rb - ra) / 400.0)) AS p FROM (SELECT om.*, fo.held, coalesce(list_extract(map_extract(fo.held, om.a_key), 1), 1500.0::DOUBLE) AS ra, coalesce(list_extract(map_extract(fo.held, om.b_key), 1), 1500.0::DOUBLE) AS rb FROM fo JOIN om ON om.season = fo.season AND om.event_abbr = fo.event_abbr AND om.nth = fo.nth + 1) x) y) z),
hi AS (SELECT om.season, om.event_abbr, 2 * (om.nth - 1) + s.x AS seq, CASE s.x WHEN 0 THEN a_key ELSE b_key END AS team_key, tourn_id, round_id, round_name, round_type, CASE WHEN (a_result = 'W') = (s.x = 0) THEN 'W' ELSE 'L' END AS result, CASE s.x WHEN 0 THEN ra ELSE rb END AS rating_before, CASE s.x WHEN 0 THEN ra + da ELSE rb + db END AS rating_after,
 CASE s.x WHEN 0 THEN da ELSE db END AS change, CASE s.x WHEN 0 THEN b_key ELSE a_key END AS opponent_key, CASE s.x WHEN 0 THEN rb ELSE ra END AS opponent_rating, start_date AS occurred_at FROM om JOIN fo USING (season, event_abbr, nth) CROSS JOIN (VALUES (0), (1)) s(x))"""
HISTORY = "season, event_abbr, team_key, tourn_id, round_id, round_name, round_type, result, round(rating_before, 6) AS rating_before, round(rating_after, 6) AS rating_after, round(change, 6) AS change, opponent_key, round(opponent_rating, 6) AS opponent_rating, occurred_at"
HISTORY_SQL = f"WITH RECURSIVE {ELO} SELECT {HISTORY} FROM hi"


def _shown(history):
    return history.drop("seq").withColumns({c: F.round(c, 6) for c in ("rating_before", "rating_after", "change", "opponent_rating")})


@query(HISTORY_SQL, *BET, "fx_events")
def rat_03_history(v):
    return _shown(R.history(_matches(v)))


@query(f"WITH RECURSIVE {ELO} SELECT season, event_abbr, team_key, seq, round(rating_before, 6) AS rating_before, round(rating_after, 6) AS rating_after, round(greatest(max(rating_after) OVER (PARTITION BY season, event_abbr, team_key ORDER BY seq), 1500.0), 6) AS peak FROM hi", *BET, "fx_events")
def win_03_running_peak(v):
    return R.with_peak(R.history(_matches(v))).select("season", "event_abbr", "team_key", "seq", F.round("rating_before", 6).alias("rating_before"), F.round("rating_after", 6).alias("rating_after"), F.round("peak", 6).alias("peak"))


@query(f"WITH RECURSIVE {ELO} SELECT season, event_abbr, team_key, count(*) AS round_count, count_if(result = 'W')::BIGINT AS wins, count_if(result = 'L')::BIGINT AS losses, round(arg_max(rating_after, seq), 6) AS rating, round(greatest(max(rating_after), 1500.0), 6) AS peak_rating FROM hi GROUP BY ALL", *BET, "fx_events")
def agg_29_rating_table(v):
    return R.ratings(R.history(_matches(v))).select("season", "event_abbr", "team_key", "round_count", "wins", "losses", F.round("rating", 6).alias("rating"), F.round("peak_rating", 6).alias("peak_rating"))


@query(HISTORY_SQL, *BET, "fx_events")
def rat_04_incremental(v):
    m = _matches(v)
    early = R.history(m.filter("start_date < '1996-01-01'"))
    later = R.history(m.filter("start_date >= '1996-01-01'"), R.ratings(early))
    return _shown(early.unionByName(later))


@query(HISTORY_SQL + " WHERE team_key = 's:3'", *BET, "fx_events")
def rat_05_team_history(v):
    return _shown(R.history(_matches(v)).filter("team_key = 's:3'").orderBy("occurred_at", "season", "event_abbr", "seq"))


@query(f"""WITH {ROUND_RESULTS}, {REC}, rk AS ({RANKED}), rs AS (SELECT t.season, rec.event_abbr, e.team_key, sum(prelim_wins)::BIGINT AS prelim_wins, sum(prelim_losses)::BIGINT AS prelim_losses, sum(elim_wins)::BIGINT AS elim_wins, sum(elim_losses)::BIGINT AS elim_losses FROM rec JOIN fx_entries e USING (tourn_id, event_abbr, entry_id) JOIN fx_tournaments t USING (tourn_id) GROUP BY ALL),
nt AS (SELECT t.season, e.event_abbr, e.team_key, count(DISTINCT tourn_id) AS n_tournaments FROM fx_entries e JOIN fx_tournaments t USING (tourn_id) GROUP BY ALL),
sp AS (SELECT t.season, b.event_abbr, e.team_key, round(avg(b.speaker_points), 6) AS avg_points FROM fx_ballots b JOIN fx_entries e USING (tourn_id, event_abbr, entry_id) JOIN fx_tournaments t USING (tourn_id) WHERE b.speaker_points IS NOT NULL GROUP BY ALL)
SELECT r.season, r.event_abbr, r.team_key, competition_rank, round(CASE WHEN wins + losses = 0 THEN 0.0::DOUBLE ELSE wins::DOUBLE / (wins + losses)::DOUBLE END, 6) AS win_pct, coalesce(prelim_wins, 0) AS prelim_wins, coalesce(prelim_losses, 0) AS prelim_losses, coalesce(elim_wins, 0) AS elim_wins, coalesce(elim_losses, 0) AS elim_losses, n_tournaments, coalesce(full_bids, 0)::BIGINT AS full_bids, avg_points
FROM fx_ratings r JOIN rk USING (season, event_abbr, team_key) LEFT JOIN rs USING (season, event_abbr, team_key) LEFT JOIN nt USING (season, event_abbr, team_key) LEFT JOIN fx_season_bids sb USING (season, event_abbr, team_key) LEFT JOIN sp USING (season, event_abbr, team_key)""", *BET, "fx_ratings", "fx_season_bids")  # fmt: skip
def agg_30_profiles(v):
    p = R.profiles(v.fx_ratings, v.fx_ballots, v.fx_entries, v.fx_tournaments)
    return p.select("season", "event_abbr", "team_key", "competition_rank", "win_pct", "prelim_wins", "prelim_losses", "elim_wins", "elim_losses", "n_tournaments", F.col("full_bids").cast("bigint").alias("full_bids"), "avg_points")


@query("SELECT tourn_id, event_abbr, round_id, dense_rank() OVER (PARTITION BY season, event_abbr ORDER BY start_date, late, no, round_name, tourn_id, round_id)::INT AS nth FROM (SELECT DISTINCT t.season, b.tourn_id, b.event_abbr, b.round_id, t.start_date, CASE WHEN b.round_type = 'prelim' THEN 0 ELSE 1 END AS late, CASE WHEN regexp_matches(b.round_name, '^[0-9]') THEN CAST(regexp_extract(b.round_name, '^[0-9]+') AS INT) ELSE 9999 END AS no, b.round_name FROM fx_ballots b JOIN fx_tournaments t USING (tourn_id)) x", *B, "fx_tournaments")
def sort_06_round_order(v):
    r = v.fx_ballots.select(*T.ROUND, "round_name", "round_type").distinct().join(v.fx_tournaments.select("tourn_id", "season", "start_date"), "tourn_id")
    no = F.when(F.col("round_name").rlike("^[0-9]"), T.number_in(F.col("round_name"))).otherwise(9999)
    w = Window.partitionBy("season", "event_abbr").orderBy("start_date", F.when(F.col("round_type") == "prelim", 0).otherwise(1), no, "round_name", "tourn_id", "round_id")
    return r.withColumn("nth", F.dense_rank().over(w)).select(*T.ROUND, "nth")


@query("SELECT entry_id, n FROM (SELECT entry_id, row_number() OVER (ORDER BY final_rank ASC NULLS LAST, speaker_rank ASC NULLS LAST, entry_id)::INT AS n FROM fx_results WHERE tourn_id = 199506 AND event_abbr = 'LD') x", "fx_results")
def sort_07_nulls_last(v):
    w = Window.orderBy(F.asc_nulls_last("final_rank"), F.asc_nulls_last("speaker_rank"), "entry_id")
    return v.fx_results.filter("tourn_id = 199506 and event_abbr = 'LD'").select("entry_id", F.row_number().over(w).alias("n"))


@query("SELECT tourn_id, event_abbr, bid_level, CASE bid_level WHEN 'Triples' THEN 0 WHEN 'Doubles' THEN 1 WHEN 'Octos' THEN 2 WHEN 'Quarters' THEN 3 WHEN 'Semis' THEN 4 WHEN 'Finals' THEN 5 ELSE 9 END AS depth_order, CASE event_abbr WHEN 'LD' THEN 0 WHEN 'PF' THEN 1 ELSE 2 END AS event_order FROM fx_events", "fx_events")
def sort_08_label_orders(v):
    return v.fx_events.select("tourn_id", "event_abbr", "bid_level", F.coalesce(text.lookup(T.DEPTH_ORDER, F.col("bid_level")), F.lit(9)).alias("depth_order"), text.lookup(T.EVENT_ORDER, F.col("event_abbr")).alias("event_order"))


@query("SELECT id, team_id, name, read_count, n FROM (SELECT id, team_id, name, read_count, row_number() OVER (PARTITION BY team_id ORDER BY read_count DESC, id)::INT AS n FROM fx_wiki_arguments) x WHERE n <= 2", "fx_wiki_arguments")
def sort_09_top_arguments(v):
    n = F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("read_count"), "id"))
    return v.fx_wiki_arguments.withColumn("n", n).filter("n <= 2").select("id", "team_id", "name", "read_count", "n")


@query(f"""WITH {SIZES.replace("round_type <> 'prelim'", "round_type = 'elim'")}, nm AS (SELECT DISTINCT tourn_id, event_abbr, round_id, round_name, entry_id FROM fx_ballots WHERE round_type = 'elim'),
g AS (SELECT nm.tourn_id, nm.event_abbr, nm.round_id, min(round_name) AS round_name, string_agg(display_name, '; ' ORDER BY display_name) AS field FROM nm LEFT JOIN fx_entries e USING (tourn_id, event_abbr, entry_id) GROUP BY ALL),
h AS (SELECT g.*, n_entries, coalesce({DEPTH}, CASE WHEN round_name = 'Finals' THEN 'Finals' END, concat('Round ', round_name)) AS label FROM g JOIN sz USING (tourn_id, event_abbr, round_id))
SELECT tourn_id, event_abbr, round_id, field, label, CASE label WHEN 'Triples' THEN 0 WHEN 'Doubles' THEN 1 WHEN 'Octos' THEN 2 WHEN 'Quarters' THEN 3 WHEN 'Semis' THEN 4 WHEN 'Finals' THEN 5 ELSE -1 END AS label_order FROM h""", *BE)  # fmt: skip
def sort_10_bracket(v):
    return T.bracket(v.fx_ballots, v.fx_entries).select(*T.ROUND, "field", "label", "label_order")


@query("SELECT DISTINCT team_code, school_name FROM fx_codes", "fx_codes")
def set_02_distinct(v):
    return v.fx_codes.select("team_code", "school_name").dropDuplicates()


@query("SELECT tourn_id, event_abbr, entry_id, CASE WHEN tourn_id % 4 = 0 THEN 'new' ELSE place END AS place FROM fx_results", "fx_results")
def src_11_upsert(v):
    base = v.fx_results.select(*T.ENTRY, "place")
    delta = base.filter("tourn_id % 4 = 0")
    both = delta.withColumn("n", F.lit(1)).unionByName(delta.withColumn("place", F.lit("new")).withColumn("n", F.lit(2)))
    return merge.upsert(base, both, T.ENTRY, "n")


@query("SELECT tourn_id, event_abbr, entry_id, coalesce(place, 'none') AS place, final_rank::INT AS final_rank FROM fx_results", "fx_results")
def src_12_partial_upsert(v):
    base = v.fx_results.select(*T.ENTRY, "place", F.col("final_rank").cast("int").alias("final_rank"))
    delta = base.select(*T.ENTRY, F.when(F.col("place").isNull(), "none").alias("place"), F.lit(None).cast("int").alias("final_rank"))
    return merge.upsert_present(base, delta, T.ENTRY)


@query("SELECT id, school, code, (SELECT count(*) FROM fx_wiki_arguments a WHERE a.team_id = t.id) AS n_arguments, (SELECT max(read_count) FROM fx_wiki_arguments a WHERE a.team_id = t.id) AS most_read FROM fx_wiki_teams t", "fx_wiki_teams", "fx_wiki_arguments")
def sea_19_team_details(v):
    a = v.fx_wiki_arguments.groupBy(F.col("team_id").alias("id")).agg(F.count("*").alias("n_arguments"), F.max("read_count").alias("most_read"))
    return v.fx_wiki_teams.join(a, "id", "left").select("id", "school", "code", F.coalesce("n_arguments", F.lit(0)).alias("n_arguments"), "most_read")


@query("SELECT tourn_id, entry_id, display_name AS shortened, regexp_extract(display_name, '([A-Z][A-Za-z]{1,4})$', 1) AS code FROM fx_entries", "fx_entries")
def txt_19_names(v):
    long = F.concat(F.col("school_name"), F.lit(" "), F.substring("school_code", 1, 1), F.lit("lex "), F.substring("school_code", 2, 1), F.lit("lum"))
    return v.fx_entries.select("tourn_id", "entry_id", text.shorten_name(long, F.col("school_name")).alias("shortened"), text.code_of(F.col("display_name")).alias("code"))


@query("SELECT tourn_id, entry_id, team_key, round_no, round(1 / (1 + power(10.0, (r2 - r1) / 400.0)), 6) AS expected FROM (SELECT tourn_id, entry_id, team_key, entry_id % 7 AS round_no, 1500.0 + entry_id % 300 AS r1, 1500.0 + (entry_id * 7) % 400 AS r2 FROM fx_entries) x", "fx_entries")
def mth_01_expected_score(v):
    e = v.fx_entries.select("tourn_id", "entry_id", "team_key", F.expr("cast(entry_id % 7 as bigint)").alias("round_no"), F.expr("1500.0d + entry_id % 300").alias("r1"), F.expr("1500.0d + (entry_id * 7) % 400").alias("r2"))
    return e.select("tourn_id", "entry_id", "team_key", "round_no", F.round(R.expected(F.col("r1"), F.col("r2")), 6).alias("expected"))


@query("""SELECT tourn_id, entry_id, round(CASE WHEN elim AND NOT won THEN 0 ELSE 30 * (CASE WHEN won THEN 1 ELSE 0 END - p) END, 6) AS da, round(CASE WHEN elim AND won THEN 0 ELSE 30 * (CASE WHEN won THEN 0 ELSE 1 END - (1 - p)) END, 6) AS db
FROM (SELECT tourn_id, entry_id, entry_id % 2 = 0 AS won, entry_id % 3 = 0 AS elim, 1 / (1 + power(10.0, ((entry_id * 7) % 400 - entry_id % 300) / 400.0)) AS p FROM fx_entries) x""", "fx_entries")  # fmt: skip
def mth_03_elo_deltas(v):
    a, b = F.expr("1500.0d + entry_id % 300"), F.expr("1500.0d + (entry_id * 7) % 400")
    da, db = R.deltas(a, b, F.expr("entry_id % 2 = 0"), F.expr("if(entry_id % 3 = 0, 'elim', 'prelim')"), F.lit(30.0))
    return v.fx_entries.select("tourn_id", "entry_id", F.round(da, 6).alias("da"), F.round(db, 6).alias("db"))


@query("SELECT DISTINCT o_orderdate::DATE AS day, CASE WHEN month(o_orderdate) >= 7 THEN concat(year(o_orderdate), '-', lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0')) ELSE concat(year(o_orderdate) - 1, '-', lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0')) END AS season FROM orders")
def dt_01_season(v):
    from lectern.functions.dates import season

    return v.orders.select(F.to_date("o_orderdate").alias("day")).distinct().select("day", season(F.col("day")).alias("season"))


@query("SELECT tourn_id, end_date, end_date >= '1996-05-20' AS stale FROM fx_tournaments", "fx_tournaments")
def dt_03_stale(v):
    from lectern.functions.dates import stale_tournament

    crawled = F.lit("1996-05-19").cast("timestamp")
    return v.fx_tournaments.select("tourn_id", "end_date", stale_tournament(crawled, F.col("end_date"), F.lit("1996-05-21 00:00:00").cast("timestamp")).alias("stale"))


@query("SELECT id FROM fx_wiki_teams WHERE id % 5 < 3 AND id % 4 <> 0", "fx_wiki_teams")
def stm_07_due_list(v):
    from lectern.functions.dates import stale_team

    t = v.fx_wiki_teams.withColumn("last_crawled", F.expr("timestamp'2024-01-31' - make_dt_interval(if(id % 5 < 3, 8, 2))")).withColumn("status", F.expr("if(id % 4 = 0, 'crawling', 'ok')"))
    return t.filter(stale_team(F.col("last_crawled"), F.lit("2024-01-31").cast("timestamp")) & (F.col("status") != "crawling")).select("id")


@query("SELECT entry_id, tourn_id, CAST(substr(team_key, 3) AS BIGINT) AS wiki_team_id FROM fx_entries WHERE CAST(substr(team_key, 3) AS BIGINT) NOT IN (SELECT id FROM fx_wiki_teams WHERE event = 'PF')", "fx_entries", "fx_wiki_teams")
def join_16_cascade(v):
    """The teams of one event are deleted, and their entries of all tournaments with them."""
    e = v.fx_entries.select("entry_id", "tourn_id", F.expr("cast(substr(team_key, 3) as bigint)").alias("wiki_team_id"))
    gone = v.fx_wiki_teams.filter("event = 'PF'").select(F.col("id").alias("wiki_team_id"))
    return merge.cascade_delete(e, gone, "wiki_team_id")



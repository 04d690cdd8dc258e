"""Tournaments: listings, pairings, records, placements, brackets, bids and threats.

Frames have the columns of the fixtures: tournaments (tourn_id, name, .., start_date, end_date, season),
events (tourn_id, event_abbr, bid_level), entries (tourn_id, event_abbr, entry_id, team_key, ..), ballots and
results. Everything is keyed by (tourn_id, event_abbr, ..), for all tournaments at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.sources.scratch import written

#: Fixed values, each as its operator has it.
DEPTH_OF_ENTRIES = {"256": "Doubles", "128": "Doubles", "64": "Triples", "32": "Doubles", "16": "Octos", "8": "Quarters", "4": "Semis", "2": "Finals"}
RATED_DEPTH_OF_ENTRIES = {"64": "Triples", "32": "Doubles", "16": "Octos", "8": "Quarters", "4": "Semis", "2": "Finals"}
LEVEL_OF_FULL_BIDS = {"128": "Triples", "64": "Triples", "32": "Doubles", "16": "Octos", "8": "Quarters", "4": "Semis", "2": "Finals"}
PLACE_ORDER = {"1st": 0, "2nd": 1, "Semis": 3, "Quarters": 4, "Octos": 5, "Doubles": 6, "Triples": 7, "Prelim": 99}
DEPTH_ORDER = {"Triples": 0, "Doubles": 1, "Octos": 2, "Quarters": 3, "Semis": 4, "Finals": 5}
BID_RANK = {"Triples": 1, "Doubles": 2, "Octos": 3, "Quarters": 4, "Semis": 5, "Finals": 6}
EVENT_ORDER = {"LD": 0, "PF": 1, "CX": 2}
BID_LEVEL_WEIGHT = {"Triples": 1.0, "Doubles": 0.9, "Octos": 0.75, "Quarters": 0.6, "Semis": 0.45, "Finals": 0.3}

ROUND = ["tourn_id", "event_abbr", "round_id"]
ENTRY = ["tourn_id", "event_abbr", "entry_id"]
PRELIM = ("prelim", "highlow")


def number_in(name: Column) -> Column:
    """The number that a name begins with, else 0."""
    return F.coalesce(F.regexp_extract(name, "^\\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0))


def listed(tournaments: DataFrame, events: DataFrame, season: str, when: str | None = None, as_of: str = "") -> DataFrame:
    """Domestic tournaments of a season with a bid event, and the championship itself."""
    t = tournaments.filter(F.col("season") == season).filter(F.col("country").isNull() | F.upper("country").isin("US", "USA", "UNITED STATES"))
    t = t.filter(~F.lower("name").contains("international initiative toc test"))
    if when:
        t = t.filter(F.col("end_date") >= as_of if when == "upcoming" else F.col("end_date") < as_of)
    with_bids = events.filter("bid_level is not null").select("tourn_id").distinct().withColumn("_bids", F.lit(True))
    low = F.lower("name")
    return t.join(with_bids, "tourn_id", "left").filter(F.col("_bids") | (low.contains("tournament of champions") & ~low.contains("middle school"))).drop("_bids").orderBy("start_date", "tourn_id")


def free_text(tournaments: DataFrame, query: str) -> DataFrame:
    q = query.strip().lower()
    return tournaments.filter(F.lower(text.text(F.col("name"))).contains(q) | F.lower(text.text(F.col("city"))).contains(q) | F.lower(text.text(F.col("state"))).contains(q))


def teams_of_event(teams: DataFrame, event: str, query: str = "", limit: int = 100) -> DataFrame:
    q = query.strip().lower()
    rows = teams.filter(F.lower("event") == event.lower())
    rows = rows.filter(F.lower("school").contains(q) | F.lower("code").contains(q) | F.lower("full_name").contains(q)) if q else rows
    return rows.orderBy(F.lower("school"), F.lower("code"), "id").limit(limit)


def majority(w: Column, losses: Column) -> Column:
    """W, L, or null on a tie or where nobody voted."""
    return F.when(w > losses, "W").when(losses > w, "L")


#: A task that counts ballots of entries holds about so many.
TASK_ROWS = 500_000


def parts(ballots: DataFrame) -> int:
    """How many tasks ballots are dealt to, so that what one holds doesn't grow with them."""
    return max(int(ballots.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + ballots.count() // TASK_ROWS)


def round_results(ballots: DataFrame, tasks: int | None = None) -> DataFrame:
    """A row for each entry and round: result by majority, the first opponent by ballot, w and l votes, round name and type.

    Ballots are dealt by entry, so what is counted or joined by entry or round after that needs no other exchange.
    tasks: how many (see `parts`), where counting ballots would read more than a table.
    """
    held = ballots.select(*ENTRY, "round_id", "round_name", "round_type", "result", "opponent_entry_id", "ballot_id").repartition(tasks or parts(ballots), *ENTRY)
    return held.groupBy(*ENTRY, "round_id").agg(
        F.min("round_name").alias("round_name"), F.min("round_type").alias("round_type"), F.count_if(F.col("result") == "W").alias("w"), F.count_if(F.col("result") == "L").alias("l"),
        F.min_by("opponent_entry_id", F.when(F.col("opponent_entry_id").isNotNull(), F.col("ballot_id"))).alias("opponent_entry_id"), F.min("ballot_id").alias("first_ballot"),
    ).withColumn("result", majority(F.col("w"), F.col("l")))


def records(ballots: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rounds won and lost before and in the bracket; a panel is one round; a tie or no vote counts as won."""
    r = round_results(ballots, tasks)
    early, lost = F.col("round_type").isin(*PRELIM), F.col("l") > F.col("w")
    return r.groupBy(*ENTRY).agg(
        F.count_if(early & ~lost).alias("prelim_wins"), F.count_if(early & lost).alias("prelim_losses"), F.count_if(~early & ~lost).alias("elim_wins"), F.count_if(~early & lost).alias("elim_losses")
    )


def bracket_depths(ballots: DataFrame, of: dict[str, str] = DEPTH_OF_ENTRIES, types: tuple[str, ...] | None = None) -> DataFrame:
    """Entries of each round beyond the prelims, and the bracket's name for so many."""
    later = ballots.filter(F.col("round_type").isin(*types)) if types else ballots.filter("round_type <> 'prelim'")
    n = later.select(*ROUND, "entry_id").distinct().groupBy(*ROUND).agg(F.count("*").alias("n_entries"))
    return n.withColumn("depth", text.lookup(of, F.col("n_entries").cast("string")))


def placements(ballots: DataFrame, entries: DataFrame) -> DataFrame:
    """Places from the deepest bracket round: 1st and 2nd of the final, else the bracket's or the round's name, else Prelim."""
    known = ballots.join(entries.select(*ENTRY).distinct(), ENTRY, "left_semi")
    elim = known.filter(~F.col("round_type").isin(*PRELIM))
    size = elim.select(*ROUND, "entry_id").distinct().groupBy(*ROUND).agg(F.count("*").alias("n_entries"))
    tasks = parts(ballots)
    deepest = round_results(elim, tasks).join(size, ROUND).groupBy(*ENTRY).agg(F.min(F.struct("n_entries", "round_id", "round_name", "w", "l")).alias("d"))
    won = F.col("d.w") > F.col("d.l")
    named = F.coalesce(text.lookup(DEPTH_OF_ENTRIES, F.col("d.n_entries").cast("string")), F.concat(F.lit("Round "), F.col("d.round_name")))
    place = F.when(F.col("d").isNull(), "Prelim").when(F.col("d.n_entries") == 2, F.when(won, "1st").otherwise("2nd")).otherwise(named)
    return records(known, tasks).join(deepest, ENTRY, "left").withColumn("place", place).drop("d").withColumn("place_order", F.coalesce(text.lookup(PLACE_ORDER, F.col("place")), F.lit(50)))


def pairings(ballots: DataFrame, entries: DataFrame) -> DataFrame:
    """A row for each entry and round: opponent, judges in order, votes, result, mean points."""
    b = ballots.join(entries.select("tourn_id", "event_abbr", F.col("entry_id").alias("opponent_entry_id"), F.col("display_name").alias("opponent_name")), ["tourn_id", "event_abbr", "opponent_entry_id"], "left")
    ordered = lambda c, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ballot_id", c)))), lambda x: x[c])
    voted = F.col("result").isin("W", "L")
    out = b.groupBy(*ENTRY, "round_id").agg(
        F.min("round_type").alias("round_type"), F.min("round_name").alias("round_name"), F.min_by("side", "ballot_id").alias("side"), F.min_by("opponent_name", "ballot_id").alias("opponent_name"),
        F.array_join(F.array_distinct(ordered("judge_name", F.col("judge_name").isNotNull())), ", ").alias("judges"), F.array_join(ordered("result", voted), "").alias("votes"),
        F.count_if(F.col("result") == "W").alias("w"), F.count_if(F.col("result") == "L").alias("l"), F.round(F.avg("speaker_points"), 6).alias("speaker_points"),
    )
    depth = bracket_depths(ballots).select(*ROUND, "depth")
    return out.join(depth, ROUND, "left").withColumn("result", majority(F.col("w"), F.col("l"))).withColumn("ballot_count", F.col("w") + F.col("l")).drop("w", "l")


def matches(ballots: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row for each decided match: a and b, a_result by the side with the earliest ballot; byes and absent opponents are left out.

    The two sides meet by an equality join on round and entry; of the pair, the row whose own ballot comes
    first is kept.
    """
    r = round_results(ballots, tasks).filter("result is not null and opponent_entry_id is not null")
    other = r.select(*ROUND, F.col("entry_id").alias("opponent_entry_id"), F.col("first_ballot").alias("other_ballot"))
    both = r.join(other, [*ROUND, "opponent_entry_id"]).filter("first_ballot < other_ballot")
    return both.select(*ROUND, "round_name", "round_type", F.col("entry_id").alias("a"), F.col("opponent_entry_id").alias("b"), F.col("result").alias("a_result"), "first_ballot")


def season_bids(entries: DataFrame, tournaments: DataFrame) -> DataFrame:
    """Full and other bids of each team, event and season."""
    full = F.col("earned_bid") == "Full"
    return entries.join(tournaments.select("tourn_id", "season"), "tourn_id").groupBy("season", "team_key", "event_abbr").agg(
        F.count_if(full).alias("full_bids"), F.count_if(F.col("earned_bid").isNotNull() & ~full).alias("partial_bids"), F.max("display_name").alias("display_name"), F.max("school_code").alias("school_code")
    )


def linked_team(entries: DataFrame, teams: DataFrame) -> DataFrame:
    """entries with wiki_team_id: the first team of the same school whose code is a word of the entry's name.

    A code may be several words: a name gives its runs of at most as many as the longest code has, and meets codes by equality.
    Each name and each code of a school does so once, whatever number of entries and teams have it.
    """
    codes = teams.select(F.lower("school").alias("_school"), F.lower("code").alias("_run"), "id").groupBy("_school", "_run").agg(F.min("id").alias("wiki_team_id"))
    longest = codes.agg(F.max(F.size(F.split("_run", " "))).alias("_longest"))
    words, n = F.split("_name", " "), F.size(F.split("_name", " "))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda at: F.transform(F.sequence(F.lit(1), F.least(F.col("_longest"), n - at + 1)), lambda long: F.array_join(F.slice(words, at, long), " "))))
    names = entries.select(F.lower("school_name").alias("_school"), F.lower("display_name").alias("_name")).distinct().filter("_name is not null")
    each = names.crossJoin(F.broadcast(longest.filter("_longest is not null"))).select("_school", "_name", F.explode(F.array_distinct(runs)).alias("_run"))
    found = written(each.join(codes.hint("merge"), ["_school", "_run"]).groupBy("_school", "_name").agg(F.min("wiki_team_id").alias("wiki_team_id")), "linked")
    linked = entries.join(found, (F.lower("school_name") == F.col("_school")) & (F.lower("display_name") == F.col("_name")), "left")
    return linked.select(*(entries[c] for c in entries.columns), "wiki_team_id")


def threats(entries: DataFrame, bids: DataFrame, tournaments: DataFrame) -> DataFrame:
    """entries with the season's bids of their teams, 0 where there are none."""
    e = entries.join(tournaments.select("tourn_id", "season"), "tourn_id")
    b = bids.select("season", "team_key", "event_abbr", F.col("full_bids").alias("season_full_bids"), F.col("partial_bids").alias("season_partial_bids"))
    return e.join(b, ["season", "team_key", "event_abbr"], "left").fillna(0, ["season_full_bids", "season_partial_bids"])


def place_number(place: Column) -> Column:
    """The number of a place, or that of its bracket round."""
    n = F.regexp_extract(text.text(place), "^([0-9]+)", 1).try_cast("int")
    return F.coalesce(n, text.lookup({"Finals": 2, "Semis": 4, "Quarters": 8, "Octos": 16, "Doubles": 32, "Triples": 64}, text.normal_place(place)))


def team_placements(results: DataFrame, entries: DataFrame, tournaments: DataFrame, events: DataFrame) -> DataFrame:
    """season, event_abbr, team_key, place, bid_level of every result with a place."""
    r = results.filter("place is not null").join(entries.select(*ENTRY, "team_key"), ENTRY).join(tournaments.select("tourn_id", "season"), "tourn_id")
    return r.join(events.select("tourn_id", "event_abbr", "bid_level"), ["tourn_id", "event_abbr"]).select("season", "event_abbr", "team_key", "place", place_number(F.col("place")).alias("place_number"), "bid_level")


def placement_score(placements: DataFrame) -> DataFrame:
    """season, event_abbr, team_key, score: the three best places, weighted by level."""
    key = ["season", "event_abbr", "team_key"]
    weight = F.coalesce(text.lookup(BID_LEVEL_WEIGHT, F.col("bid_level")), F.lit(0.2))
    bonus = F.greatest(F.lit(0), 17 - F.coalesce("place_number", F.lit(16))) * weight
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.coalesce("place_number", F.lit(99)), F.desc(weight)))
    return placements.withColumn("_n", n).filter("_n <= 3").groupBy(*key).agg(F.sum(bonus).alias("score"))


def min_max(column: str, keys: list[str]) -> Column:
    """(v - min) / (max - min) within the keys; 1 where all are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return F.when(hi == lo, 1.0).otherwise((F.col(column) - lo) / (hi - lo))


def scored_threats(rows: DataFrame, scores: DataFrame, cap: int = 30) -> DataFrame:
    """The `cap` entries of each tournament and event with the largest 0.6 bids + 0.4 placements, both scaled."""
    field = ["tourn_id", "event_abbr"]
    s = rows.join(scores, ["season", "event_abbr", "team_key"], "left").withColumn("placement_score", F.coalesce("score", F.lit(0.0))).withColumn("season_bids", F.col("season_full_bids") + F.col("season_partial_bids"))
    s = s.withColumn("score", F.round(0.6 * min_max("season_bids", field) + 0.4 * min_max("placement_score", field), 6))
    n = F.row_number().over(Window.partitionBy(*field).orderBy(F.desc("score"), "entry_id"))
    return s.withColumn("nth", n).filter(F.col("nth") <= cap)


def bracket(ballots: DataFrame, entries: DataFrame) -> DataFrame:
    """A row for each bracket round: its name, order and the entries in it."""
    elim = ballots.filter("round_type = 'elim'")
    depth = bracket_depths(elim)
    label = F.coalesce("depth", F.when(F.col("round_name").isin(*DEPTH_ORDER), F.col("round_name")), F.concat(F.lit("Round "), F.col("round_name")))
    named = elim.select(*ROUND, "round_name", "entry_id").distinct().join(entries.select(*ENTRY, "display_name"), ENTRY, "left")
    # names go to their round as they are, so no task sorts lists of all rounds
    rounds = named.repartition(*ROUND).groupBy(*ROUND).agg(F.min("round_name").alias("round_name"), F.array_join(F.array_sort(F.collect_list("display_name")), "; ").alias("field"))
    out = rounds.join(depth, ROUND).withColumn("label", label)
    return out.withColumn("label_order", F.coalesce(text.lookup(DEPTH_ORDER, F.col("label")), F.lit(-1)))


def dedupe_events(events: DataFrame) -> DataFrame:
    """One event of each kind for a tournament: the one with the highest bid level."""
    rank = F.coalesce(text.lookup(BID_RANK, F.col("bid_level")), F.lit(0))
    rows = events.filter(F.col("event_abbr").isin(*EVENT_ORDER)).groupBy("tourn_id", "event_abbr").agg(F.max_by("bid_level", rank).alias("bid_level"))
    return rows.withColumn("event_order", text.lookup(EVENT_ORDER, F.col("event_abbr")))


def shown_places(results: DataFrame) -> DataFrame:
    """What to show as each result's place, in the order of final ranks with prelims last."""
    r = results.filter("place is not null or final_rank is not null").withColumn("_prelim", F.lower(text.text(F.col("place"))).startswith("prelim"))
    pos = F.row_number().over(Window.partitionBy("tourn_id", "event_abbr").orderBy("_prelim", F.asc_nulls_last("final_rank"), "entry_id"))
    norm, rank = text.normal_place(F.col("place")), F.col("final_rank")
    shown = (
        F.when(norm == "Finals", F.when(rank == 1, "1st").otherwise("2nd")).when(rank == 1, "1st").when(rank == 2, "2nd").when(rank == 3, "Semis")
        .when(norm != "", norm).when(rank.isNotNull(), text.ordinal(rank)).otherwise(text.ordinal(F.col("position")))
    )
    return r.withColumn("position", pos).withColumn("shown", shown).drop("_prelim")


#: Fixed values.
NON_VARSITY_NAME = r"(?i)novice|junior\s*varsity|\bjv\b|\bjunior\b|\bms\b|middle\s*school|rising\s*star|\bCFL\b|\bCHSSA\b|-\s*CA\b|\bCA\s*(?:bracket|division|championship)"
SIDE_EVENT_NAME = r"(?i)round\s*robin|challenge|showcase|exhibit|invitational\s*round"
NON_VARSITY_ABBR = ("JVLD", "JVPF", "JVCX", "JVPOL", "JVPOLICY", "NLD", "NPF", "NCX", "NPOL", "NPOLICY", "MSLD", "MSPF", "MSCX", "NOVLD", "NOVPF", "NOVCX", "JRVLD", "JRVPF", "JRVCX")
NON_VARSITY_ABBR_FORM = r"^JV|^MS[A-Z]|^NOV|^N(LD|PF|CX|POL)|RR$|-CA$|-RS$|^J(LD|PF|CX|POL)"


def non_varsity(name: Column, abbr: Column) -> Column:
    n, a = text.text(name), F.upper(text.text(abbr))
    return n.rlike(text.js(NON_VARSITY_NAME)) | n.rlike(SIDE_EVENT_NAME) | a.isin(*NON_VARSITY_ABBR) | a.rlike(NON_VARSITY_ABBR_FORM)


def canonical_abbr(*texts: Column) -> Column:
    """LD, PF or CX from the first of the texts that says so."""

    def one(c: Column) -> Column:
        s = F.upper(text.text(c))
        return F.when(s.rlike(text.js(NON_VARSITY_NAME)), None).when(s.rlike(text.js(r"\bV?LD\b|LINCOLN[-\s]?DOUGLAS")), "LD").when(s.rlike(text.js(r"\bV?PF\b|PUBLIC\s*FORUM")), "PF").when(s.rlike(text.js(r"\bV?CX\b|POLICY(?!\s*DEBATE.*SPEAKER)")), "CX")

    return F.coalesce(*(one(c) for c in texts))


def argument_reads(rounds: DataFrame, cites: DataFrame) -> DataFrame:
    """A row for each read of an argument: rounds with their cites, or the round itself where it has none."""
    base = F.when(F.col("side") == "A", "aff").when(F.col("side") == "N", "neg")
    j = rounds.join(cites.withColumn("_cite", F.lit(True)), "round_id", "left")
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat_ws(" ", "tournament", "round"))
    cited = F.col("_cite").isNotNull()
    own = F.when(F.col("opensource").isNotNull(), F.concat(F.lit("Open-source docx: "), F.col("opensource"))).otherwise("")
    return j.select(
        "team_id", "round_id", "n", "created_at", "tournament", "round", "opponent", "opensource",
        F.when(cited, text.strip_tournament_prefix(title)).otherwise(F.trim(F.concat_ws(" ", "tournament", "round"))).alias("name"),
        F.when(cited, text.infer_side(F.col("title"), F.col("side"))).otherwise(base).alias("arg_side"), F.when(cited, text.text(F.col("cites"))).otherwise(own).alias("full_text"),
    )


def arguments(reads: DataFrame) -> DataFrame:
    """Arguments of a team by side and name: reads, the first non-empty text and the name as first written."""
    place = F.struct("created_at", "round_id", "n", "full_text")
    return reads.groupBy("team_id", "arg_side", F.lower("name").alias("name_key")).agg(
        F.count("*").alias("read_count"), F.min_by("name", place).alias("name"), F.coalesce(F.min_by("full_text", F.when(F.col("full_text") != "", place)), F.lit("")).alias("full_text"),
        F.min_by("opensource", place).alias("opensource"), F.min_by("tournament", place).alias("tournament"),
    )


#: Fixed values.
NOT_ARGUMENTS = r"(?i)^contacts?$|^(email|phone|contact|reach|dm|text|instagram|snap|discord|misdisclos)|^team\s*info$|^notes?$|^read\s*me$|^test$"
PLACEHOLDERS = ("test", "n/a", "na", "none", "x", "tbd")


def is_junk(name: Column, full_text: Column, opensource: Column, tournament: Column) -> Column:
    n = F.trim(text.text(name))
    return (
        (n == "") | n.rlike(NOT_ARGUMENTS) | ((text.text(opensource) == "") & (text.visible_length(full_text) < 30)) | ~n.rlike("[A-Za-z0-9]") | F.lower(F.trim(text.text(tournament))).isin(*PLACEHOLDERS)
    )

"""Inputs of the registered queries: views over the given tables, in SQL that Spark and DuckDB both read.

Where the two differ, a view has one text for each. `Views` makes them for a session; `with_views` puts the
same text before a DuckDB query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lectern.operators.tournaments import parts
from lectern.sources.scratch import fresh

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FX_CARDS = """
SELECT doc_id, concat('c', lpad(CAST(doc_id AS VARCHAR(12)), 8, '0')) AS id,
  CASE doc_id % 4 WHEN 0 THEN 'hsld25' WHEN 1 THEN 'hspolicy24' WHEN 2 THEN 'ndtceda25' ELSE 'open' END AS division,
  concat(CASE doc_id % 4 WHEN 0 THEN 'hsld25' WHEN 1 THEN 'hspolicy24' WHEN 2 THEN 'ndtceda25' ELSE 'open' END, '-all.zip') AS zip_path,
  concat('School ', source) AS school, concat('Team ', CAST(doc_id % 7 AS VARCHAR(2))) AS squad,
  concat('f', CAST(doc_id % 50 AS VARCHAR(3)), '.docx') AS source_entry,
  regexp_extract(text, '[^ ]+( [^ ]+){0,7}', 0) AS tag,
  CASE WHEN doc_id % 40 = 7 THEN '' ELSE concat(upper(substr(lang,1,1)), substr(lang,2), 'son ', chr(39), lpad(CAST(doc_id % 30 AS VARCHAR(2)), 2, '0')) END AS cite,
  CASE WHEN doc_id % 3 = 0 THEN text ELSE concat('==', substr(text,1,40), '== <u>', substr(text,41,120), '</u> ', substr(text,161)) END AS body_markdown,
  text AS body_plain,
  CASE doc_id % 6 WHEN 0 THEN '["policy"]' WHEN 1 THEN '["k"]' WHEN 2 THEN '["phil","k"]' WHEN 3 THEN '["theory"]' WHEN 4 THEN '["tricks"]' ELSE '["none"]' END AS argument_types,
  CASE doc_id % 5 WHEN 0 THEN '["deterrence","china"]' WHEN 1 THEN '["nfu"]' WHEN 2 THEN '["da","econ"]' WHEN 3 THEN '[]' ELSE '["settler colonialism"]' END AS argument_tags,
  CASE WHEN doc_id % 5 = 0 THEN 'personal' ELSE 'wiki' END AS source_kind,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat('Bucket ', CAST(doc_id % 4 AS VARCHAR(1))) END AS topic_bucket,
  concat('2026-', lpad(CAST(doc_id % 12 + 1 AS VARCHAR(2)),2,'0'), '-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR(2)),2,'0')) AS imported_at
FROM documents
"""

#: Tags of plain words, of which one may have its first or its last letter apart.
FX_SPLIT_TAGS_SPARK = """
SELECT id, doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN 'a ' ELSE '' END, array_join(transform(slice(regexp_extract_all(lower(body_plain), '[a-z]{2,}', 0), 1, 8), (x, i) -> CASE
  WHEN i <> doc_id % 8 OR length(x) < 3 THEN x WHEN doc_id % 3 = 0 THEN concat(substr(x, 1, 1), ' ', substr(x, 2)) WHEN doc_id % 3 = 1 THEN concat(substr(x, 1, length(x) - 1), ' ', right(x, 1)) ELSE x END), ' ')) AS tag FROM fx_cards
"""

FX_SPLIT_TAGS_DUCK = """
SELECT id, doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN 'a ' ELSE '' END, array_to_string(list_transform(regexp_extract_all(lower(body_plain), '[a-z]{2,}')[1:8], lambda x, i: CASE
  WHEN i - 1 <> doc_id % 8 OR length(x) < 3 THEN x WHEN doc_id % 3 = 0 THEN concat(x[1], ' ', x[2:]) WHEN doc_id % 3 = 1 THEN concat(x[:-2], ' ', x[-1]) ELSE x END), ' ')) AS tag FROM fx_cards
"""

FX_TOURNAMENTS = """
SELECT tourn_id,
  CASE WHEN tourn_id % 10 = 4 THEN 'Tournament of Champions' WHEN tourn_id % 10 = 5 THEN 'Middle School Tournament of Champions' ELSE concat('Invitational ', CAST(tourn_id AS VARCHAR(8))) END AS name,
  concat('City ', CAST(tourn_id % 6 AS VARCHAR(1))) AS city, concat('S', CAST(tourn_id % 4 AS VARCHAR(1))) AS state,
  CASE tourn_id % 5 WHEN 0 THEN 'US' WHEN 1 THEN NULL WHEN 2 THEN 'usa' WHEN 3 THEN 'CA' ELSE 'United States' END AS country,
  concat(CAST(y AS VARCHAR(4)), '-', lpad(CAST(m AS VARCHAR(2)),2,'0'), '-05') AS start_date,
  concat(CAST(y AS VARCHAR(4)), '-', lpad(CAST(m AS VARCHAR(2)),2,'0'), '-25') AS end_date,
  CASE WHEN m>=7 THEN concat(CAST(y AS VARCHAR(4)),'-',lpad(CAST((y+1)%100 AS VARCHAR(2)),2,'0')) ELSE concat(CAST(y-1 AS VARCHAR(4)),'-',lpad(CAST(y%100 AS VARCHAR(2)),2,'0')) END AS season
FROM (SELECT DISTINCT year(l_shipdate)*100+month(l_shipdate) AS tourn_id, year(l_shipdate) AS y, month(l_shipdate) AS m FROM lineitem) t
"""

FX_EVENTS = """
SELECT tourn_id, tourn_id*10+evn AS event_id, CASE evn WHEN 0 THEN 'LD' WHEN 1 THEN 'PF' ELSE 'CX' END AS event_abbr,
  CASE (tourn_id*3+evn) % 8 WHEN 0 THEN 'Triples' WHEN 1 THEN 'Doubles' WHEN 2 THEN 'Octos' WHEN 3 THEN 'Quarters' WHEN 4 THEN 'Semis' WHEN 5 THEN 'Finals' END AS bid_level
FROM (SELECT DISTINCT year(l_shipdate)*100+month(l_shipdate) AS tourn_id, l_linenumber % 3 AS evn FROM lineitem) t
"""

FX_ENTRIES = """
SELECT t.tourn_id, CASE t.evn WHEN 0 THEN 'LD' WHEN 1 THEN 'PF' ELSE 'CX' END AS event_abbr, t.team*10+t.evn AS entry_id,
  concat('s:', CAST(t.team AS VARCHAR(12))) AS team_key, concat('School ', n.n_name) AS school_name,
  concat(chr(CAST(65 + t.team % 26 AS INT)), chr(CAST(65 + CAST(floor(t.team/26.0) AS INT) % 26 AS INT))) AS school_code,
  concat('School ', n.n_name, ' ', chr(CAST(65 + t.team % 26 AS INT)), chr(CAST(65 + CAST(floor(t.team/26.0) AS INT) % 26 AS INT))) AS display_name,
  CASE (t.tourn_id+t.team) % 9 WHEN 0 THEN 'Full' WHEN 1 THEN 'Silver Bid' WHEN 2 THEN 'Ghost Bid' END AS earned_bid
FROM (SELECT DISTINCT year(l_shipdate)*100+month(l_shipdate) AS tourn_id, l_linenumber % 3 AS evn, l_suppkey AS team FROM lineitem) t
JOIN supplier s ON s.s_suppkey = t.team JOIN nation n ON n.n_nationkey = s.s_nationkey
"""

FX_BALLOTS = """
WITH li AS (
  SELECT l_suppkey AS team, year(l_shipdate)*100+month(l_shipdate) AS tourn_id, l_linenumber % 3 AS evn,
         CAST(floor((day(l_shipdate)-1)/5.0) AS INT)+1 AS round_no,
         l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount FROM lineitem),
one AS (SELECT * FROM (SELECT li.*, row_number() OVER (PARTITION BY tourn_id, evn, round_no, team
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM li) q WHERE k = 1),
seat AS (SELECT one.*, CAST(floor((row_number() OVER (PARTITION BY tourn_id, evn, round_no
         ORDER BY l_extendedprice, team)-1)/2.0) AS INT) AS section FROM one),
pair AS (SELECT a.*, b.team AS opp, b.l_quantity AS oq, b.l_extendedprice AS oe, b.l_discount AS od FROM seat a
         LEFT JOIN seat b ON a.tourn_id=b.tourn_id AND a.evn=b.evn AND a.round_no=b.round_no AND a.section=b.section AND a.team<>b.team),
j AS (SELECT pair.*, judge.j AS judge_no FROM pair CROSS JOIN (VALUES (0),(1),(2)) AS judge(j) WHERE judge.j = 0 OR round_no >= 5)
SELECT CAST((tourn_id*10+evn)*10+round_no AS BIGINT)*100000000 + team*3 + judge_no AS ballot_id,
  tourn_id, CASE evn WHEN 0 THEN 'LD' WHEN 1 THEN 'PF' ELSE 'CX' END AS event_abbr,
  (tourn_id*10+evn)*10+round_no AS round_id,
  CASE WHEN round_no = 7 THEN 'Finals' ELSE CAST(round_no AS VARCHAR(1)) END AS round_name,
  CASE WHEN round_no < 5 THEN 'prelim' ELSE 'elim' END AS round_type,
  team*10+evn AS entry_id, opp*10+evn AS opponent_entry_id,
  CASE WHEN opp IS NULL THEN NULL WHEN team < opp THEN 'aff' ELSE 'neg' END AS side,
  concat('Judge ', CAST((tourn_id+section+judge_no) % 17 AS VARCHAR(2))) AS judge_name,
  CASE WHEN opp IS NULL THEN NULL
       WHEN judge_no = 0 THEN CASE WHEN l_quantity > oq THEN 'W' WHEN l_quantity < oq THEN 'L' END
       WHEN judge_no = 1 THEN CASE WHEN l_extendedprice > oe THEN 'W' WHEN l_extendedprice < oe THEN 'L' END
       ELSE CASE WHEN l_discount > od THEN 'W' WHEN l_discount < od THEN 'L' END END AS result,
  CASE WHEN opp IS NULL OR round_no >= 5 THEN NULL ELSE 25.0 + l_quantity / 10.0 END AS speaker_points
FROM j
"""

#: The same rows with one sort of a round: who sits next to whom is the row before or after, so no join of the round with itself.
FX_BALLOTS_SPARK = FX_BALLOTS[: FX_BALLOTS.index("seat AS (")].replace(" FROM li) q", " FROM (SELECT /*+ REPARTITION({parts}, tourn_id, evn, round_no, team) */ * FROM li) li) q") + """numbered AS (SELECT team, tourn_id, evn, round_no, l_quantity, l_extendedprice, l_discount, row_number() OVER r AS n, struct(lag(team) OVER r AS team, lag(l_quantity) OVER r AS q, lag(l_extendedprice) OVER r AS e, lag(l_discount) OVER r AS d) AS before,
         struct(lead(team) OVER r AS team, lead(l_quantity) OVER r AS q, lead(l_extendedprice) OVER r AS e, lead(l_discount) OVER r AS d) AS after FROM (SELECT /*+ REPARTITION({parts}, tourn_id, evn, round_no) */ * FROM one) one WINDOW r AS (PARTITION BY tourn_id, evn, round_no ORDER BY l_extendedprice, team)),
seat AS (SELECT *, CAST(floor((n-1)/2.0) AS INT) AS section, CASE WHEN n % 2 = 0 THEN before ELSE after END AS o FROM numbered),
pair AS (SELECT *, o.team AS opp, o.q AS oq, o.e AS oe, o.d AS od FROM seat),
j AS (SELECT *, explode(CASE WHEN round_no >= 5 THEN array(0, 1, 2) ELSE array(0) END) AS judge_no FROM pair)
""" + FX_BALLOTS[FX_BALLOTS.index("SELECT CAST((tourn_id*10+evn)*10") :]

FX_RESULTS = """
SELECT tourn_id, event_abbr, entry_id,
  CASE WHEN rk = 1 THEN '1st' WHEN rk = 2 THEN '2nd' WHEN rk <= 4 THEN 'Semis' WHEN rk <= 8 THEN 'QF' WHEN rk <= 16 THEN 'octafinals' END AS place,
  CASE WHEN rk <= 16 THEN rk END AS final_rank, CASE WHEN srk <= 20 THEN srk END AS speaker_rank
FROM (SELECT tourn_id, event_abbr, entry_id,
        row_number() OVER (PARTITION BY tourn_id, event_abbr ORDER BY (entry_id*7919) % 1009, entry_id) AS rk,
        row_number() OVER (PARTITION BY tourn_id, event_abbr ORDER BY (entry_id*104729) % 1013, entry_id) AS srk
      FROM fx_entries) q
"""

FX_ENTRY_PATHS = """
SELECT id, concat(division, '/', school, '/', squad, '/', source_entry) AS entry, doc_id * 10 + 100 AS size FROM fx_cards
"""

FX_PARAGRAPHS_SPARK = """
SELECT c.doc_id, concat(c.division, '/', c.id, '.docx') AS entry, CAST(p.pos AS INT) AS pos,
  CASE WHEN p.pos % 6 = 0 THEN 'Heading4' ELSE '' END AS style, CASE WHEN p.pos % 6 = 1 AND c.cite <> '' THEN c.cite ELSE p.raw END AS text
FROM fx_cards c LATERAL VIEW posexplode(split(c.body_plain, chr(10))) p AS pos, raw WHERE trim(p.raw) <> ''
"""

FX_PARAGRAPHS_DUCK = """
SELECT doc_id, concat(division, '/', id, '.docx') AS entry, pos, CASE WHEN pos % 6 = 0 THEN 'Heading4' ELSE '' END AS style, CASE WHEN pos % 6 = 1 AND cite <> '' THEN cite ELSE raw END AS text
FROM (SELECT *, CAST(unnest(range(len(string_split(body_plain, chr(10))))) AS INT) AS pos, unnest(string_split(body_plain, chr(10))) AS raw FROM fx_cards) x WHERE trim(raw) <> ''
"""

FX_CITES = """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN cite WHEN 1 THEN replace(cite, chr(39), '20') WHEN 2 THEN replace(cite, chr(39), '')
  WHEN 3 THEN replace(cite, chr(39), '6-13-20') ELSE lower(cite) END AS cite FROM fx_cards WHERE cite <> ''
"""

FX_ANALYTICS = """
SELECT concat('a', CAST(doc_id AS VARCHAR(12))) AS id, tag AS title, body_plain AS content_plain, zip_path, source_entry, imported_at FROM fx_cards
"""

FX_SAVED = """
SELECT conv_id * 1000 + turn AS seq, CAST(conv_id % 50 AS VARCHAR(4)) AS user_id, regexp_extract(text, '[^ ]+( [^ ]+){0,7}', 0) AS tag, '' AS cite, text AS body
FROM conversations WHERE role = 'user'
"""

FX_CONTENTIONS = """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE lang END AS topic, text AS body FROM documents
"""

FX_CODES = """
SELECT e.tourn_id, e.display_name AS team_code, e.school_name, e.event_abbr, e.entry_id, t.start_date, t.end_date, t.name FROM fx_entries e JOIN fx_tournaments t ON t.tourn_id = e.tourn_id
"""

FX_LINKS = """
SELECT DISTINCT team_key AS user_id, display_name AS team_code, school_name FROM fx_entries WHERE team_key IN ('s:1', 's:2', 's:3', 's:4', 's:5', 's:6', 's:7', 's:8')
"""

FX_WIKI_TEAMS = """
SELECT s.s_suppkey AS id, concat('School ', n.n_name) AS school,
  concat(chr(CAST(65 + s.s_suppkey % 26 AS INT)), chr(CAST(65 + CAST(floor(s.s_suppkey/26.0) AS INT) % 26 AS INT))) AS code,
  concat('School ', n.n_name, ' ', s.s_name) AS full_name, CASE s.s_suppkey % 3 WHEN 0 THEN 'LD' WHEN 1 THEN 'PF' ELSE 'CX' END AS event
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
"""

FX_WIKI_ARGUMENTS = """
SELECT concat(CAST(l_suppkey AS VARCHAR(12)), l_returnflag) AS id, l_suppkey AS team_id, concat('Arg ', l_returnflag) AS name,
  CASE WHEN l_returnflag = 'A' THEN 'aff' ELSE 'neg' END AS side, count(*) AS read_count FROM lineitem GROUP BY l_suppkey, l_returnflag
"""

FX_ROUNDS = """
SELECT o_orderkey AS round_id, o_custkey AS team_id, CASE o_orderstatus WHEN 'O' THEN 'A' WHEN 'F' THEN 'N' END AS side, o_orderdate AS created_at,
  concat('Cup ', CAST(o_custkey % 7 AS VARCHAR(2))) AS tournament, CAST(o_orderkey % 6 + 1 AS VARCHAR(2)) AS round, o_orderpriority AS opponent,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('files/', CAST(o_orderkey AS VARCHAR(12))) END AS opensource FROM orders
"""

FX_ROUND_CITES = """
SELECT l_orderkey AS round_id, l_linenumber AS n, concat(CASE l_partkey % 3 WHEN 0 THEN 'JF---' WHEN 1 THEN '' ELSE 'MA---' END, CASE l_partkey % 4 WHEN 0 THEN '1AC ' WHEN 1 THEN 'NC ' ELSE '' END, 'Case ', CAST(l_partkey % 40 AS VARCHAR(4))) AS title,
  CASE WHEN l_discount = 0 THEN '' ELSE concat('Body of part ', CAST(l_partkey AS VARCHAR(12)), ' read in the round with ', CAST(l_quantity AS VARCHAR(12))) END AS cites
FROM lineitem WHERE l_linenumber <= 2
"""

FX_SEASON_BIDS = """
SELECT t.season, e.team_key, e.event_abbr, sum(CASE WHEN e.earned_bid = 'Full' THEN 1 ELSE 0 END) AS full_bids,
  sum(CASE WHEN e.earned_bid IS NOT NULL AND e.earned_bid <> 'Full' THEN 1 ELSE 0 END) AS partial_bids, max(e.display_name) AS display_name, max(e.school_code) AS school_code
FROM fx_entries e JOIN fx_tournaments t ON t.tourn_id = e.tourn_id GROUP BY t.season, e.team_key, e.event_abbr
"""

#: Ratings that both engines can make without the chronological fold: 10 points for each round won more than lost.
FX_RATINGS = """
SELECT season, event_abbr, team_key, max(display_name) AS display_name, max(school_name) AS school_name, max(school_code) AS school_code,
  1500.0 + 10.0 * (sum(w) - sum(l)) AS rating, sum(w) + sum(l) AS round_count, sum(w) AS wins, sum(l) AS losses, 1500.0 + 10.0 * sum(w) AS peak_rating
FROM (SELECT t.season, b.event_abbr, e.team_key, max(e.display_name) AS display_name, max(e.school_name) AS school_name, max(e.school_code) AS school_code, b.tourn_id, b.round_id,
        CASE WHEN sum(CASE WHEN b.result = 'W' THEN 1 ELSE 0 END) > sum(CASE WHEN b.result = 'L' THEN 1 ELSE 0 END) THEN 1 ELSE 0 END AS w,
        CASE WHEN sum(CASE WHEN b.result = 'W' THEN 1 ELSE 0 END) < sum(CASE WHEN b.result = 'L' THEN 1 ELSE 0 END) THEN 1 ELSE 0 END AS l
      FROM fx_ballots b JOIN fx_entries e ON e.tourn_id = b.tourn_id AND e.entry_id = b.entry_id AND e.event_abbr = b.event_abbr JOIN fx_tournaments t ON t.tourn_id = b.tourn_id
      GROUP BY t.season, b.event_abbr, e.team_key, b.tourn_id, b.round_id) q
GROUP BY season, event_abbr, team_key
"""

#: The same rows, where the votes of an entry are counted where they meet, before its names come to them.
FX_RATINGS_SPARK = """
SELECT season, event_abbr, team_key, max(display_name) AS display_name, max(school_name) AS school_name, max(school_code) AS school_code,
  1500.0 + 10.0 * (sum(w) - sum(l)) AS rating, sum(w) + sum(l) AS round_count, sum(w) AS wins, sum(l) AS losses, 1500.0 + 10.0 * sum(w) AS peak_rating
FROM (SELECT t.season, e.event_abbr, e.team_key, e.display_name, e.school_name, e.school_code, r.w, r.l
      FROM (SELECT tourn_id, event_abbr, entry_id, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS w, sum(CASE WHEN v < 0 THEN 1 ELSE 0 END) AS l
            FROM (SELECT tourn_id, event_abbr, entry_id, round_id, sum(CASE result WHEN 'W' THEN 1 WHEN 'L' THEN -1 ELSE 0 END) AS v
                  FROM (SELECT /*+ REPARTITION({parts}, tourn_id, event_abbr, entry_id) */ tourn_id, event_abbr, entry_id, round_id, result FROM fx_ballots) b GROUP BY tourn_id, event_abbr, entry_id, round_id) x
            GROUP BY tourn_id, event_abbr, entry_id) r
      JOIN fx_entries e ON e.tourn_id = r.tourn_id AND e.event_abbr = r.event_abbr AND e.entry_id = r.entry_id JOIN fx_tournaments t ON t.tourn_id = e.tourn_id) q
GROUP BY season, event_abbr, team_key
"""

#: The cards with the columns that are derived when they are stored, said in DuckDB's SQL.
CARDS_DUCK = r"""
SELECT *, count(*) OVER (PARTITION BY group_key) AS variant_count,
  row_number() OVER (PARTITION BY group_key ORDER BY warrant_density DESC NULLS LAST, source_entry, id) = 1 AS is_canonical
FROM (SELECT *, concat(coalesce(nullif(short_cite, ''), 'unknown'), '::', fingerprint) AS group_key FROM (SELECT *,
  CASE json_extract_string(argument_types, '$[0]') WHEN 'policy' THEN 'Policy' WHEN 'k' THEN 'K' WHEN 'phil' THEN 'Phil' WHEN 'theory' THEN 'Theory' WHEN 'tricks' THEN 'Tricks' ELSE '' END AS type_label,
  CASE WHEN coalesce(json_extract_string(argument_tags, '$[0]'), '') <> '' THEN array_to_string(list_transform(string_split(json_extract_string(argument_tags, '$[0]'), ' '),
      lambda w: CASE WHEN w IN ('ai','cp','da','nfu','rvi','pic','pics','us','uk','eu','un','nato','ndt','ceda','ld','icj','icc','wto','imf') THEN upper(w) ELSE concat(upper(substr(w, 1, 1)), substr(w, 2)) END), ' ')
    ELSE coalesce(topic_bucket, 'General LD') END AS topic_label,
  CASE WHEN source_kind = 'personal' THEN 'My Cards' ELSE 'Public Community Cards' END AS source_label,
  CASE WHEN source_kind = 'personal' THEN 'my' ELSE 'public' END AS scope,
  CASE WHEN division LIKE 'hsld%' THEN concat('HS LD 20', substr(division, 5, 2), '-', lpad(CAST(CAST(substr(division, 5, 2) AS INT) + 1 AS VARCHAR), 2, '0'))
       WHEN division LIKE 'hspolicy%' THEN concat('HS Policy 20', substr(division, 9, 2), '-', lpad(CAST(CAST(substr(division, 9, 2) AS INT) + 1 AS VARCHAR), 2, '0'))
       WHEN division LIKE 'ndtceda%' THEN concat('NDT/CEDA 20', substr(division, 8, 2), '-', lpad(CAST(CAST(substr(division, 8, 2) AS INT) + 1 AS VARCHAR), 2, '0')) ELSE 'Open' END AS resolution_label,
  contains(body_markdown, '==') OR contains(body_markdown, '<u>') OR contains(body_markdown, '**') AS has_highlight,
  coalesce(list_sum(list_transform(regexp_extract_all(body_markdown, '(?s)<u>.*?</u>|==.*?=='), lambda m: len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(m, '<[^>]+>', ' ', 'g'), '[*_=¶]', ' ', 'g'), '\s+'), lambda w: w <> '')))), 0)::BIGINT AS highlight_words,
  regexp_extract(cite, '^[A-Z][A-Za-z.-]+ ''[0-9]{2}', 0) AS short_cite,
  sha1(trim(regexp_replace(lower(body_plain), '\s+', ' ', 'g'))) AS fingerprint,
  round(coalesce(list_sum(list_transform(regexp_extract_all(body_markdown, '(?s)\*\*<u>.*?</u>\*\*|<u>.*?</u>'), lambda m: len(list_filter(regexp_split_to_array(regexp_replace(replace(m, '**', ' '), '<[^>]+>', ' ', 'g'), '\s+'), lambda w: w <> '')))), 0)
    / greatest(len(list_filter(regexp_split_to_array(regexp_replace(body_markdown, '[*_=<>/¶]', ' ', 'g'), '\s+'), lambda w: w <> '')), 1), 4)::DOUBLE AS warrant_density
FROM fx_cards) a) b
"""

def _ints(sql: str, *columns: str) -> str:
    """The view with columns of the integer width that Spark gives them."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INT) AS {c}' for c in columns)}) FROM ({sql.strip()}) v"


#: name: (text for Spark, text for DuckDB, views that it reads)
VIEWS = {
    "fx_cards": (FX_CARDS, FX_CARDS, ()), "fx_split_tags": (FX_SPLIT_TAGS_SPARK, FX_SPLIT_TAGS_DUCK, ("fx_cards",)), "fx_tournaments": (FX_TOURNAMENTS, _ints(FX_TOURNAMENTS, "tourn_id"), ()), "fx_events": (FX_EVENTS, _ints(FX_EVENTS, "tourn_id", "event_id"), ()), "fx_entries": (FX_ENTRIES, _ints(FX_ENTRIES, "tourn_id"), ()), "fx_ballots": (FX_BALLOTS_SPARK, _ints(FX_BALLOTS, "tourn_id", "round_id"), ()),
    "fx_results": (FX_RESULTS, FX_RESULTS, ("fx_entries",)), "fx_entry_paths": (FX_ENTRY_PATHS, FX_ENTRY_PATHS, ("fx_cards",)), "fx_paragraphs": (FX_PARAGRAPHS_SPARK, FX_PARAGRAPHS_DUCK, ("fx_cards",)), "fx_cites": (FX_CITES, FX_CITES, ("fx_cards",)),
    "fx_analytics": (FX_ANALYTICS, FX_ANALYTICS, ("fx_cards",)), "fx_saved": (FX_SAVED, FX_SAVED, ()), "fx_contentions": (FX_CONTENTIONS, FX_CONTENTIONS, ()), "fx_codes": (FX_CODES, FX_CODES, ("fx_entries", "fx_tournaments")), "fx_links": (FX_LINKS, FX_LINKS, ("fx_entries",)),
    "fx_wiki_teams": (FX_WIKI_TEAMS, FX_WIKI_TEAMS, ()), "fx_wiki_arguments": (FX_WIKI_ARGUMENTS, FX_WIKI_ARGUMENTS, ()), "fx_rounds": (FX_ROUNDS, FX_ROUNDS, ()), "fx_round_cites": (FX_ROUND_CITES, FX_ROUND_CITES, ()),
    "fx_season_bids": (FX_SEASON_BIDS, FX_SEASON_BIDS, ("fx_entries", "fx_tournaments")), "fx_ratings": (FX_RATINGS_SPARK, FX_RATINGS, ("fx_ballots", "fx_entries", "fx_tournaments")), "cards": (None, CARDS_DUCK, ("fx_cards",)),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for x in (*_needed(VIEWS[name][2]), name):
            if x not in out:
                out.append(x)
    return out


def with_views(body: str, *names: str) -> str:
    """A DuckDB query with the views before it."""
    views = ", ".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in _needed(names))
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views}, {body[15:]}" if views else body
    if body[:5].upper() == "WITH ":
        return f"WITH {views}, {body[5:]}" if views else body
    return f"WITH {views} {body}" if views else body


#: Views that take more than a projection: written once for each application and folder, and read by every query.
HEAVY = ("fx_tournaments", "fx_events", "fx_entries", "fx_ballots", "fx_results", "fx_season_bids", "fx_ratings", "fx_wiki_arguments")
_KEPT: dict[tuple[str, str, str], tuple[str, StructType]] = {}


class Views:
    """The tables of a folder and the views over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name == "cards":
            from lectern.operators.cards import stored

            return self.kept("cards", lambda: stored(self.fx_cards))
        if name == "card_list":  # what cards has but the bodies, which would be most of what is written
            from lectern.operators.cards import listed

            return self.cards.drop("body_markdown", "body_plain") if self._is_kept("cards") else self.kept("card_list", lambda: listed(self.fx_cards))
        if name not in VIEWS:
            raise AttributeError(name)
        for x in TABLES:  # whichever tables there are: a view reads only those that it names
            if x in " ".join(VIEWS[v][0] for v in _needed((name,))):
                self.table(x).createOrReplaceTempView(x)
        for x in _needed((name,)):
            made = lambda x=x: self._spark.sql(self._dealt(x))
            (self.kept(x, made) if x in HEAVY else made()).createOrReplaceTempView(x)
        return self._spark.table(name)

    def _dealt(self, name: str) -> str:
        """The view's text, dealt to as many tasks as its largest table needs."""
        sql = VIEWS[name][0]
        return sql.replace("{parts}", str(parts(self._spark.table("lineitem" if "FROM lineitem" in sql else "fx_ballots")))) if "{parts}" in sql else sql

    def _is_kept(self, name: str) -> bool:
        return (self._spark.sparkContext.applicationId, self._dir, name) in _KEPT

    def kept(self, name: str, make: Callable[[], DataFrame], by: str | None = None, form: str = "parquet", **options: str) -> DataFrame:
        """What make gives, written to the shared folder at its first use (in partitions of `by`, in a form and with options of the writer)."""
        key = (self._spark.sparkContext.applicationId, self._dir, name)
        if key not in _KEPT:
            df, path = make(), fresh(self._spark, name)
            to = df.write.format(form).options(**options)
            (to.partitionBy(by) if by else to).save(path)
            _KEPT[key] = path, df.schema
        path, schema = _KEPT[key]
        return self._spark.read.format(form).schema(schema).load(path)

"""Queries over keyword indexes in order of their terms, over owners' documents, and over cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import lexicon as L
from lectern.operators import quality
from lectern.plans.registry import query
from lectern.sources import scratch

FOLDED = "translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
PREFIXES = {1: "inor ATR", 2: "th", 3: "de la unge", 4: "zzzzzz"}


@query(rf"""WITH post AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({FOLDED.format('text')}, '[\p{{L}}\p{{N}}]+')) AS term FROM documents), q(query_id, token) AS (VALUES (1, 'inor'), (1, 'atr'), (2, 'th'), (3, 'de'), (3, 'la'), (3, 'unge'), (4, 'zzzzzz')),
met AS (SELECT DISTINCT query_id, token, doc_id FROM q JOIN post ON starts_with(term, token)) SELECT query_id, doc_id FROM (SELECT query_id, doc_id, count(*) AS n FROM met GROUP BY ALL) m JOIN (SELECT query_id, count(*) AS n FROM q GROUP BY ALL) w USING (query_id, n)""")  # fmt: skip
def sea_02_prefix_ranges(v):
    """Several queries at once; only the parts of the index that their prefixes lie in are read."""
    index = L.Lexicon(v._spark, scratch.fresh(v._spark, "lexicon")).write(v.documents, ["text"], 16)
    return index.matching({i: L.prefix_tokens(q) for i, q in PREFIXES.items()}).select("query_id", "doc_id")


TEAMS = {1: "School Ge", 2: "school \"supplier", 3: "", 4: " '\" ", 5: "united states sup", 6: "school-united AB", 7: "nothing here", 8: "cc"}
TEAM_TOKENS = "(1, 0, 'school', false), (1, 1, 'ge', true), (2, 0, 'school', false), (2, 1, 'supplier', true), (5, 0, 'united', false), (5, 1, 'states', false), (5, 2, 'sup', true), (6, 0, 'school', false), (6, 1, 'united', false), (6, 2, 'ab', true), (7, 0, 'nothing', false), (7, 1, 'here', true), (8, 0, 'cc', true)"


@query(rf"""WITH t AS (SELECT id, unnest(regexp_extract_all(lower(school), '[a-z0-9]+') || regexp_extract_all(lower(code), '[a-z0-9]+') || regexp_extract_all(lower(full_name), '[a-z0-9]+')) AS term FROM fx_wiki_teams), sz AS (SELECT id, count(*) AS length FROM t GROUP BY id),
q(query_id, n, token, prefix) AS (VALUES {TEAM_TOKENS}), hit AS (SELECT query_id, n, id, count(*) AS tf FROM q JOIN t ON CASE WHEN prefix THEN starts_with(term, token) ELSE term = token END GROUP BY ALL), df AS (SELECT query_id, n, count(*) AS df FROM hit GROUP BY ALL),
bm AS (SELECT query_id, id, round(-sum(greatest(ln(((SELECT count(*) FROM sz) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT avg(length) FROM sz)))), 6) AS score, count(*) AS found FROM hit JOIN df USING (query_id, n) JOIN sz USING (id) GROUP BY ALL),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INT AS rank FROM bm JOIN (SELECT query_id, count(*) AS found FROM q GROUP BY ALL) w USING (query_id, found)
 UNION ALL SELECT b.query_id, id, row_number() OVER (PARTITION BY b.query_id ORDER BY full_name, id)::INT FROM fx_wiki_teams CROSS JOIN (VALUES (3), (4)) b(query_id))
SELECT query_id, rank, id, school, code, full_name FROM r JOIN fx_wiki_teams USING (id) WHERE rank <= 20""", "fx_wiki_teams")  # fmt: skip
def sea_06_ranked_team_search(v):
    """Several queries at once, two of them blank: the best twenty teams of each."""
    teams = v.fx_wiki_teams
    index = L.Lexicon(v._spark, scratch.fresh(v._spark, "teams"), "id").write(teams, ["school", "code", "full_name"], 8)
    return L.team_search(index, teams, TEAMS, 20).select("query_id", "rank", "id", "school", "code", "full_name")


OWN = {1: ("src0", "thand queau"), 2: ("src1", "thand queau"), 3: ("src1", "ungen der mit"), 4: ("src3", "the of"), 5: ("nobody", "the of")}


@query(rf"""WITH t AS (SELECT source, doc_id, unnest(regexp_extract_all({FOLDED.format('text')}, '[\p{{L}}\p{{N}}]+')) AS term FROM documents), post AS (SELECT source, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
sz AS (SELECT source, doc_id, len(regexp_extract_all({FOLDED.format('text')}, '[\p{{L}}\p{{N}}]+')) AS length FROM documents), st AS (SELECT source, count(*) AS n, avg(length) AS mean FROM sz GROUP BY source),
q(query_id, source, term) AS (VALUES (1, 'src0', 'thand'), (1, 'src0', 'queau'), (2, 'src1', 'thand'), (2, 'src1', 'queau'), (3, 'src1', 'ungen'), (3, 'src1', 'der'), (3, 'src1', 'mit'), (4, 'src3', 'the'), (4, 'src3', 'of')),
hit AS (SELECT query_id, post.* FROM q JOIN post USING (source, term)), df AS (SELECT query_id, term, count(*) AS df FROM hit GROUP BY ALL),
bm AS (SELECT query_id, source, doc_id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM hit JOIN df USING (query_id, term) JOIN sz USING (source, doc_id) JOIN st USING (source) GROUP BY ALL)
SELECT query_id, source, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id)::INT AS rank FROM bm) x WHERE rank <= 6""")  # fmt: skip
def sea_08_own_documents(v):
    """Each query searches one owner's documents, by that owner's statistics."""
    index = L.ScopedIndex(v._spark, scratch.fresh(v._spark, "owned"), "source", "doc_id", 16).write(v.documents, "text")
    return index.search(OWN).select("query_id", "source", "doc_id", "rank")


#: Bodies with all kinds of marks, and their sources.
FX_CUTS = """fx_cuts AS (SELECT doc_id, replace(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN body_markdown WHEN 2 THEN concat('<u>a ==', substr(text, 1, 60), '== **b** ', substr(text, 61, 200), '</u>', substr(text, 261)) ELSE concat('**', substr(text, 1, 5), '**', substr(text, 6, length(text) - 30)) END, chr(10), concat(chr(10), ' ', chr(10))) AS body_markdown,
  CASE WHEN doc_id % 9 = 4 THEN '' ELSE replace(text, chr(10), concat(chr(10), chr(10))) END AS source FROM (SELECT c.*, c.body_plain AS text FROM fx_cards c) x)"""
#: A negative length takes what is before the place in DuckDB, and nothing in Spark.
FX_CUTS_SPARK = FX_CUTS.replace("substr(text, 6, length(text) - 30)", "CASE WHEN length(text) >= 30 THEN substr(text, 6, length(text) - 30) ELSE substr(substr(text, 1, 5), greatest(length(text) - 24, 1)) END")
_NORM = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(translate({0}, '‘’“”–—', chr(39) || chr(39) || '""--'), '(?i)==|\*\*|</?u>', '', 'g'), '¶', ' ', 'g')), '\s+', ' ', 'g'))"""
_COUNT = r"len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({0}, '==|\*\*', '', 'g'), '(?i)</?u>', '', 'g'), '\s+'), lambda w: w <> ''))"
CUTS_SQL = rf"""WITH {FX_CUTS}, b AS (SELECT doc_id, source, list_filter(list_transform(regexp_split_to_array(body_markdown, '\n\s*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND x <> '[FIGURE OMITTED]') AS ps,
  list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(source, '\n\s*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND x <> '[FIGURE OMITTED]'), lambda x: {_NORM.format('x')}), lambda x: x <> '') AS ss FROM fx_cuts),
p AS (SELECT doc_id, ss, unnest(ps) AS p, unnest(range(1, len(ps) + 1))::INT AS paragraph FROM b),
c AS (SELECT *, {_COUNT.format('p')} AS n, regexp_extract_all(p, '==([^=]+)==', 1) AS runs, regexp_extract_all(p, '(?is)<u>(.*?)</u>', 1) AS lines, regexp_replace(p, '(?is)<u>.*?</u>', ' ', 'g') AS outside, {_NORM.format('p')} AS norm FROM p),
m AS (SELECT *, coalesce(list_sum(list_transform(runs, lambda r: {_COUNT.format('r')})), 0) / n AS lit, coalesce(list_sum(list_transform(lines, lambda r: {_COUNT.format('r')})), 0) / n AS low, coalesce(list_max(list_transform(runs, lambda r: {_COUNT.format('r')})), 0) AS run FROM c WHERE n > 0)
SELECT doc_id, paragraph, 'highlighted too densely' AS issue, round(lit, 6)::DOUBLE AS value FROM m WHERE lit > 0.25 UNION ALL SELECT doc_id, paragraph, 'underlined too densely', round(low, 6) FROM m WHERE low > 0.55 UNION ALL SELECT doc_id, paragraph, 'long highlight', run FROM m WHERE run > 5
UNION ALL SELECT doc_id, paragraph, 'highlight outside underline', NULL FROM m WHERE regexp_matches(outside, '==[^=]+==') UNION ALL SELECT doc_id, paragraph, 'bold outside underline', NULL FROM m WHERE regexp_matches(outside, '\*\*[^*]+\*\*')
UNION ALL SELECT doc_id, paragraph, CASE WHEN contains(array_to_string(ss, ' § '), norm) THEN 'trimmed' ELSE 'not verbatim' END, NULL FROM m WHERE len(ss) > 0 AND norm <> '' AND NOT list_contains(ss, norm)"""


@query(CUTS_SQL, "fx_cards")
def qlt_02_cut_issues(v):
    v.fx_cards
    cuts = v._spark.sql(f"WITH {FX_CUTS_SPARK} SELECT * FROM fx_cuts")
    return quality.cut_issues(cuts, "standard", "doc_id")

"""Queries over the evidence library."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import labels, text
from lectern.operators import cards as C
from lectern.plans.registry import query
from lectern.sources import merge

Q = "the"  # a word that many texts hold


@query("SELECT id, highlight_words, type_label FROM cards WHERE has_highlight AND highlight_words >= 6 AND scope = 'public' AND lower(type_label) = 'k' AND resolution_label = 'HS Policy 2024-25'", "cards")
def fil_01_card_predicate(v):
    return v.cards.filter(C.predicate(6, "public", "k", resolution="HS Policy 2024-25")).select("id", "highlight_words", "type_label")


@query(f"SELECT {', '.join(C.LIST_COLUMNS)} FROM cards WHERE has_highlight AND is_canonical", "cards")
def fil_02_lite_projection(v):
    return v.cards.filter(C.predicate(canonical=True)).select(*C.LIST_COLUMNS)


@query(f"SELECT id, title, imported_at, substr(content_plain, 1, 500) AS excerpt FROM fx_analytics WHERE contains(lower(content_plain), '{Q}') OR contains(lower(title), '{Q}') ORDER BY imported_at DESC, id LIMIT 50", "fx_analytics")
def fil_03_search_analytics(v):
    return C.search_analytics(v.fx_analytics, Q).select("id", "title", "imported_at", "excerpt")


IDS = [f"c{n:08d}" for n in range(499, -1, -7)]


@query(f"SELECT id, pos::INT AS pos, tag FROM cards JOIN (SELECT unnest({IDS}) AS id, unnest(range({len(IDS)})) AS pos) w USING (id) WHERE has_highlight", "cards")
def fil_04_by_ids(v):
    return C.by_ids(v.cards, IDS, C.predicate()).select("id", "pos", "tag")


@query("SELECT id FROM fx_cards WHERE contains(lower(concat_ws(' ', nullif(tag, ''), nullif(cite, ''), nullif(body_plain, ''), nullif(school, ''), nullif(squad, ''), nullif(topic_bucket, ''), nullif(division, ''))), 'team 3')", "fx_cards")
def fil_08_all_fields(v):
    return v.fx_cards.filter(C.contains_all_fields("Team 3", ["tag", "cite", "body_plain", "school", "squad", "topic_bucket", "division"])).select("id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thand') OR contains(lower(text), 'queau')")
def fil_10_any_keyword(v):
    return v.documents.filter(text.any_keyword("Thand, queau is", F.col("text"))).select("doc_id")


@query("SELECT id, imported_at FROM cards WHERE argument_types = '[\"none\"]' OR argument_tags = '[]' ORDER BY imported_at DESC, id LIMIT 100", "cards")
def fil_15_needs_classification(v):
    return C.needs_classification(v.cards).select("id", "imported_at")


@query("SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) >= 1800 AND NOT lower(text) LIKE 'abstract:%'")
def fil_18_usable_article(v):
    return v.documents.filter((F.length("text") >= 1800) & ~F.lower("text").startswith("abstract:")).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("SELECT id, CASE type_label WHEN 'K' THEN 'k' ELSE lower(type_label) END AS bucket FROM cards WHERE NOT regexp_matches(lower(concat_ws(' ', topic_label, tag)), 'general *ld')", "cards")
def fil_19_card_type(v):
    return v.cards.filter(~labels.is_general(F.col("topic_label"), F.col("tag"))).select("id", labels.card_type(F.col("type_label")).alias("bucket"))


@query("""SELECT kind, label, count FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY count DESC, label) AS n FROM (SELECT kind, label, count(*) AS count FROM
 (SELECT unnest(['resolution_label', 'type_label', 'topic_label', 'source_label']) AS kind, unnest([resolution_label, type_label, topic_label, source_label]) AS label FROM cards WHERE has_highlight) x WHERE label <> '' GROUP BY kind, label) y) z
 WHERE n <= CASE WHEN kind = 'source_label' THEN 10 ELSE 20 END""", "cards")  # fmt: skip
def agg_01_facets(v):
    return C.facets(v.cards)


@query("""SELECT 'totals' AS kind, NULL AS label, count(*) AS cards, count_if(is_canonical)::BIGINT AS canonical, count(DISTINCT school) AS schools, count(DISTINCT resolution_label) AS resolutions FROM cards
UNION ALL SELECT kind, label, count, NULL, NULL, NULL FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY count DESC, label) AS n FROM (SELECT kind, label, count(*) AS count FROM
 (SELECT unnest(['resolution_label', 'type_label', 'topic_label']) AS kind, unnest([resolution_label, type_label, topic_label]) AS label FROM cards WHERE has_highlight) x WHERE label <> '' GROUP BY kind, label) y) z WHERE n <= 6""", "cards")  # fmt: skip
def agg_02_library_analytics(v):
    return C.library_analytics(v.cards)


@query("""SELECT 'totals' AS kind, NULL AS label, count(*) AS n FROM cards UNION ALL SELECT * FROM (SELECT 'school' AS kind, school AS label, count(*) AS n FROM cards GROUP BY school ORDER BY n DESC, label LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'division', division, count(*) AS n FROM cards GROUP BY division)""", "cards")  # fmt: skip
def set_01_tagged_union(v):
    c = v.cards
    head = c.agg(F.count("*").alias("n")).select(F.lit("totals").alias("kind"), F.lit(None).cast("string").alias("label"), "n")
    part = lambda kind, col, top: C.count_by(c, col, "none", top).select(F.lit(kind).alias("kind"), "label", F.col("count").alias("n"))
    return head.unionByName(part("school", "school", 5)).unionByName(part("division", "division", None))


@query("""SELECT * FROM (SELECT 'teams' AS kind, NULL AS label, count(DISTINCT concat_ws('|', school, squad)) AS n FROM cards)
UNION ALL SELECT * FROM (SELECT 'topic', coalesce(topic_bucket, 'Uncategorized') AS label, count(*) AS n FROM cards GROUP BY 2 ORDER BY n DESC, label LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'newest', id, doc_id FROM cards ORDER BY imported_at DESC, id LIMIT 12) UNION ALL SELECT * FROM (SELECT 'newest canonical', id, doc_id FROM cards WHERE is_canonical ORDER BY imported_at DESC, id LIMIT 12)""", "cards")  # fmt: skip
def agg_03_dashboard(v):
    c = v.cards
    teams = c.agg(F.countDistinct(F.concat_ws("|", "school", "squad")).alias("n")).select(F.lit("teams").alias("kind"), F.lit(None).cast("string").alias("label"), "n")
    topics = C.count_by(c, "topic_bucket", "Uncategorized", 8).select(F.lit("topic").alias("kind"), "label", F.col("count").alias("n"))
    newest = lambda kind, rows: rows.orderBy(F.desc("imported_at"), "id").limit(12).select(F.lit(kind).alias("kind"), F.col("id").alias("label"), F.col("doc_id").alias("n"))
    return teams.unionByName(topics).unionByName(newest("newest", c)).unionByName(newest("newest canonical", c.filter("is_canonical")))


@query("SELECT label, count(*) AS count FROM (SELECT unnest(from_json(argument_tags, '[\"VARCHAR\"]')) AS label FROM fx_cards) GROUP BY label ORDER BY count DESC, label LIMIT 8", "fx_cards")
def agg_04_array_counts(v):
    return C.value_counts(v.fx_cards, labels.json_array(F.col("argument_tags")))


@query("SELECT coalesce(topic_bucket, 'none') AS label, count(*) AS count FROM fx_cards GROUP BY 1", "fx_cards")
def agg_05_count_by(v):
    return C.count_by(v.fx_cards, "topic_bucket", "none")


@query("SELECT id, group_key, variant_count, is_canonical, warrant_density FROM cards", "cards")
def agg_06_canonical_election(v):
    return v.cards.select("id", "group_key", "variant_count", "is_canonical", "warrant_density")


@query(r"""WITH k AS (SELECT *, list_sum(list_transform(regexp_extract_all(body_markdown, '(?s)==.+?=='), lambda m: len(list_filter(regexp_split_to_array(regexp_replace(m[3:-3], '<[^>]+>', '', 'g'), '\s+'), lambda w: w <> ''))))
   AS h1, list_sum(list_transform(regexp_extract_all(body_markdown, '(?is)<u\b[^>]*>.+?</u>'), lambda m: len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(m, '<[^>]+>', '', 'g'), '==+', '', 'g'), '\s+'), lambda w: w <> '')))) AS h2,
   trim(lower(short_cite)) || '||' || trim(substr(regexp_replace(regexp_replace(lower(body_plain), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), 1, 100)) AS key FROM cards),
 s AS (SELECT *, coalesce(h1, 0) + coalesce(h2, 0) AS hl, length(body_plain) + 10 * (coalesce(h1, 0) + coalesce(h2, 0)) AS bs FROM k),
 r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bs DESC, id) AS n, count(*) OVER (PARTITION BY key) AS g FROM s WHERE hl >= 6)
SELECT s.id, coalesce(r.n = 1, false) AS is_canonical, NOT coalesce(r.n = 1, false) AS dropped, CASE WHEN r.n = 1 THEN r.g ELSE s.variant_count END AS variant_count FROM s LEFT JOIN r ON r.id = s.id""", "cards")  # fmt: skip
def agg_07_strict_canonical(v):
    return C.strict_canonical(v.cards).select("id", "is_canonical", "dropped", "variant_count")


@query("SELECT coalesce(upper(topic), 'GENERAL') AS topic, count(*) AS n FROM fx_contentions GROUP BY 1", "fx_contentions")
def agg_20_contentions(v):
    return v.fx_contentions.groupBy(F.coalesce(F.upper("topic"), F.lit("GENERAL")).alias("topic")).agg(F.count("*").alias("n"))


@query(r"""WITH k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(tag), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM cards)
SELECT id, place FROM (SELECT id, min(doc_id) OVER (PARTITION BY key) AS place, row_number() OVER (PARTITION BY key ORDER BY is_canonical DESC, CASE WHEN is_canonical THEN 0 ELSE highlight_words END DESC, doc_id) AS n FROM k WHERE key <> '') x WHERE n = 1
UNION ALL SELECT id, doc_id FROM k WHERE key = ''""", "cards")  # fmt: skip
def agg_25_dedupe_by_tag(v):
    return C.dedupe_by_tag(v.cards).select("id", "place")


SORTS = {"recent": "imported_at DESC", "density": "warrant_density DESC", "variants": "variant_count DESC", "cite": "coalesce(nullif(short_cite, ''), cite)", "school": "school", "tag": "tag", "relevance": "is_canonical DESC, variant_count DESC, imported_at DESC"}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS mode, id, row_number() OVER (ORDER BY has_highlight DESC, {o}, id)::INT AS n FROM cards ORDER BY n LIMIT 40)" for k, o in SORTS.items()), "cards")
def sort_01_modes(v):
    from functools import reduce

    from pyspark.sql import Window

    c = v.cards
    return reduce(lambda a, b: a.unionByName(b), (C.page(c, C.order(k)).withColumn("mode", F.lit(k)).withColumn("n", F.row_number().over(Window.orderBy(*C.order(k)))).select("mode", "id", "n") for k in SORTS))


@query(f"SELECT id FROM cards ORDER BY (doc_id * 42 + {(42 * 2654435761) % (1 << 32)}) % 2147483647, id LIMIT 40 OFFSET 40", "cards")
def sort_02_seeded_order(v):
    return C.page(v.cards, C.order("random", 42), 2, 40).select("id")


@query("SELECT id, imported_at, (SELECT count(*) FROM cards WHERE has_highlight) AS total FROM cards WHERE has_highlight ORDER BY imported_at DESC, id LIMIT 40 OFFSET 80", "cards")
def sort_04_page_with_total(v):
    rows = v.cards.filter(C.predicate())
    total = rows.agg(F.count("*").alias("total"))
    return C.page(rows, C.order("recent"), 3, 40).select("id", "imported_at").crossJoin(F.broadcast(total))


@query("SELECT id, array_to_string(list_filter(from_json(argument_tags, '[\"VARCHAR\"]'), lambda t: t NOT IN ('nfu', 'econ')), ',') AS after FROM fx_cards WHERE contains(argument_tags, '\"nfu\"') OR contains(argument_tags, '\"econ\"')", "fx_cards")
def set_06_clean_topics(v):
    return C.clean_topics(v.fx_cards, ["nfu", "econ"]).select("id", F.array_join("after", ",").alias("after"))


@query("SELECT id FROM cards WHERE doc_id >= 40 ORDER BY doc_id LIMIT 40", "cards")
def set_07_append_page(v):
    c = v.cards.select("doc_id", "id")
    held = c.orderBy("doc_id").limit(40)
    return merge.not_in(c.orderBy("doc_id").limit(80), held, ["id"]).select("id")


@query("SELECT id, type_label, topic_label, source_label, scope, resolution_label FROM cards", "cards")
def lbl_01_labels(v):
    return v.cards.select("id", "type_label", "topic_label", "source_label", "scope", "resolution_label")


@query("SELECT id, has_highlight, highlight_words, warrant_density, short_cite, fingerprint FROM cards", "cards")
def src_14_backfill(v):
    return C.derived(v.fx_cards).select("id", "has_highlight", "highlight_words", "warrant_density", "short_cite", "fingerprint")


@query("SELECT count(*) AS total_cards, count_if(is_canonical)::BIGINT AS canonical_groups, count(DISTINCT CASE WHEN short_cite <> '' THEN short_cite END) AS citation_groups FROM cards", "cards")
def src_18_import_statistics(v):
    return C.import_statistics(v.cards)


@query("WITH new AS (SELECT * FROM cards WHERE doc_id % 2 = 1), old AS (SELECT * FROM cards WHERE doc_id % 2 = 0) SELECT id, group_key FROM new WHERE fingerprint NOT IN (SELECT fingerprint FROM old)", "cards")
def src_16_incremental_import(v):
    c = C.derived(v.fx_cards)
    return merge.not_in(c.filter("doc_id % 2 = 1"), c.filter("doc_id % 2 = 0"), ["fingerprint"]).select("id", "group_key")


@query("SELECT id, doc_id FROM (SELECT id, doc_id FROM cards ORDER BY id LIMIT 50 OFFSET 100)", "cards")
def src_24_paged_read(v):
    return v.cards.orderBy("id").offset(100).limit(50).select("id", "doc_id")


@query("""SELECT id, fingerprint AS text_hash FROM (SELECT id, fingerprint, row_number() OVER (PARTITION BY fingerprint ORDER BY id) AS n FROM cards WHERE is_canonical AND has_highlight AND length(trim(body_plain)) >= 20) x WHERE n = 1 AND CAST(substr(id, 2) AS BIGINT) % 3 <> 0""", "cards")
def src_21_select_for_embedding(v):
    from lectern.sources.embedding import to_embed

    done = v.cards.filter("doc_id % 3 = 0").select("id", F.col("fingerprint").alias("text_hash"))
    return to_embed(v.cards, done).select("id", "text_hash")


@query("""SELECT topic_label AS folder, concat('# ', topic_label, chr(10), array_to_string(list(concat('- ', tag) ORDER BY id), chr(10))) AS note FROM
 (SELECT *, row_number() OVER (PARTITION BY topic_label ORDER BY id) AS n FROM cards WHERE is_canonical) x WHERE n <= 200 GROUP BY topic_label""", "cards")  # fmt: skip
def src_20_index_notes(v):
    from lectern.sources.notes import index_notes

    return index_notes(v.cards.filter("is_canonical"))


@query("""WITH p AS (SELECT *, string_split(entry, '/') AS s FROM fx_entry_paths)
SELECT 'school' AS kind, s[2] AS label, count(*) AS n FROM p GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, s[2]) <= 12
UNION ALL SELECT 'team', concat(s[2], '/', s[3]), count(*) FROM p GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, concat(s[2], '/', s[3])) <= 20""", "fx_entry_paths")  # fmt: skip
def src_02_archive_profile(v):
    from lectern.sources.archive import profile

    return profile(v.fx_entry_paths)


@query("""WITH s AS (SELECT *, sum(CASE WHEN style = 'Heading4' THEN 1 ELSE 0 END) OVER (PARTITION BY entry ORDER BY pos) AS card FROM fx_paragraphs),
c AS (SELECT *, regexp_matches(text, '^[A-Z][A-Za-z.-]+ *''[0-9]{2}\\b') OR regexp_matches(text, '^[A-Z][A-Za-z.-]+ +([0-9]{2}|[0-9]{4})\\b') AS citey FROM s WHERE card > 0),
f AS (SELECT *, min(CASE WHEN citey AND style = '' THEN pos END) OVER (PARTITION BY entry, card) AS cite_pos FROM c)
SELECT entry, card::BIGINT AS card, max(CASE WHEN style = 'Heading4' THEN text END) AS tag, max(CASE WHEN pos = cite_pos THEN text END) AS cite, array_to_string(list(text ORDER BY pos) FILTER (pos > cite_pos AND style = ''), ' ') AS body
FROM f GROUP BY entry, card HAVING count_if(pos > cite_pos AND style = '') > 0""".replace("\\\\b", "\\b"), "fx_paragraphs")  # fmt: skip
def src_04_cards_from_paragraphs(v):
    from lectern.sources.archive import cards_from_paragraphs

    return cards_from_paragraphs(v.fx_paragraphs)


@query("SELECT key, value FROM (VALUES ('lastImport', 'null'), ('importedZip', '\"\"'), ('totalCards', '0')) d(key, value) WHERE key NOT IN (SELECT source FROM documents) UNION ALL SELECT source AS key, CAST(max(doc_id) AS VARCHAR) FROM documents GROUP BY source")
def src_17_meta(v):
    log = v.documents.select(F.col("source").alias("key"), F.col("doc_id").cast("string").alias("value"), "doc_id")
    return merge.with_defaults(merge.latest(log, "key", "value", "doc_id"), {"lastImport": "null", "importedZip": '""', "totalCards": "0"})


@query("WITH s AS (SELECT *, concat(lower(trim(tag)), '|', lower(trim(substr(trim(body), 1, 200)))) AS k FROM fx_saved) SELECT user_id, seq, n > 1 OR EXISTS (SELECT 1 FROM s b WHERE b.seq // 1000 % 3 = 0 AND b.user_id = x.user_id AND b.k = x.k) AS duplicate FROM (SELECT user_id, seq, k, row_number() OVER (PARTITION BY user_id, k ORDER BY seq) AS n FROM s WHERE seq // 1000 % 3 <> 0) x", "fx_saved")
def src_15_insert_absent(v):
    """A third of the saves is there already; the others are held against it and against each other."""
    s = v.fx_saved.withColumn("fingerprint", text.saved_key(F.col("tag"), F.col("cite"), F.col("body")))
    held = F.expr("seq div 1000 % 3 = 0")
    return merge.insert_absent(s.filter(held), s.filter(~held), ["user_id", "fingerprint"], "seq").select("user_id", "seq", "duplicate")


@query("SELECT id, tag, score FROM (SELECT id, tag, doc_id, (CASE WHEN contains(lower(tag), 'the') THEN 100 ELSE 0 END + CASE WHEN starts_with(lower(tag), 'the') THEN 50 ELSE 0 END + CASE WHEN contains(lower(cite), 'the') THEN 20 ELSE 0 END + CASE WHEN contains(lower(body_plain), 'the') THEN 5 ELSE 0 END + CASE WHEN contains(lower(tag), 'the') THEN 200 ELSE 0 END)::INT AS score FROM cards) x ORDER BY score DESC, doc_id LIMIT 100", "cards")
def sea_14_keyword_rank(v):
    return C.keyword_rank(v.cards, "the").limit(100).select("id", "tag", "score")


@query("SELECT row_number() OVER (ORDER BY doc_id)::INT AS line_no, concat(tag, ' (', concat_ws(' | ', short_cite, nullif(topic_label, ''), nullif(type_label, '')), ')') AS line FROM cards ORDER BY doc_id LIMIT 5", "cards")
def sea_18_bullets(v):
    return C.bullets(v.cards, [F.asc("doc_id")])


@query("SELECT id, fingerprint FROM (SELECT id, fingerprint, row_number() OVER (PARTITION BY fingerprint ORDER BY id) AS n FROM cards) x WHERE n = 1", "cards")
def win_12_first_of_key(v):
    return C.first_of(v.cards, ["fingerprint"], "id").select("id", "fingerprint")

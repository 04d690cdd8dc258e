"""The evidence library: stored cards, filters, orders, facets, canonical records, merges.

Frames of cards have the columns of `stored`. Keys that order rows always end in `id`, so results don't
depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import labels, text
from lectern.sources import merge
from lectern.sources.keyed import KeyedTable
from lectern.sources.scratch import written

#: What tells a card that is there already.
KNOWN_BY = "fingerprint"
#: What lists show; bodies stay unread.
LIST_COLUMNS = (
    "id", "zip_path", "source_entry", "division", "school", "squad", "tag", "cite", "short_cite", "warrant_density", "imported_at", "topic_bucket", "source_kind", "is_canonical", "group_key", "variant_count",
    "type_label", "topic_label", "source_label", "scope", "resolution_label", "has_highlight", "highlight_words",
)


def derived(cards: DataFrame) -> DataFrame:
    """Labels, highlight counts, density, fingerprint and group key from the stored fields."""
    types, tags = labels.json_array(F.col("argument_types")), labels.json_array(F.col("argument_tags"))
    out = cards.withColumns({
        "type_label": labels.type_label(types), "topic_label": labels.topic_label(tags, F.col("topic_bucket")), "source_label": labels.source_label(F.col("source_kind")), "scope": labels.scope(F.col("source_kind")),
        "resolution_label": labels.resolution_label(F.col("division"), F.col("zip_path")), "has_highlight": text.has_highlight(F.col("body_markdown")), "highlight_words": text.highlight_words(F.col("body_markdown")),
        "short_cite": text.short_cite(F.col("cite")), "fingerprint": text.fingerprint(F.col("body_plain")), "warrant_density": text.warrant_density(F.col("body_markdown")),
    })
    cite = F.coalesce(F.nullif(F.col("short_cite"), F.lit("")), F.lit("unknown"))
    return out.withColumn("group_key", F.when(F.col("fingerprint") != "", F.concat(cite, F.lit("::"), "fingerprint")).otherwise(""))


def elect_canonical(cards: DataFrame) -> DataFrame:
    """variant_count and is_canonical: of each group the densest card, then by source entry and id.

    A card without a key is a group of its own. The election reads narrow rows: keys are aggregated with partial
    maxima and joined back, so a group of any size is never gathered. Whole cards pass a table of winners, not sorted.
    """
    cards = cards.drop("variant_count", "is_canonical").withColumn("_group", F.when(F.coalesce("group_key", F.lit("")) != "", F.col("group_key")).otherwise(F.concat(F.lit("alone::"), "id")))
    best = F.min(F.struct((-F.coalesce("warrant_density", F.lit(-1.0))).alias("d"), "source_entry", "id"))
    won = cards.groupBy("_group").agg(F.count("*").alias("variant_count"), best.alias("_best")).select("_group", "variant_count", F.col("_best.id").alias("_winner"))
    return cards.join(won.hint("shuffle_hash"), "_group").withColumn("is_canonical", F.col("id") == F.col("_winner")).drop("_winner", "_group")


def stored(cards: DataFrame) -> DataFrame:
    """The derived columns are written once: the election and the cards both read them."""
    return elect_canonical(written(derived(cards), "derived"))


def listed(cards: DataFrame) -> DataFrame:
    """stored without the bodies, which are read but not written."""
    return elect_canonical(written(derived(cards).drop("body_markdown", "body_plain"), "derived"))


def recanonicalise(cards: DataFrame, keys: DataFrame) -> DataFrame:
    """Only the groups of keys (group_key) are elected anew; all other cards stay as they are."""
    touched = keys.filter("group_key <> ''").select("group_key").distinct()
    redone = elect_canonical(cards.join(touched, "group_key", "left_semi"))
    return cards.join(touched, "group_key", "left_anti").unionByName(redone.select(*cards.columns))


def import_batch(table: KeyedTable, cards: DataFrame, version: int, known_by: str = KNOWN_BY) -> None:
    """Store a batch of derived cards in a table keyed by group_key, and elect the canonical cards of their groups anew.

    Cards that are there already (by known_by, in any bucket) are left out; of the others all stay, twins too. Only the
    buckets of the new cards' groups are rewritten, and in them only those groups are elected. Versions go up;
    one that is run again does the same again.
    """
    fresh = merge.not_in(cards, table.rows(before=version), [known_by])

    def make(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new.withColumns({"variant_count": F.lit(1).cast("bigint"), "is_canonical": F.lit(False)}).select(*old.columns))
        # cards without a group key stand alone
        return recanonicalise(both, new).withColumn("is_canonical", F.when(F.coalesce("group_key", F.lit("")) == "", True).otherwise(F.col("is_canonical")))

    table.rewrite(fresh, version, make)


def predicate(min_highlight: int = 0, scope: str | None = None, type: str | None = None, topic: str | None = None, resolution: str | None = None, source: str | None = None, canonical: bool | None = None) -> Column:
    """Highlighted cards that meet each condition that is given."""
    parts = [F.col("has_highlight")]
    if min_highlight > 0:
        parts.append(F.col("highlight_words") >= min_highlight)
    if scope in ("my", "public"):
        parts.append(F.col("scope") == scope)
    if type:
        parts.append(F.lower("type_label") == type.lower())
    for column, wanted in (("topic_label", topic), ("resolution_label", resolution), ("source_label", source)):
        if wanted:
            parts.append(F.col(column) == wanted)
    if canonical is not None:
        parts.append(F.col("is_canonical") if canonical else ~F.col("is_canonical"))
    return reduce(lambda a, b: a & b, parts)


def order(sort: str = "relevance", seed: int = 1, key: str = "doc_id") -> list[Column]:
    """Sort columns of a mode; `random` is a seeded order over a numeric key, the same on every page."""
    lit = F.col("has_highlight").desc()
    if sort == "random":
        s = max(1, abs(int(seed)))
        return [F.pmod(F.col(key) * s + (s * 2654435761) % (1 << 32), F.lit(2147483647)), F.col("id")]
    modes = {
        "recent": [F.desc("imported_at")], "density": [F.desc("warrant_density")], "variants": [F.desc("variant_count")], "cite": [F.coalesce(F.nullif(F.col("short_cite"), F.lit("")), F.col("cite")).asc()],
        "school": [F.asc("school")], "tag": [F.asc("tag")],
    }
    return [lit, *modes.get(sort, [F.desc("is_canonical"), F.desc("variant_count"), F.desc("imported_at")]), F.col("id").asc()]


def page(cards: DataFrame, orders: list[Column], number: int = 1, limit: int = 40) -> DataFrame:
    """One page of an order; Spark keeps (number x limit) rows a task and no more."""
    return cards.orderBy(*orders).offset((number - 1) * limit).limit(limit)


def by_ids(cards: DataFrame, ids: list[str], where: Column | None = None, most: int = 500) -> DataFrame:
    """Cards of a caller's list (at most `most` ids), in its order, with pos."""
    spark = cards.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i, n) for n, i in enumerate(ids[:most])], "id string, pos int"))
    return cards.filter(where if where is not None else F.lit(True)).join(wanted, "id").orderBy("pos")


def count_by(df: DataFrame, column: str | Column, default: str, top: int | None = None) -> DataFrame:
    """label, count: blanks count under default; the largest first, then by label."""
    c = F.col(column) if isinstance(column, str) else column
    out = df.groupBy(F.coalesce(F.nullif(c, F.lit("")), F.lit(default)).alias("label")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")
    return out.limit(top) if top else out


def facets(cards: DataFrame, scope: str | None = None, limit: int = 20, source_limit: int = 10, kinds: tuple[str, ...] = ("resolution_label", "type_label", "topic_label", "source_label")) -> DataFrame:
    """kind, label, count of highlighted cards: the largest labels of each kind, from one scan."""
    rows = cards.filter("has_highlight")
    rows = rows.filter(F.col("scope") == scope) if scope else rows
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in kinds))).alias("x")).select("x.*")
    counts = pairs.filter("label <> ''").groupBy("kind", "label").agg(F.count("*").alias("count"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("count"), "label"))
    return counts.withColumn("_n", nth).filter(F.col("_n") <= F.when(F.col("kind") == "source_label", source_limit).otherwise(limit)).drop("_n")


def totals(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count("*").alias("cards"), F.count_if("is_canonical").alias("canonical"), F.countDistinct("school").alias("schools"), F.countDistinct("resolution_label").alias("resolutions"))


def library_analytics(cards: DataFrame, top: int = 6) -> DataFrame:
    """Totals and the top labels, tagged by kind, in one result."""
    none = F.lit(None).cast("bigint")
    head = totals(cards).select(F.lit("totals").alias("kind"), F.lit(None).cast("string").alias("label"), "cards", "canonical", "schools", "resolutions")
    tops = facets(cards, limit=top, kinds=("resolution_label", "type_label", "topic_label")).select("kind", "label", F.col("count").alias("cards"), none.alias("canonical"), none.alias("schools"), none.alias("resolutions"))
    return head.unionByName(tops)


def import_statistics(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count("*").alias("total_cards"), F.count_if("is_canonical").alias("canonical_groups"), F.countDistinct(F.when(F.col("short_cite") != "", F.col("short_cite"))).alias("citation_groups"))


def value_counts(df: DataFrame, array: Column, top: int = 8) -> DataFrame:
    rows = df.select(F.explode(array).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label").limit(top)


def strict_canonical(cards: DataFrame, min_highlight: int = 6, delete: bool = False) -> DataFrame:
    """Groups by citation and body prefix: the card with the best body wins and takes the group's best tag.

    Cards with few highlighted words or beaten by another are demoted, or left out with delete. Cards without
    a key stay as they are.
    """
    k = cards.withColumns({"hl": text.highlight_words_nested(F.col("body_markdown")), "key": text.group_key(F.col("short_cite"), F.col("body_plain")), "tscore": F.round(labels.tag_score(F.col("tag")), 6)})
    k = k.withColumn("bscore", F.length(text.text(F.col("body_plain"))) + F.col("hl") * 10)
    joined = k.filter((F.col("hl") >= min_highlight) & (F.col("key") != ""))
    best = joined.groupBy("key").agg(
        F.min(F.struct((-F.col("bscore")).alias("s"), "id")).alias("w"), F.min(F.struct((-F.col("tscore")).alias("s"), "id", "tag")).alias("t"), F.count("*").alias("group_size")
    ).select("key", F.col("w.id").alias("winner"), F.col("t.tag").alias("best_tag"), "group_size")
    out = k.join(best, "key", "left")
    few = F.col("hl") < min_highlight
    wins = ~few & (F.col("key") != "") & (F.col("id") == F.col("winner"))
    lost = few | ((F.col("key") != "") & ~wins)
    out = out.withColumns({
        "tag": F.when(wins & (F.col("group_size") > 1) & (text.text(F.col("best_tag")) != ""), F.col("best_tag")).otherwise(F.col("tag")),
        "is_canonical": F.when(wins, True).when(lost, False).otherwise(F.col("is_canonical")), "variant_count": F.when(wins, F.col("group_size")).otherwise(F.col("variant_count")), "dropped": lost,
    })
    out = out.drop("hl", "key", "tscore", "bscore", "winner", "best_tag", "group_size")
    return out.filter(~F.col("dropped")).drop("dropped") if delete else out


def first_of(df: DataFrame, keys: list[str], *orders: Column | str) -> DataFrame:
    """The first row of each key in an order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*orders))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def dedupe_by_tag(cards: DataFrame, pos: str = "doc_id") -> DataFrame:
    """One card for each normal tag: the first canonical one, else the most highlighted; at the key's first place. Blank keys stay."""
    k = cards.withColumn("_key", text.tag_key(F.col("tag")))
    ranked = k.filter("_key <> ''").withColumn("place", F.min(pos).over(Window.partitionBy("_key")))
    ranked = first_of(ranked, ["_key"], F.desc("is_canonical"), F.when(F.col("is_canonical"), 0).otherwise(F.col("highlight_words")).desc(), F.asc(pos))
    return ranked.drop("_key").unionByName(k.filter("_key = ''").withColumn("place", F.col(pos)).drop("_key"))


def contains_all_fields(query: str, columns: list[str]) -> Column:
    """The query somewhere in the joined fields, whatever the case; a blank query fits all."""
    if not query.strip():
        return F.lit(True)
    return F.lower(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in columns))).contains(query.strip().lower())


def search_analytics(analytics: DataFrame, query: str = "", limit: int = 50) -> DataFrame:
    rows = analytics
    if query.strip():
        q = query.lower()
        rows = rows.filter(F.lower("content_plain").contains(q) | F.lower("title").contains(q)).withColumn("excerpt", F.substring("content_plain", 1, 500))
    return rows.orderBy(F.desc("imported_at"), "id").limit(limit)


def needs_classification(cards: DataFrame, canonical_only: bool = False, limit: int = 100) -> DataFrame:
    types, tags = labels.json_array(F.col("argument_types")), labels.json_array(F.col("argument_tags"))
    none = F.array(F.lit("none"))
    wants = (F.size(tags) == 0) | (tags == none) | (F.size(types) == 0) | (types == none)
    rows = cards.filter(wants & F.col("is_canonical")) if canonical_only else cards.filter(wants)
    return rows.orderBy(F.desc("imported_at"), "id").limit(limit)


def clean_topics(cards: DataFrame, banned: list[str]) -> DataFrame:
    """id, before, after of the cards that lose a banned tag."""
    before = labels.json_array(F.col("argument_tags"))
    after = F.filter(before, lambda t: ~F.lower(t).isin(*(b.lower() for b in banned)))
    return cards.select("id", before.alias("before"), after.alias("after")).filter("size(before) <> size(after)")


def keyword_rank(cards: DataFrame, query: str, pos: str = "doc_id") -> DataFrame:
    """score by where the query's words occur: 100 in the tag, 50 at its start, 20 in the citation, 5 in the body, 200 for the whole query in the tag."""
    needle = query.strip().lower()
    tag, cite, body = F.lower(text.text(F.col("tag"))), F.lower(text.text(F.coalesce(F.nullif("cite", F.lit("")), F.col("short_cite")))), F.lower(text.text(F.col("body_plain")))
    s = F.lit(0)
    for t in needle.split():
        s = s + F.when(tag.contains(t), 100).otherwise(0) + F.when(tag.startswith(t), 50).otherwise(0) + F.when(cite.contains(t), 20).otherwise(0) + F.when(body.contains(t), 5).otherwise(0)
    s = s + F.when(tag.contains(needle), 200).otherwise(0) if needle else s
    return cards.withColumn("score", s).orderBy(F.desc("score"), pos)


def bullets(cards: DataFrame, orders: list[Column], top: int = 5) -> DataFrame:
    """line_no, line: `Tag (cite | topic | type)` of the first cards."""
    n = F.row_number().over(Window.orderBy(*orders))
    meta = F.concat_ws(" | ", *(F.nullif(c, F.lit("")) for c in (F.coalesce(F.nullif("short_cite", F.lit("")), F.col("cite")), F.col("topic_label"), F.col("type_label"))))
    tag = F.coalesce(F.nullif("tag", F.lit("")), F.lit("Untitled card"))
    rows = cards.orderBy(*orders).limit(top)
    return rows.select(n.alias("line_no"), F.when(meta != "", F.concat(tag, F.lit(" ("), meta, F.lit(")"))).otherwise(tag).alias("line"))

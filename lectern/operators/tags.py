"""Tags in normal form, with words that were split put together by a table of words.

"d omain" and "realisti c" are one word each if the table has it. Candidates are looked for twice, as they stand in the
tag from left to right: a stray letter before a word, and then one after a word; "a" and "i" are words themselves, and
a letter at an apostrophe belongs to what is before it. Each candidate is a row (tag, place, word), all of them meet the
table of words in one equality join, and a tag is written anew from the places that were found.

Defined results: null and empty tags stay as they are; repeated rows come out as often as they go in; where nothing is
left of a tag, the tag itself stays; an empty table of words puts nothing together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import labels, text

#: A stray letter before a word: what stands before it, the letter, the word. The same after a word: the word, the letter.
_NEAR = "A-Za-z’'"
BEFORE = f"(^|[^{_NEAR}])([a-zA-Z])(?U:\\s+)([a-zA-Z]{{2,}})(?![A-Za-z0-9_])"
AFTER = f"(?<![A-Za-z0-9_])([a-zA-Z]{{2,}})(?U:\\s+)([a-zA-Z])(?=\\z|[^{_NEAR}])"
#: Letters that are words.
LETTER_WORDS = ("a", "i")
#: A table of at most so many words is sent to all tasks; a larger one meets the candidates in a shuffle.
SMALL = 500_000


def vocabulary(docs: DataFrame, column: str, least: int = 3) -> DataFrame:
    """(word): lower-case words of two ASCII letters or more that occur `least` times in the column."""
    w = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(column).cast("string")), F.lit("\\p{L}+"), F.lit(0))).alias("word"))
    return w.filter(F.col("word").rlike("^[a-z]{2,}$")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("word")


def _pieces(m: Column, form: str) -> tuple[Column, Column, Column]:
    """What comes before, the letter in lower case, and the joined word, of a match of BEFORE or AFTER."""
    one, two = F.regexp_extract(m, form, 1), F.regexp_extract(m, form, 2)
    if form == BEFORE:
        return one, F.lower(two), F.concat(two, F.regexp_extract(m, form, 3))
    return F.lit(""), F.lower(two), F.concat(one, two)


def _joined(rows: DataFrame, form: str, words: DataFrame) -> DataFrame:
    """rows (_key, _text) with the candidates of one form put together where `words` has them."""
    some = rows.filter(F.col("_text").rlike(form))
    found = some.select("_key", "_text", F.posexplode(F.regexp_extract_all("_text", F.lit(form), F.lit(0))).alias("place", "m"))
    _, letter, word = _pieces(F.col("m"), form)
    found = found.filter(~letter.isin(*LETTER_WORDS)).select("_key", "_text", "place", F.lower(word).alias("word"))
    places = found.join(words, "word").groupBy(F.col("_key").alias("_k"), F.col("_text").alias("_t")).agg(F.collect_set("place").alias("places"))
    out = some.join(places, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_text") == F.col("_t")), "left").select("_key", "_text", "places")
    matches = F.regexp_extract_all("_text", F.lit(form), F.lit(0))

    def written(m: Column, k: Column) -> Column:
        before, _, word = _pieces(m, form)
        return F.when(F.array_contains("places", k), F.concat(before, word)).otherwise(m)

    # the text between matches, and each match as it is to be
    between = F.split("_text", form, -1)
    whole = F.array_join(F.flatten(F.transform(between, lambda x, k: F.array(x, F.coalesce(F.get(F.transform(matches, written), k), F.lit(""))))), "")
    done = out.select("_key", F.col("_text").alias("_from"), F.when(F.col("places").isNotNull(), whole).otherwise(F.col("_text")).alias("_text"))
    return done.unionByName(rows.filter(~F.col("_text").rlike(form)).select("_key", F.col("_text").alias("_from"), "_text"))


def repaired(rows: DataFrame, words: DataFrame, column: str, key: str) -> DataFrame:
    """(key, before, after) of the distinct texts of a column that change when split words are put together.

    Only rows with a stray letter go anywhere; key spreads equal texts over tasks.
    """
    words = words.select("word").distinct()
    words = F.broadcast(words) if words.limit(SMALL + 1).count() <= SMALL else words
    start = rows.select(F.col(key).alias("_key"), F.col(column).alias("_text")).filter(F.col("_text").rlike(f"{BEFORE}|{AFTER}")).distinct()
    once = _joined(start, BEFORE, words).select(F.struct("_key", "_from").alias("_key"), "_text")
    twice = _joined(once, AFTER, words).filter(F.col("_key._from") != F.col("_text"))
    return twice.select(F.col("_key._key").alias(key), F.col("_key._from").alias("before"), F.col("_text").alias("after"))


def normalised(cards: DataFrame, words: DataFrame | None = None, column: str = "tag", key: str = "id", to: str = "normal_tag", tidy: bool = True) -> DataFrame:
    """cards with the normal form of a column. words (word, lower case): what split words may be; none: they stay split.

    tidy: without it only split words are mended, with a capital; remarks, numbering and spaces at the ends stay.
    """
    if words is None:
        return cards.withColumn(to, labels.normal_tag(F.col(column)))
    held = cards.withColumn("_trimmed", labels.trimmed_tag(F.col(column)) if tidy else F.coalesce(column, F.lit("")))
    mended = repaired(held, words, "_trimmed", key).select(F.col(key).alias("_key"), F.col("before").alias("_before"), F.col("after").alias("_after"))
    j = held.join(mended, held[key].eqNullSafe(F.col("_key")) & (F.col("_trimmed") == F.col("_before")), "left")
    mended = F.coalesce("_after", "_trimmed")
    return j.withColumn(to, labels.finished_tag(F.col(column), mended) if tidy else F.when(F.col(column).isNotNull(), text.capital(mended))).drop("_trimmed", "_key", "_before", "_after")


def changes(cards: DataFrame, words: DataFrame | None = None, column: str = "tag", key: str = "id", tidy: bool = True) -> DataFrame:
    """(key, before, after) for every card whose normal form is another; empty and null tags aren't looked at."""
    done = normalised(cards.select(key, column).filter(F.col(column) != ""), words, column, key, "after", tidy)
    return done.select(key, F.col(column).alias("before"), "after").filter("before <> after")


def renormalised(cards: DataFrame, words: DataFrame | None = None, column: str = "tag", key: str = "id", tidy: bool = True) -> DataFrame:
    """cards with all changes made; key names one card."""
    new = changes(cards, words, column, key, tidy).select(key, F.col("after").alias("_after"))
    return cards.join(new, key, "left").withColumn(column, F.coalesce("_after", column)).select(*cards.columns)

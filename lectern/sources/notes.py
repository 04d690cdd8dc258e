"""Notes: one text for each card, by topic folder, and an index for each folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import slug, text


def notes(cards: DataFrame) -> DataFrame:
    """folder, name, note: a header of fields and the card's body."""
    q = lambda c: F.concat(F.lit('"'), F.replace(text(F.col(c)), F.lit('"'), F.lit("'")), F.lit('"'))
    head = F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{c}: "), q(c)) for c in ("id", "tag", "cite", "school", "topic_label", "type_label")), F.lit("---"))
    note = F.concat_ws("\n\n", head, F.concat(F.lit("# "), text(F.col("tag"))), text(F.col("body_markdown")))
    return cards.select(F.col("topic_label").alias("folder"), F.concat_ws("-", F.substring(slug(F.col("tag")), 1, 60), "id").alias("name"), note.alias("note"))


def index_notes(cards: DataFrame, most: int = 200) -> DataFrame:
    """folder, note: a list of the folder's first cards; `most` bounds what one row holds."""
    n = F.row_number().over(Window.partitionBy("topic_label").orderBy("id"))
    rows = cards.select("topic_label", "id", "tag").withColumn("_n", n).filter(F.col("_n") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", "tag"))), lambda x: F.concat(F.lit("- "), x["tag"]))
    return rows.groupBy(F.col("topic_label").alias("folder")).agg(F.concat(F.lit("# "), F.first("topic_label"), F.lit("\n"), F.array_join(lines, "\n")).alias("note"))


def write_notes(cards: DataFrame, path: str) -> None:
    notes(cards).select("folder", F.col("note").alias("value")).write.mode("overwrite").partitionBy("folder").option("lineSep", "\n\x0c\n").text(path)

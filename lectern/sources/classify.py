"""Applying a classifier to cards in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import labels
from lectern.functions.text import let
from lectern.sources.scratch import written

TYPES = ("policy", "k", "phil", "theory", "tricks", "none")
BATCH = 25


def classify(cards: DataFrame, classify_fn: Callable[[pd.DataFrame], pd.DataFrame], fallback: Callable[[pd.DataFrame], pd.DataFrame] | None = None, batch: int = BATCH) -> DataFrame:
    """id, types, topics from classify_fn(id, tag, body_plain), at most `batch` rows at a time; fallback where it raises."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                some = f.iloc[at : at + batch]
                try:
                    yield classify_fn(some)[["id", "types", "topics"]]
                except Exception:
                    if fallback is None:
                        raise
                    yield fallback(some)[["id", "types", "topics"]]

    return cards.select("id", "tag", "body_plain").mapInPandas(run, "id string, types array<string>, topics array<string>")


def valid_types(types: Column) -> Column:
    kept = F.filter(F.transform(types, lambda t: F.lower(F.trim(t))), lambda t: t.isin(*TYPES))
    return F.when(F.size(F.coalesce(kept, F.array().cast("array<string>"))) > 0, F.array_distinct(kept)).otherwise(F.array(F.lit("none")))


def valid_topics(topics: Column, most: int = 8) -> Column:
    kept = F.filter(F.transform(topics, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.slice(F.array_distinct(F.coalesce(kept, F.array().cast("array<string>"))), 1, most)


#: Rule names and the types that cards carry.
RULE_TYPES = {"kritik": "k", "da": "policy", "counterplan": "policy", "theory": "theory", "tricks": "tricks", "phil": "phil", "policy": "policy", "none": "none"}


def apply_classifier(cards: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """cards with validated argument_types and argument_tags: a classifier's, or by default the keyword rules'."""
    if classified is None:
        source = labels.classify_text(F.col("tag"), F.col("body_plain"))
        types = F.transform(labels.argument_types(source), lambda t: F.coalesce(labels.lookup(RULE_TYPES, t), F.lit("none")))
        return cards.withColumns({"argument_types": let(types, valid_types), "argument_tags": F.array().cast("array<string>")})
    c = classified.select("id", valid_types(F.col("types")).alias("argument_types"), valid_topics(F.col("topics")).alias("argument_tags"))
    return cards.drop("argument_types", "argument_tags").join(c, "id", "left")


def in_passes(cards: DataFrame, classifiers: list[Callable[[pd.DataFrame], pd.DataFrame]], batch: int = BATCH) -> DataFrame:
    """(id, argument_types, argument_tags): validated results; what one classifier leaves at `none` goes to the next.

    A card that none of them can tell keeps the topics of the first. Each pass is written, so no model is asked twice; id
    names one card; a null text is an empty one to a classifier that takes it so.
    """
    left, told = cards.select("id", "tag", "body_plain"), None
    for n, classify_fn in enumerate(classifiers):
        c = classify(left, classify_fn, batch=batch)
        c = written(c.select("id", valid_types(F.col("types")).alias("argument_types"), valid_topics(F.col("topics")).alias("argument_tags")), f"pass{n}")
        sure = F.col("argument_types") != F.array(F.lit("none"))
        if told is None:
            told, first = c.filter(sure), c.filter(~sure)
        else:
            told = told.unionByName(c.filter(sure))
        left = left.join(c.filter(~sure), "id", "left_semi")
    return told.unionByName(first.join(left, "id", "left_semi"))


def reclassified(cards: DataFrame, told: DataFrame) -> DataFrame:
    """Stored cards with what `in_passes` told of them, and the labels that follow from it; other cards stay as they are."""
    new = told.select("id", F.col("argument_types").alias("_types"), F.col("argument_tags").alias("_tags"))
    j = cards.join(new, "id", "left")
    known = F.col("_types").isNotNull()
    fields = {
        "argument_types": F.to_json("_types"), "argument_tags": F.to_json("_tags"), "type_label": labels.type_label(F.col("_types")), "topic_label": labels.topic_label(F.col("_tags"), F.col("topic_bucket")),
    }
    return j.withColumns({c: F.when(known, x).otherwise(F.col(c)) for c, x in fields.items()}).select(*cards.columns)

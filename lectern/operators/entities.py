"""Entity resolution of search results by DOI, URL or title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators.components import components, joined
from lectern.operators.search import SCHOLARLY_ADAPTERS
from lectern.sources.scratch import written


def keys(items: DataFrame, id_col: str) -> DataFrame:
    """(id, key): the DOI, the URL without fragment and closing slash, and the normal title of each item that has a URL."""
    d, u, t = text.doi(F.col("doi"), F.col("url")), text.url_key(F.col("url")), text.title_key(F.col("title"))
    some = F.array(F.when(d != "", F.concat(F.lit("doi:"), d)), F.concat(F.lit("url:"), u), F.when(t != "", F.concat(F.lit("title:"), t)))
    return items.filter("url <> ''").select(F.col(id_col).alias("id"), F.explode(F.filter(some, lambda x: x.isNotNull())).alias("key"))


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster): items connected by keys, named by their smallest id.

    The items of a key are linked with its smallest item, so a key in very many items makes no more links than items.
    """
    pairs = written(pairs.select("id", "key").distinct(), "pairs")
    keyed = written(pairs.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("n")), "keys")
    found = components(joined(pairs, keyed, "key").select(F.col("id").alias("a"), "b"))
    return pairs.select("id").distinct().join(found.withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("cluster"))


def resolve(items: DataFrame, id_col: str) -> DataFrame:
    """One item of each cluster: a scholarly source first, then open access, then the smallest id; with the cluster's size."""
    c = items.withColumnRenamed(id_col, "id").join(clusters(keys(items, id_col)), "id")
    open_ = F.concat_ws(" ", "adapter", "url").rlike("(?i)doi\\.org|unpaywall|pmc|arxiv|openalex")
    best = F.min(F.struct((~F.col("adapter").isin(*SCHOLARLY_ADAPTERS)).alias("a"), (~open_).alias("b"), "id", "url", "title")).alias("x")
    return c.groupBy("cluster").agg(best, F.count("*").alias("n")).select("cluster", F.col("x.id").alias("id"), F.col("x.url").alias("url"), F.col("x.title").alias("title"), "n")

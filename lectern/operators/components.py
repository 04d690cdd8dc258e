"""Connected components by alternating stars, without a task that a hot vertex could fill.

Each round points the greater neighbours of every vertex to its least neighbour, and then the lesser ones too. Paths get
shorter by a constant factor each time, and at the end every vertex points to the least of its component. A vertex with
very many edges meets its least neighbour in a broadcast of few such vertices, all others in a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.scratch import written

#: A key that holds more than one in so many rows is hot; there are at most so many of them.
SHARE = 1000


def joined(rows: DataFrame, keyed: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows joined with keyed (a row for each key; n: how many of rows hold it), without a hot task. Both are read twice."""
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot, others = keyed.filter(F.col(n) > total / SHARE), keyed.filter(F.col(n) <= total / SHARE)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(others.hint("merge"), key))


def _star(rows: DataFrame) -> DataFrame:
    """rows (a, b) with m, the least of a and its neighbours."""
    return joined(rows, written(rows.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")), "least"), "a")


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for the vertices of edges (a, b): the least vertex that each one reaches; written. Loops and null ends are left out."""
    links = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        large = written(_star(both).filter("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        small = _star(large)
        links = written(small.select("a", F.col("m").alias("b")).union(small.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return written(links.select(F.col("a").alias("v"), F.col("b").alias("label")).union(links.select("b", "b")).distinct(), "components")

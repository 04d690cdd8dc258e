"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the wanted rows over the rows that it has. A
document's number of copies is the inverse of the Poisson distribution with that mean at a uniform
number that a hash of the seed and doc_id gives, so it doesn't depend on partitioning, and documents are
independent. A rate above PART is a sum of equal rates up to PART, each inverted at a number of its own (a sum of
independent Poisson numbers is one again), so the table of the distribution stays short at any rate. Copies are exploded and the whole is shuffled by a hash of document and copy, which spreads
a hot source over all partitions. Only built-in functions are used.

Defined results: a source without a target weight keeps its rows once each, as do rows with a null source; a
target for a source that has no rows is left out and the rest scaled up; rows with a null doc_id are drawn by their
text's hash; repeated rows get the same number of copies each; an empty table gives no rows; columns of other
names are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import let

#: The largest mean that is inverted at once.
PART = 50.0


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _uniform_part(seed: str, name: Column, part: Column) -> Column:
    """The number of a rate's part: the first one has the plain name."""
    return uniform(seed, F.when(part == 0, name).otherwise(F.concat_ws("/", name, part.cast("string"))))


def thresholds(rate: float) -> list[float]:
    """The Poisson distribution function at 0, 1, 2, ... up to where it is 1 within rounding."""
    if not 0 <= rate <= PART:
        raise ValueError(f"a rate of {rate:g} is outside 0 to {PART:g}")
    term = total = math.exp(-rate)
    out, n = [total], 0
    while total < 1 - 1e-15 and (n < rate or term > 1e-18):
        n += 1
        term *= rate / n
        total += term
        out.append(total)
    return out


def rates(docs: DataFrame, weights: dict[str, float], rows: float | None = None) -> dict[str, float]:
    """Mean copies of a document by source. rows: how many to aim at in all (default: as many as there are now)."""
    if any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError("weights must be at least 0, and one of them more")
    # at most as many rows as there are weights
    counts = {r["source"]: r["n"] for r in docs.filter(F.col("source").isin(list(weights))).groupBy("source").agg(F.count("*").alias("n")).collect()}
    total = sum(w for s, w in weights.items() if s in counts)
    aim = sum(counts.values()) if rows is None else rows
    return {s: aim * weights[s] / total / n for s, n in counts.items() if total}


def mix(docs: DataFrame, weights: dict[str, float], rows: float | None = None, seed: str = "mix-1", named: tuple[str, str] = ("copy", "shuffle_key")) -> DataFrame:
    """The rows of docs, each as often as drawn, with copy (from 0) and shuffle_key, spread by that key.

    named: what to call these two; columns of docs with the same names are replaced.
    """
    copy, shuffle_key = named
    rate = rates(docs, weights, rows)
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    n = F.lit(1)
    if rate:
        parts = {s: max(1, math.ceil(r / PART)) for s, r in rate.items()}
        of = F.create_map(*(x for s, r in sorted(rate.items()) for x in (F.lit(s), F.struct(F.lit(parts[s]).alias("parts"), F.array(*map(F.lit, thresholds(r / parts[s]))).alias("steps")))))
        source = F.try_element_at(of, F.coalesce(F.col("source"), F.lit("")))

        def drawn_at(s: Column) -> Column:
            """How many of the thresholds the uniform number of each part has reached."""
            one = lambda part: F.size(F.filter(s["steps"], lambda t: t <= _uniform_part(seed, name, part)))
            return F.aggregate(F.sequence(F.lit(0), s["parts"] - 1), F.lit(0), lambda total, part: total + one(part))

        n = F.when(source.isNull(), 1).otherwise(let(source, drawn_at))
    drawn = docs.drop(*named).withColumn("_lectern_n", n).filter("_lectern_n > 0")
    copies = drawn.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col("_lectern_n") - 1))).drop("_lectern_n")
    keyed = copies.withColumn(shuffle_key, F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), name, F.col(copy).cast("string")).cast("binary")))
    return keyed.repartition(shuffle_key).sortWithinPartitions(shuffle_key)


def rates_sql(weights: dict[str, float]) -> str:
    """DuckDB: (source, rate) for the default number of rows."""
    listed = ", ".join(f"('{s}', {w!r})" for s, w in sorted(weights.items()))
    return f"""SELECT source, sum(n) OVER () * w / sum(w) OVER () / n AS rate FROM
      (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source) c JOIN (VALUES {listed}) t(source, w) USING (source)"""


def mix_sql(weights: dict[str, float], seed: str = "mix-1", most: int = 400) -> str:
    """DuckDB SQL for doc_id, source, lang, text, copy and shuffle_key of `mix` over documents with doc_ids."""
    return f"""
    WITH rate AS ({rates_sql(weights)}),
    parts AS (SELECT source, rate, greatest(1, ceil(rate / {PART!r}))::INT AS parts FROM rate),
    term AS (SELECT source, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) AS p FROM parts, range({most}) r(k)),
    cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM term),
    part AS (SELECT d.doc_id, d.source, unnest(range(parts)) AS part FROM documents d JOIN parts USING (source)),
    drawn AS (SELECT doc_id, source, part, ('0x' || substr(md5('{seed}:' || doc_id || CASE WHEN part = 0 THEN '' ELSE '/' || part END), 1, 13))::BIGINT / {float(1 << 52)!r} AS u FROM part),
    reached AS (SELECT doc_id, sum((SELECT count(*) FROM cdf WHERE cdf.source = drawn.source AND cdf.f <= drawn.u)) AS n FROM drawn GROUP BY doc_id),
    counted AS (SELECT d.*, CASE WHEN r.source IS NULL THEN 1 ELSE n END AS n FROM documents d LEFT JOIN rate r ON d.source = r.source LEFT JOIN reached USING (doc_id))
    SELECT doc_id, source, lang, text, copy::INTEGER AS copy, md5('{seed}/order:' || doc_id || ':' || copy) AS shuffle_key
    FROM counted, LATERAL (SELECT unnest(range(n::BIGINT)) AS copy) x
    """

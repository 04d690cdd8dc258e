"""A keyword index in order of its terms: prefixes are ranges, and a search reads only the parts that it needs.

Postings are dealt by ranges of (term, key), so a part holds a run of terms and a term in many documents spans parts; each
part is a folder, and a small table says from which term to which it goes. Which parts some terms or prefixes need is
looked up there, and only those folders are read. Queries meet postings by equality: an exact token its term, and
a prefix the beginnings of terms of that length, so many queries run in one join.

An index over several owners' documents is dealt by a hash of the owner, and every statistic is the owner's.

Defined results: null and empty texts have no terms; a query without a token finds nothing, but in `team_search`, where it
gives the first names of all; ties are broken by key; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lectern.operators import search as S

#: Queries with so many tokens in all are sent to all tasks; more meet the postings in a shuffle.
SMALL = 10_000
PART, SALTS = "_part", 1 << 20


class Lexicon:
    """Postings (key, term, tf) and the lengths of the documents, written to a path and read from there."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path, key

    def write(self, docs: DataFrame, fields: list[str], parts: int = 64) -> Lexicon:
        """Index the fields of docs, one row for each key."""
        posts = S.postings(docs, fields, self.key).groupBy(self.key, "term").agg(F.sum("tf").alias("tf"))
        dealt = posts.withColumn("_salt", F.pmod(F.xxhash64(self.key), F.lit(SALTS))).repartitionByRange(parts, "term", "_salt").sortWithinPartitions("term", self.key)
        dealt.select(self.key, "term", "tf", F.spark_partition_id().alias(PART)).write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/postings")
        ranges = self._postings(posts.schema).groupBy(PART).agg(F.min("term").alias("least"), F.max("term").alias("greatest"), F.count("*").alias("n"))
        ranges.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ranges")
        S.lengths(docs, fields, self.key).write.mode("overwrite").parquet(f"{self.path}/lengths")
        return self

    def _postings(self, schema: StructType | None = None) -> DataFrame:
        if schema is None:
            return self.spark.read.parquet(f"{self.path}/postings")
        return self.spark.read.schema(StructType([*schema.fields]).add(PART, IntegerType())).parquet(f"{self.path}/postings")

    @property
    def lengths(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lengths")

    def parts(self, terms: set[str], prefixes: set[str]) -> list[int]:
        """The parts that can hold them: at most as many numbers as the index has parts."""
        wanted = [(t, t) for t in terms] + [(p, p + "\U0010ffff") for p in prefixes]
        asked = self.spark.createDataFrame(wanted or [("", "")], "low string, high string").limit(len(wanted))
        ranges = self.spark.read.parquet(f"{self.path}/ranges")
        met = F.broadcast(ranges).join(asked, (F.col("least") <= F.col("high")) & (F.col("greatest") >= F.col("low")))
        return sorted(r[0] for r in met.select(PART).distinct().collect())

    def postings(self, terms: set[str], prefixes: set[str] = frozenset()) -> DataFrame:
        """All postings of the parts that the terms and prefixes need."""
        if not terms and not prefixes:
            return self._postings().limit(0).drop(PART)
        return self._postings().filter(F.col(PART).isin(self.parts(terms, prefixes))).drop(PART)

    def hits(self, queries: dict[int, list[tuple[str, bool]]]) -> DataFrame:
        """query_id, n, key, tf: documents with the n-th token of a query, a term or (True) the beginning of one."""
        rows = [(i, n, f"{len(t)}" if prefix else "", t) for i, tokens in queries.items() for n, (t, prefix) in enumerate(tokens)]
        q = self.spark.createDataFrame(rows or [(0, 0, "", "")], "query_id int, n int, kind string, value string").limit(len(rows))
        q = F.broadcast(q) if len(rows) <= SMALL else q
        posts = self.postings({r[3] for r in rows if not r[2]}, {r[3] for r in rows if r[2]})
        ways = [F.struct(F.lit("").alias("kind"), F.col("term").alias("value"))] if any(not r[2] for r in rows) else []
        ways += [F.struct(F.lit(k).alias("kind"), F.substring("term", 1, int(k)).alias("value")) for k in sorted({r[2] for r in rows if r[2]})]
        each = posts.select(self.key, "tf", F.inline(F.array(*ways)) if ways else F.expr("inline(array(struct('' as kind, '' as value)))"))
        return each.join(q, ["kind", "value"]).groupBy("query_id", "n", self.key).agg(F.sum("tf").alias("tf"))

    def matching(self, queries: dict[int, list[tuple[str, bool]]]) -> DataFrame:
        """query_id, key, score: documents with every token of a query, by BM25 (lower is better)."""
        tokens = self.spark.createDataFrame([(i, len(set(t))) for i, t in queries.items()] or [(0, 0)], "query_id int, n_tokens int")
        hits = self.hits({i: list(dict.fromkeys(t)) for i, t in queries.items()})
        df = hits.groupBy("query_id", "n").agg(F.count("*").alias("df"))
        stats = self.lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))  # one row
        rows = hits.join(df, ["query_id", "n"]).join(self.lengths, self.key).crossJoin(F.broadcast(stats))
        scored = rows.groupBy("query_id", self.key).agg(F.round(-F.sum(_part("n_docs", "mean")), 6).alias("score"), F.count("*").alias("found"))
        return scored.join(tokens, "query_id").filter("found = n_tokens").select("query_id", self.key, "score")


def _part(n: str, mean: str):
    idf = F.greatest(F.log((F.col(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return idf * F.col("tf") * (S.K1 + 1) / (F.col("tf") + S.K1 * (1 - S.B + S.B * F.col("length") / F.col(mean)))


def prefix_tokens(query: str) -> list[tuple[str, bool]]:
    """Every token a prefix, in any order."""
    return [(t, True) for t in dict.fromkeys(S.query_terms(query))]


def team_tokens(query: str) -> list[tuple[str, bool]]:
    """The last token a prefix, those before it whole; quotes and signs fall away, and - and _ part tokens."""
    kept = [re.sub("[^A-Za-z0-9_-]", "", t) for t in re.sub("[\"']", "", query).split()]
    parts = [p for t in kept for p in S.query_terms(t.replace("_", " "), 1)]
    return [(p, n == len(parts) - 1) for n, p in enumerate(parts)]


def team_search(index: Lexicon, teams: DataFrame, queries: dict[int, str], limit: int = 100, name: str = "full_name") -> DataFrame:
    """query_id, rank and the teams (key, name and all else) of each query: the best first; blank queries give names in order."""
    tokens = {i: team_tokens(q) for i, q in queries.items()}
    blank = [i for i, t in tokens.items() if not t]
    found = S.list_rank(index.matching({i: t for i, t in tokens.items() if t}), "score", index.key).filter(F.col("rank") <= limit).select("query_id", index.key, "rank")
    if blank:
        first = teams.select(index.key, name).orderBy(name, index.key).limit(limit)
        ids = teams.sparkSession.createDataFrame([(i,) for i in blank], "query_id int")
        found = found.unionByName(S.list_rank(first.crossJoin(F.broadcast(ids)), name, index.key).select("query_id", index.key, "rank"))
    return found.join(teams, index.key)


class ScopedIndex:
    """Postings and lengths of many owners' documents, in folders by a hash of the owner."""

    def __init__(self, spark: SparkSession, path: str, owner: str, key: str, buckets: int = 64):
        self.spark, self.path, self.owner, self.key, self.buckets = spark, path, owner, key, buckets

    def _bucket(self):
        return F.pmod(F.crc32(F.col(self.owner).cast("string").cast("binary")), F.lit(self.buckets)).cast("int")

    def write(self, docs: DataFrame, field: str) -> ScopedIndex:
        """Index a field of docs (owner, key), one row for each key of an owner."""
        both = docs.select(F.struct(self.owner, self.key).alias("_doc"), field)
        posts = S.postings(both, [field], "_doc").select("_doc.*", "term", "tf")
        sizes = S.lengths(both, [field], "_doc").select("_doc.*", "length")
        for name, rows in (("postings", posts), ("lengths", sizes)):
            # an owner with very many rows is spread over tasks
            dealt = rows.withColumn(PART, self._bucket()).hint("rebalance", PART)
            dealt.write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/{name}")
        return self

    def of(self, name: str, owners: list[str]) -> DataFrame:
        """The rows of some owners, from their folders only."""
        import zlib

        some = sorted({zlib.crc32(str(o).encode()) % self.buckets for o in owners})
        return self.spark.read.parquet(f"{self.path}/{name}").filter(F.col(PART).isin(some) & F.col(self.owner).cast("string").isin([str(o) for o in owners])).drop(PART)

    def search(self, queries: dict[int, tuple[str, str]], limit: int = 6) -> DataFrame:
        """query_id, owner, key, score, rank: the best of the owner's own documents for (owner, text), by BM25 of that owner."""
        rows = [(i, str(o), t) for i, (o, text) in queries.items() for t in dict.fromkeys(S.query_terms(text))]
        q = self.spark.createDataFrame(rows or [(0, "", "")], "query_id int, _owner string, term string").limit(len(rows))
        q = F.broadcast(q) if len(rows) <= SMALL else q
        owners = sorted({str(o) for o, _ in queries.values()})
        posts, sizes = self.of("postings", owners), self.of("lengths", owners)
        hits = posts.join(q, (F.col(self.owner).cast("string") == F.col("_owner")) & (posts["term"] == q["term"])).select("query_id", self.owner, self.key, q["term"].alias("term"), "tf")
        df = hits.groupBy("query_id", "term").agg(F.count("*").alias("df"))
        stats = sizes.groupBy(self.owner).agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))
        rows_ = hits.join(df, ["query_id", "term"]).join(sizes, [self.owner, self.key]).join(stats, self.owner)
        scored = rows_.groupBy("query_id", self.owner, self.key).agg(F.round(-F.sum(_part("n_docs", "mean")), 6).alias("score"))
        return S.list_rank(scored, "score", self.key).filter(F.col("rank") <= limit)

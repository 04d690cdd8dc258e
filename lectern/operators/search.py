"""Keyword, vector and hybrid search.

Postings are (doc_id, field, term, tf, positions); every search is a join of the query's terms with them, so
many queries can run at once. `bucketed` postings are written in partitions by a hash of the term, and `of_terms`
reads only the partitions of the terms that are asked for.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.sources.scratch import written



def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their plain letters, from Unicode's decompositions; then all combining marks, which fall away."""
    letters = {}
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if c == c.lower() and plain != c and len(plain) == 1 and plain.isascii() and plain.isalpha():
            letters[c] = plain.lower()
    return "".join(letters) + "".join(map(chr, range(0x300, 0x370))), "".join(letters.values())


#: What is folded, and to what; what has no partner is left out.
FOLD_FROM, FOLD_TO = _folding()
_FOLD = {ord(c): FOLD_TO[n] if n < len(FOLD_TO) else None for n, c in enumerate(FOLD_FROM)}
K1, B = 1.2, 0.75


def fold(c: Column) -> Column:
    return F.translate(F.lower(text.text(c)), FOLD_FROM, FOLD_TO)


def terms(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def postings(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """One row for each document, field and term with its places; only counts are shuffled."""
    each = docs.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("terms")) for f in fields))).alias("x"))
    rows = each.select(key, "x.field", F.posexplode("x.terms").alias("pos", "term"))
    return rows.groupBy(key, "field", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def counts(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """postings without places, which ranking doesn't ask for: counted before they are shuffled."""
    each = docs.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("terms")) for f in fields))).alias("x"))
    return each.select(key, "x.field", F.explode("x.terms").alias("term")).groupBy(key, "field", "term").agg(F.count("*").alias("tf"))


BUCKETS = 64


def bucketed(posts: DataFrame) -> DataFrame:
    """posts with bucket, to be written in partitions by it: dealt by bucket, so a task writes few of them."""
    return posts.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BUCKETS)).cast("int")).hint("rebalance", "bucket")


def of_terms(posts: DataFrame, wanted: list[str]) -> DataFrame:
    """The postings of some terms; posts: a table in partitions by bucket."""
    return posts.filter(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in wanted})) & F.col("term").isin(wanted)).drop("bucket")


def lengths(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    total = F.size(terms(F.col(fields[0])))
    for f in fields[1:]:
        total = total + F.size(terms(F.col(f)))
    return docs.select(key, total.cast("bigint").alias("length"))


def searched(docs: DataFrame, fields: list[str], wanted: list[str], key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Postings of the wanted terms only, a row for each place, and lengths, as bm25 takes them: from one reading of all texts, without an index."""
    each = docs.select(key, F.flatten(F.array(*(terms(F.col(f)) for f in fields))).alias("terms"))
    found = written(each.select(key, F.size("terms").cast("bigint").alias("length"), F.filter("terms", lambda t: t.isin(wanted)).alias("found")), "searched")
    return found.select(key, F.explode("found").alias("term"), F.lit(1).cast("bigint").alias("tf")), found.select(key, "length")


def query_terms(query: str, least: int = 2) -> list[str]:
    import re

    return [t for t in re.findall(r"[^\W_]+", query.lower().translate(_FOLD)) if len(t) >= least]


def prefix_match(posts: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """Documents in which every token of the query begins some term."""
    wanted = list(dict.fromkeys(query_terms(query)))
    if not wanted:
        return posts.select(key).limit(0)
    hit = F.array(*(F.when(F.col("term").startswith(t), F.lit(n)) for n, t in enumerate(wanted)))
    any_ = F.lit(False)
    for t in wanted:
        any_ = any_ | F.col("term").startswith(t)
    rows = posts.filter(any_).select(key, F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("n"))
    return rows.groupBy(key).agg(F.countDistinct("n").alias("n")).filter(F.col("n") == len(wanted)).select(key)


def _back(n: int):
    return lambda p: p - n


def exact_match(posts: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """Documents with every white-space token of the query: a token of several terms as a phrase, in one field."""
    out = None
    for token in dict.fromkeys("".join(" " if c in "\"'\\-:()*" else c for c in query).split()):
        phrase = query_terms(token, 1)
        if not phrase:
            continue
        hit = posts.filter(F.col("term") == phrase[0]).select(key, "field", F.explode("positions").alias("at"))
        for n, t in enumerate(phrase[1:], 1):
            hit = hit.join(posts.filter(F.col("term") == t).select(key, "field", F.explode(F.transform("positions", _back(n))).alias("at")), [key, "field", "at"], "left_semi")
        hit = hit.select(key).distinct()
        out = hit if out is None else out.join(hit, key, "left_semi")
    return posts.select(key).limit(0) if out is None else out


def bm25(posts: DataFrame, sizes: DataFrame, queries: DataFrame, prefix: bool = False, key: str = "doc_id") -> DataFrame:
    """query_id, key, score (lower is better) of documents that hold a term of the query.

    queries: (query_id, term), one row for each distinct term. With prefix a query's term stands for
    all terms that it begins.
    """
    q = queries.select("query_id", F.col("term").alias("_q"))
    hits = posts.select(key, "term", "tf").join(F.broadcast(q), F.col("term").startswith(F.col("_q")) if prefix else F.col("term") == F.col("_q"))
    # only the queries' terms are aggregated, once for both counts
    tf = written(hits.groupBy("query_id", "_q", key).agg(F.sum("tf").alias("tf")), "tf")
    df = tf.groupBy("query_id", "_q").agg(F.count("*").alias("df"))
    stats = sizes.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    rows = tf.join(F.broadcast(df), ["query_id", "_q"]).join(sizes, key).crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy("query_id", key).agg(F.round(-F.sum(part), 6).alias("score"))


def queries_frame(spark, queries: dict[int, str], least: int = 2) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, q in queries.items() for t in dict.fromkeys(query_terms(q, least))] or [], "query_id int, term string")


def list_rank(hits: DataFrame, *orders: Column | str) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*orders)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


#: Vectors and queries of a block: a task holds the distances of two blocks at once.
BLOCK, QUERY_BLOCK = 2048, 512
#: How far two ways of adding up a cosine may lie apart, and the rounding of distances to six places.
SLACK = 2e-6


def _regular(vec: Column, size: Column) -> Column:
    """Vectors of that size without null or very large components or ones that aren't numbers."""
    return F.coalesce((F.size(vec) == size) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < 1e100)), F.lit(False))


def _in_blocks(rows: DataFrame, per: int, n: int) -> DataFrame:
    """rows (i, x) as lists of about `per` of them."""
    blocks = 1 + n // per
    return rows.withColumn("_b", F.pmod(F.xxhash64("i"), F.lit(blocks))).groupBy("_b").agg(F.collect_list("i").alias("i"), F.collect_list("x").alias("x")).drop("_b")


def _nearest(pairs: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest vectors of each query from blocks of both: a matrix product finds all that might be, which are then added up in order."""
    matrix = lambda x: x.values.flatten().to_numpy(zero_copy_only=False).reshape(len(x.values), -1)
    in_order = lambda x: np.cumsum(x, axis=1)[:, -1]
    for batch in pairs:
        for at in range(batch.num_rows):
            i, x, qi, qx = (batch[c][at] for c in ("i", "x", "qi", "qx"))
            i, qi, x, q = i.values.to_numpy(), qi.values.to_numpy(), matrix(x).astype(np.float64), matrix(qx).astype(np.float64)
            long, q_long = np.sqrt(in_order(x * x)), np.sqrt(in_order(q * q))
            both = q_long[:, None] * long[None, :]
            rough = np.divide(-(q @ x.T), both, out=np.zeros_like(both), where=both > 0)
            last = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if k < len(i) else np.full((len(qi), 1), np.inf)
            row, col = np.nonzero(rough <= last + SLACK)
            for some in np.split(np.arange(len(row)), np.flatnonzero(np.diff(row)) + 1):
                if not len(some):
                    continue
                r, c = row[some[0]], col[some]
                d = both[r, c]
                d = 1 - np.divide(in_order(x[c] * q[r]), d, out=np.zeros(len(c)), where=d > 0)
                best = np.lexsort((i[c], np.round(d, 6)))[:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), qi[r])), pa.array(i[c][best]), pa.array(d[best])], ["query_id", "id", "d"])


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", most: int = 10_000) -> DataFrame:
    """Exact: query_id, id, distance, rank. queries: (query_id, q).

    By cosine, blocks of vectors meet blocks of queries, and a pair of blocks is one matrix product that leaves each query its k
    nearest, whatever there are of both. Vectors of another size than the longest, or with null, very large or no numbers, meet
    all of the other side one by one, as all do by other metrics: up to `most` queries are broadcast; more are dealt into
    blocks of about that size.
    """
    q = queries.select("query_id", "q")
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("x"))
    d = {"cosine": cosine_distance, "l2": l2}[metric](F.col("x"), F.col("q"))
    if metric != "cosine" or dict(v.dtypes)["id"] != "bigint" or dict(q.dtypes)["query_id"] != "bigint":
        return list_rank(_one_by_one(v, q, most).select("query_id", "id", F.round(d, 6).alias("distance")), "distance", "id").filter(F.col("rank") <= k)
    n, longest = v.agg(F.count("*"), F.max(F.size("x"))).first()
    size = F.lit(longest or 0)
    v, q = v.withColumn("_ok", _regular(F.col("x"), size)), q.withColumn("_ok", _regular(F.col("q"), size))
    n_queries, odd_queries = q.agg(F.count("*"), F.count_if(~F.col("_ok"))).first()
    blocks = _in_blocks(v.filter("_ok and size(x) > 0").select(F.col("id").alias("i"), "x"), BLOCK, n)
    asked = _in_blocks(q.filter("_ok and size(q) > 0").select(F.col("query_id").alias("i"), F.col("q").alias("x")), QUERY_BLOCK, n_queries).toDF("qi", "qx")
    near = blocks.crossJoin(asked).mapInArrow(lambda pairs: _nearest(pairs, k), "query_id long, id long, d double").withColumnRenamed("d", "distance")
    odd = _one_by_one(v.filter("not _ok").drop("_ok"), q.drop("_ok"), most)
    if odd_queries:
        odd = odd.unionByName(_one_by_one(v.filter("_ok").drop("_ok"), q.filter("not _ok").drop("_ok"), most))
    near = near.unionByName(odd.select("query_id", "id", d.alias("distance")))
    return list_rank(near.select("query_id", "id", F.round("distance", 6).alias("distance")), "distance", "id").filter(F.col("rank") <= k)


def _one_by_one(v: DataFrame, q: DataFrame, most: int) -> DataFrame:
    n = q.count()
    if n <= most:
        return v.join(F.broadcast(q))
    blocks = -(-n // most)
    dealt = q.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    return v.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).join(dealt.hint("shuffle_hash"), "_b").drop("_b")


def knn_lsh(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding"):
    """Approximate, by random projections."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    v = vectors.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=6, seed=3).fit(v)
    return model.approxNearestNeighbors(v, Vectors.dense(query), k).select(id_col, F.col("distCol").alias("distance"))


def scaled(c: str, keys: list[str]) -> Column:
    """Within a list: 0 for absent or equal strengths, else from 0 to 1."""
    w = Window.partitionBy(*keys)
    there = F.when(F.col(c) > 0, F.col(c))
    lo, hi = F.min(there).over(w), F.max(there).over(w)
    return F.when((F.col(c) > 0) & (hi > lo), (F.col(c) - lo) / (hi - lo)).otherwise(0.0)


def merge_lists(keywords: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, id) of either list with both ranks and strengths, 0 or null where absent."""
    a = keywords.select("query_id", "id", F.col("rank").alias("fts_rank"), F.col("strength").alias("fts_raw"))
    b = vectors.select("query_id", "id", F.col("rank").alias("sem_rank"), F.col("strength").alias("sem_raw"))
    return a.join(b, ["query_id", "id"], "full_outer").fillna(0.0, ["fts_raw", "sem_raw"])


def fuse(merged: DataFrame, k: int, rrf: int = 60, weight: float = 0.04) -> DataFrame:
    """Reciprocal ranks of both lists, and a little for the better scaled strength; the k best of each query."""
    m = merged.withColumns({"fts_n": scaled("fts_raw", ["query_id"]), "sem_n": scaled("sem_raw", ["query_id"])})
    inverse = lambda r: F.coalesce(F.lit(1.0) / (F.lit(rrf) + F.col(r)), F.lit(0.0))
    s = inverse("fts_rank") + inverse("sem_rank") + F.lit(weight) * F.greatest("fts_n", "sem_n")
    src = F.when(F.col("fts_rank").isNotNull() & F.col("sem_rank").isNotNull(), "both").when(F.col("fts_rank").isNotNull(), "fts").otherwise("semantic")
    return list_rank(m.withColumns({"score": F.round(s, 6), "src": src}), F.desc("score"), "id").filter(F.col("rank") <= k)


def best_excerpt(paragraphs: DataFrame, query: str, key: str = "doc_id", least: int = 120, most: int = 1600) -> DataFrame:
    """Each document's paragraph with the best keyword score, then the longest; the first one if all are short."""
    p = paragraphs.withColumns({"score": text.keyword_score(query, F.col("text")), "_long": F.length("text") >= least})
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_long"), F.when(F.col("_long"), F.col("score")).desc_nulls_last(), F.when(F.col("_long"), F.length("text")).desc_nulls_last(), "pos"))
    best = p.withColumn("_n", n).filter("_n = 1")
    cut = F.concat(F.rtrim(F.substring("text", 1, most - 3)), F.lit("..."))
    return best.select(key, F.when(F.length("text") > most, cut).otherwise(F.col("text")).alias("excerpt"), F.when(F.col("_long"), F.col("score")).alias("score"))


def first_token_with_hits(docs: DataFrame, query: str, limit: int, column: str = "content_plain", least: int = 4) -> DataFrame:
    """Rows that hold the first of the query's tokens that any row holds."""
    wanted = [t for t in query.lower().split() if len(t) >= least]
    low = F.lower(column)
    hits = docs.withColumn("_hits", F.filter(F.array(*(F.when(low.contains(t), F.lit(n)) for n, t in enumerate(wanted))), lambda x: x.isNotNull())).filter("size(_hits) > 0")
    chosen = hits.agg(F.min(F.array_min("_hits")).alias("_token"))
    return hits.crossJoin(F.broadcast(chosen)).filter(F.array_contains("_hits", F.col("_token"))).drop("_hits", "_token").orderBy(F.desc("imported_at"), "id").limit(limit) if wanted else docs.limit(0)


#: Fixed values.
WARRANTS = ("because", "therefore", "thus", "as a result", "leads to", "causes", "evidence", "study", "data", "shows", "demonstrates", "proves", "percent")


def windows(paragraphs: DataFrame, least: int = 400, key: str = "doc_id") -> DataFrame:
    """key, window, first, last: runs of paragraphs that reach `least` words, each beginning with the last one of the run before.

    A fold over a document's word counts that starts anew at the threshold: one row for each document, as
    long as its list of paragraphs.
    """
    per = paragraphs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", text.n_words(F.col("text")).alias("n")))).alias("p"))
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def step(acc: Column, x: Column) -> Column:
        total = acc["words"] + x["n"]
        first = F.coalesce(acc["first"], x["pos"])
        full = total >= least
        one = F.array(F.struct(first.alias("first"), x["pos"].alias("last")))
        return F.struct(F.when(full, x["pos"]).otherwise(first).alias("first"), F.when(full, x["n"]).otherwise(total).alias("words"), x["pos"].alias("last"), F.when(full, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(None).cast("int").alias("first"), F.lit(0).cast("bigint").alias("words"), F.lit(None).cast("int").alias("last"), empty.alias("out"))
    done = F.aggregate("p", start, step, lambda a: F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), a["last"].alias("last")))))
    return per.select(key, F.posexplode(done).alias("window", "w")).select(key, "window", "w.first", "w.last")


def best_windows(paragraphs: DataFrame, query: str, top: int = 5, key: str = "doc_id") -> DataFrame:
    """The windows of each document with the best keyword and warrant scores."""
    w = windows(paragraphs, key=key)
    body = w.join(paragraphs.select(F.col(key).alias("_key"), "pos", "text"), (F.col(key) == F.col("_key")) & F.col("pos").between(F.col("first"), F.col("last")))
    whole = body.groupBy(key, "window").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    warrants = sum((F.when(F.lower("text").contains(x), 1).otherwise(0) for x in WARRANTS), F.lit(0))
    scored = whole.withColumn("score", text.keyword_score(query, F.col("text")) + warrants)
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "window"))
    return scored.withColumn("nth", n).filter(F.col("nth") <= top).select(key, "window", "score", "nth")


#: Fixed values.
SCHOLARLY_HOSTS = (
    "doi.org", "arxiv.org", "biorxiv.org", "medrxiv.org", "ssrn.com", "jstor.org", "sciencedirect.com", "springer.com", "link.springer.com", "wiley.com", "onlinelibrary.wiley.com", "nature.com", "science.org",
    "tandfonline.com", "cambridge.org", "oup.com", "academic.oup.com", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "plos.org", "journals.plos.org", "frontiersin.org", "mdpi.com",
    "sagepub.com", "journals.sagepub.com", "semanticscholar.org", "openalex.org", "researchgate.net", "core.ac.uk", "hal.science", "scholar.archive.org", "hathitrust.org", "elifesciences.org",
    "apa.org", "ieee.org", "acm.org", "rand.org", "brookings.edu", "nber.org", "cfr.org", "csis.org", "iiss.org", "chathamhouse.org",
)
#: Fixed values.
BLOG_HOSTS = ("medium.com", "substack.com", "wordpress.com", "blogspot.com", "tumblr.com", "blogger.com", "wix.com", "squarespace.com", "reddit.com", "quora.com", "linkedin.com", "twitter.com", "x.com", "facebook.com", "youtube.com", "tiktok.com")
#: Fixed values.
SCHOLARLY_ADAPTERS = ("Semantic Scholar", "OpenAlex", "Crossref", "Unpaywall", "arXiv", "CORE")


def under(host: Column, names) -> Column:
    """The host is one of the names, or under one."""
    out = F.lit(False)
    for n in names:
        out = out | (host == n) | host.endswith("." + n)
    return out


def scholarly_bonus(url: Column) -> Column:
    host = text.host_of(url)
    return (
        F.when(host == "", 0).when(under(host, SCHOLARLY_HOSTS), 6).when(host.endswith(".edu") | host.endswith(".ac.uk") | host.endswith(".gov"), 5)
        .when(under(host, BLOG_HOSTS), -4).when(url.rlike("(?i)/(blog|opinion|thoughts|musings)/"), -2).otherwise(0)
    )


def prestige_bonus(url: Column, sites) -> Column:
    host = text.host_of(url)
    return F.when((host != "") & under(host, sites), 2).otherwise(0)


def with_relevance(candidates: DataFrame, score_fn: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """candidates with relevance, by score_fn a batch at a time; what it gives no score has 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(relevance=pd.to_numeric(score_fn(f), errors="coerce").fillna(0.0).astype(float))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    return candidates.mapInPandas(run, f"{kinds}, relevance double")


def rank_sources(candidates: DataFrame, query: str, sites=(), cap: int = 10, threshold: float = 9.0) -> DataFrame:
    """Per query_id: candidates (url, title, body, adapter, relevance), pre-ranked by adapter and host, the `cap` first scored; winner and low_confidence."""
    adapter = F.col("adapter").isin(*SCHOLARLY_ADAPTERS)
    pre = F.when(adapter, 5).otherwise(0) + scholarly_bonus(F.col("url"))
    w = Window.partitionBy("query_id")
    c = candidates.withColumn("_n", F.row_number().over(w.orderBy(F.desc(pre), "url"))).filter(F.col("_n") <= cap)
    keyword = F.least(F.lit(6.0), text.keyword_score(query, F.concat_ws(" ", "title", F.substring("body", 1, 500))) / 8)
    relevance = F.coalesce("relevance", F.lit(0.0))
    total = relevance + prestige_bonus(F.col("url"), sites) + scholarly_bonus(F.col("url")) + F.when(adapter, 4).otherwise(0) + F.when(relevance == 0, keyword).otherwise(0.0)
    s = c.withColumn("total", F.round(total, 6))
    nth = F.row_number().over(w.orderBy(F.desc("total"), "url"))
    return s.withColumn("nth", nth).withColumn("low_confidence", F.max("total").over(w) < threshold).drop("_n")


def jaccard(a: Column, b: Column, least: int = 3) -> Column:
    x, y = text.tokens(a, least), text.tokens(b, least)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))

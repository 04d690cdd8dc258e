"""Approximate nearest neighbours: an inverted file with product-quantised residuals and exact reranking.

Coarse centroids (about the square root of the number of vectors, as far as the sample goes) and the codebooks of
the residuals are fitted on a bounded sample chosen by a hash; how many lists a query probes is tuned on the
same sample for a recall of at least `target`. Every vector is then assigned to the list of its nearest centroid and
coded. Lists are packed into blocks of about `block` codes; one that is larger, as when it holds a third of all
vectors, is dealt over several by a hash of the id. Queries are packed likewise, by their own nearest list, so those
that probe the same lists share a block. Each pair of blocks that meets is one task's work: tables of distances from
each query's residual to the codewords give approximate distances by look-ups, and the best `rerank` of a query are
kept. Over all blocks again the best `rerank` of each query are kept, and only those are compared exactly, once.

A query probes further lists until they hold more than k vectors, so none gets fewer neighbours than there are.

Distance is Euclidean, in double precision on the original vectors; ties go to the smaller id, in the
approximate order as in the exact one. Defined results: vectors that are null or zero or hold null or
non-finite components take no part; if lengths differ, those of the commonest length do (the smaller of
equally common ones); rows with a null id take no part; of rows with one id, the one with the smaller
hash does; a query with fewer than k candidates gets all of them; columns of other names are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import hashed_sample, written


@dataclass
class Index:
    """Bounded by its parameters: `lists` centroids and `parts` codebooks of `codes` words."""

    coarse: np.ndarray  # lists x dim
    books: np.ndarray  # parts x codes x dim / parts
    probes: int

    def nearest_lists(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (x * x).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse * self.coarse).sum(1)
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = x - self.coarse[lists]
        return np.stack([_nearest(part, book) for part, book in zip(np.split(r, len(self.books), 1), self.books)], 1).astype(np.uint8)

    def approximate(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances, queries x codes, of vectors in list `which`."""
        out = np.zeros((len(q), len(codes)))
        for p, (part, book) in enumerate(zip(np.split(q - self.coarse[which], len(self.books), 1), self.books)):
            table = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            out += table[:, codes[:, p]]
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return np.concatenate([distinct, np.repeat(distinct[:1], k - len(distinct), 0)])
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=col, minlength=k) for col in x.T], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, lists: int = 64, parts: int = 16, codes: int = 256, k: int = 10, target: float = 0.98, tuned_on: int = 200) -> Index:
    rng = np.random.default_rng(7)
    dim = sample.shape[1]
    while dim % parts:
        parts -= 1
    coarse = _k_means(sample, min(lists, max(1, len(sample) // 8)), rng)
    at = _nearest(sample, coarse)
    r = sample - coarse[at]
    few = r[rng.choice(len(r), min(len(r), 8_000), replace=False)]
    books = np.stack([_k_means(p, codes, rng, 8) for p in np.split(few, parts, 1)])
    index = Index(coarse, books, len(coarse))
    # the fewest lists that hold the target share of the true neighbours
    q = rng.choice(len(sample), min(tuned_on, len(sample)), replace=False)
    d = ((sample[q] ** 2).sum(1)[:, None] - 2 * sample[q] @ sample.T + (sample**2).sum(1))
    d[np.arange(len(q)), q] = np.inf
    true = np.argsort(d, axis=1)[:, : min(k, len(sample) - 1)]
    order = index.nearest_lists(sample[q], len(coarse)).argsort(axis=1)  # rank of each list for each query
    depth = np.take_along_axis(order, at[true], 1) if true.size else np.zeros((1, 1), int)
    index.probes = int(np.quantile(depth, target, method="higher")) + 1 if true.size else len(coarse)
    return index


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id long, v array<double>: vectors that take part, one for each id."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = v.filter("id is not null and v is not null").filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    dims = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    v = v.filter(F.size("v") == dims[0]["dim"]) if dims else v
    return v.groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))


def _packed(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list: its first block, and over how many blocks it is dealt. Small ones share a block with their neighbours."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            at, held = at + 1, 0
        first[i], parts[i] = at, max(1, -(-n // most))
        if n > most:
            at, held = at + parts[i], 0
        else:
            held += n
    return first, parts


def _sizes(df: DataFrame, lists: int) -> np.ndarray:
    """Rows by list: at most `lists` numbers."""
    out = np.zeros(lists, np.int64)
    for r in df.groupBy("list").agg(F.count("*").alias("n")).collect():
        out[r["list"]] = r["n"]
    return out


def _dealt(first: np.ndarray, parts: np.ndarray, key: str) -> Column:
    """The block of a row, by its list and a hash of its key."""
    of = F.get(F.lit(first.tolist()), F.col("list")) if len(first) else F.lit(0)
    return (of + F.pmod(F.xxhash64(key), F.get(F.lit(parts.tolist()), F.col("list")))).cast("long")


def _top(d: np.ndarray, most: int) -> np.ndarray:
    """The places of the `most` smallest, smallest first; of equal ones, in order of place."""
    if most >= len(d):
        return np.argsort(d, kind="stable")
    at = np.flatnonzero(d <= np.partition(d, most - 1)[most - 1])
    return at[np.argsort(d[at], kind="stable")][:most]


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sampled: int = 10_000, rerank: int = 400, block: int = 65_536, together: int = 4_096, lists: int | None = None, **fitted) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other vectors found for each vector with `queries` (a condition on `id`).

    sampled: about how many vectors the index is fitted on. rerank: how many of each query are compared exactly.
    block, together: about how many vectors and queries meet in one task at a time. lists: of the index (default: the
    square root of the number of vectors; an eighth of the sample at most).
    """
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    sample = hashed_sample(rows.select("id", "v"), F.col("id"), sampled, "ann")
    sample = np.array([r["v"] for r in sample.orderBy("id").collect()], float)
    if not len(sample):
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    index = fit(sample, lists or int(np.ceil(np.sqrt(rows.count()))), k=k, **fitted)
    n_lists, dim = len(index.coarse), sample.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(index)
    stacked = lambda b, c: np.stack(b[c].to_numpy()).astype(float) if len(b) else np.zeros((0, dim))

    def assign(batches):
        for b in batches:
            x = stacked(b, "v")
            at = sent.value.nearest_lists(x, 1)[:, 0] if len(x) else np.zeros(0, int)
            yield pd.DataFrame({"list": at, "id": b["id"], "codes": [c.tobytes() for c in sent.value.encode(x, at)] if len(x) else []})

    coded = written(rows.mapInPandas(assign, "list int, id long, codes binary"), "coded")
    sizes = _sizes(coded, n_lists)
    first, parts = _packed(sizes, block)
    asked = written(rows.filter(queries).join(coded.select("id", "list"), "id").select("id", "v", "list"), "asked")
    q_first, q_parts = _packed(_sizes(asked, n_lists), together)
    where = rows.sparkSession.sparkContext.broadcast((sizes, first, parts))

    def probe(batches):
        """Each query once for each block that holds a list which it probes; a list in several blocks is in all of them."""
        sizes, first, parts = where.value
        for b in batches:
            x = stacked(b, "v")
            order = sent.value.nearest_lists(x, n_lists) if len(x) else np.zeros((0, n_lists), int)
            out = []
            for q, mine, of, v in zip(b["id"], b["part"], order, x):
                enough = int(np.searchsorted(np.cumsum(sizes[of]), k, side="right")) + 1
                of = of[: max(sent.value.probes, enough)]
                at: dict[int, list[int]] = {}
                for one in of[sizes[of] > 0].tolist():
                    for n in range(first[one], first[one] + parts[one]):
                        at.setdefault(n, []).append(one)
                out += [(n, mine, q, v.astype(np.float32), some) for n, some in at.items()]
            yield pd.DataFrame(out, columns=["block", "part", "query_id", "q", "lists"])

    probes = written(asked.withColumn("part", _dealt(q_first, q_parts, "id")).mapInPandas(probe, "block long, part long, query_id long, q array<float>, lists array<int>"), "probes")
    met = probes.select(F.col("block").alias("of_block"), F.col("part").alias("of_part")).distinct()
    held = coded.withColumn("of_block", _dealt(first, parts, "id")).join(met, "of_block")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The best of one block for the queries of one part, by approximate distance."""
        found = []
        if len(a) and len(b):
            b = b.sort_values("id", kind="stable")
            ids, at = b["id"].to_numpy(), b["list"].to_numpy()
            codes = np.frombuffer(b"".join(b["codes"]), np.uint8).reshape(len(b), -1)
            place = {n: np.flatnonzero(at == n) for n in np.unique(at).tolist()}
            for k0 in range(0, len(a), 128):  # so the distances at a time are bounded
                some = a.iloc[k0 : k0 + 128]
                v, asks = np.stack(some["q"].to_numpy()).astype(float), [set(x.tolist()) for x in some["lists"]]
                d = np.full((len(some), len(ids)), np.inf)  # in order of id
                for n, where_ in place.items():
                    mine = np.array([i for i, lists_ in enumerate(asks) if n in lists_], np.int64)
                    if len(mine):
                        d[np.ix_(mine, where_)] = sent.value.approximate(v[mine], n, codes[where_])
                d[some["query_id"].to_numpy()[:, None] == ids] = np.inf
                for q, row in zip(some["query_id"], d):
                    top = _top(row, rerank)
                    top = top[np.isfinite(row[top])]
                    found.append(pd.DataFrame({"query_id": q, "vec_id": ids[top], "d": row[top]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "d": []})

    hits = probes.groupBy("block", "part").cogroup(held.groupBy("of_block", "of_part")).applyInPandas(search, "query_id long, vec_id long, d double")
    nth = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    # a query has at most `rerank` hits from each block
    close = hits.withColumn("nth", nth("d", "vec_id")).filter(F.col("nth") <= rerank).select("query_id", "vec_id")
    exact = close.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    square = F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x)
    best = exact.select("query_id", "vec_id", F.sqrt(square).alias("score")).withColumn("rank", nth("score", "vec_id")).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
